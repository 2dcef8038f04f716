import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_names_without_a_session():
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and len(q) > 50"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0


def test_without_the_corpus_operators(tmp_path):
    import shutil

    shutil.copytree(ROOT / "linkloom", tmp_path / "linkloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'exact_candidates' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path).returncode == 0


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["source1_entity_id", "candidate_entity_id", "candidate_source", "blocking_rules"] and df.count() > 0


def test_queries_run_from_another_folder(tmp_path):
    """Workers get what they need with the plan, wherever they start."""
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__ as e
df = spark.createDataFrame([("S1-1", "Caf\u00e9 X\uff21", "1 Road", "US", "S1"), ("S2-1", "Cafe\u0301 XA", "2 Road", "US", "S2")], "entity_id string, business_name string, business_address string, country string, source string")
from linkloom.operators import blocking
assert blocking.approximate(df).count() == 1
"""
    env = {k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]


def test_a_broken_dependency_is_not_taken_for_absence(tmp_path):
    import shutil

    shutil.copytree(ROOT / "linkloom", tmp_path / "linkloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "linkloom" / "llm").mkdir()
    (tmp_path / "linkloom" / "llm" / "__init__.py").write_text("")
    (tmp_path / "linkloom" / "llm" / "queries.py").write_text("import no_such_library")
    assert subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries()"], cwd=tmp_path, capture_output=True).returncode != 0
