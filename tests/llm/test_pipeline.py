import corpus_pipeline
import __spark_entry__
from tests.llm import brute
from tests.llm.test_llm import check_packing

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, kept = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, SF).cache()
        rows = docs.collect()
        if k == 4:
            check_packing(rows, before.items())
            continue
        assert docs.columns == names
        after = {r.doc_id: r.text for r in rows}
        assert len(after) == len(rows) and after.items() <= before.items()
        if k == 0:
            stats = {i: brute.base_stats(t) for i, t in before.items()}
            assert all(stats[i][0] >= 50 and 2 * stats[i][4] <= stats[i][0] for i in after)
        if k == 1:
            assert set(after) == {r[0] for r in brute.exact(before.items()) if r[3]}
        if k == 2:
            assert set(after) == {r[0] for r in brute.near(before.items(), 5, 4, 5) if r[0] == r[2]}
        kept.append(len(after))
    assert kept == sorted(kept, reverse=True) and kept[-1] > 0


def test_registered():
    q = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{k}_") for n in q) for k in range(1, 11)] == [1] * 10 and "pipeline" in q
    assert set(__spark_entry__.oracle_sql()) <= set(q)
