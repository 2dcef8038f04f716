"""What the corpus operators share: input columns, the shared folder, code shipping.

Defined for every operator here: a null text counts as empty, a null ``doc_id``
is an ordinary value that sorts before all others, columns other than the ones
an operator names are ignored whatever their names are, and an input without
rows gives an output without rows. Texts are worked on whole: a task holds the
longest text it meets, and what an operator derives from it.
"""

from __future__ import annotations

import ctypes
import gc
import os
import sys
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id inside packed blocks.
NO_ID = -(2**63)

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives executors this package, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(), "linkloom.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in root.rglob("*.py"):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def prepare(spark: SparkSession) -> None:
    """Ships the code, lets go of what earlier operators shuffled, and bounds Arrow batches by bytes, so that long texts cannot fill a worker."""
    ship(spark)
    release(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 * 2**20))


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text only; null text is empty."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def input_bytes(df: DataFrame) -> int:
    """The optimiser's size estimate of a plan: file sizes for a plain scan."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().longValue())


class Scratch:
    """A folder of its own below spark.checkpoint.dir for written intermediate tables.

    Executors may be lost between stages: whatever is read more than once is
    read from here, never from an executor's disk.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
            base = tempfile.mkdtemp(prefix="linkloom-shared-")
            spark.sparkContext.setCheckpointDir(base)
            spark.conf.set("spark.checkpoint.dir", base)
        self.path = f"{base.rstrip('/')}/linkloom-{name}-{uuid.uuid4().hex[:12]}"
        # results are read from here until the application ends; then the folder goes
        files, path = self._files("")
        files.mkdirs(path)
        files.deleteOnExit(path)

    def _files(self, label: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{label}" if label else self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def save(self, df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
        at = f"{self.path}/{label}"
        writer = df.write.option("compression", codec)
        if codec == "uncompressed":  # packed bytes, which no dictionary shortens
            writer = writer.option("parquet.enable.dictionary", "false")
        writer.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, *labels: str) -> None:
        """Tables that nothing reads any more."""
        for label in labels:
            files, path = self._files(label)
            files.delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of finished jobs now.

    It does so when the driver's garbage is collected, which a driver with much
    memory may not do before executors' disks hold every round's files.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def forget() -> None:
    """Lets go of vocabularies and what was learnt with them: the operator that begins needs none, but may get a worker that holds some."""
    vocab = sys.modules.get("linkloom.llm.vocab")
    if vocab is not None:
        for held in (vocab.word_ids, vocab.piece_ids, vocab.load):
            held.cache_clear()
    gc.collect()
    trim()


def trim() -> None:
    """Gives memory that a finished task has freed back to the system: a worker serves many tasks of many operators."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # only some C libraries have it
        pass


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z, all other characters as they are."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(c, upper, upper.lower())


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out
