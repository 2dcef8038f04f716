"""Token ids of all documents in Huffman-coded files, and back."""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.llm import huffman
from linkloom.llm.common import NO_ID, Scratch, prepare, texts, trim
from linkloom.llm.vocab import load, word_ids


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def qualified(spark: SparkSession, folder: str) -> str:
    """A folder with its scheme, so that executors write where Spark reads."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"file://{uri[5:]}" if uri.startswith("file:/") and not uri.startswith("file://") else uri


IDS = "doc_id long, n long, crc long, ids binary"


def _tokenise(vocab: str, end_id: int, size: int):
    """Rows of documents, and at a task's end one with the counts of all its ids (n is -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        words = word_ids(vocab)
        total = np.zeros(size, np.int64)
        names = [x.split()[0] for x in IDS.split(", ")]
        for b in batches:
            ids, n = words.flat(b.column(1).to_pylist(), end_id)
            total += np.bincount(ids, minlength=size)
            offsets = np.concatenate([[0], np.cumsum(n)]) * ids.itemsize
            raw = pa.py_buffer(ids)
            view = memoryview(raw)
            crc = [zlib.crc32(view[x:y]) for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            own = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets), raw])
            for lo in range(0, len(n), 1024):
                part = slice(lo, lo + 1024)
                yield pa.RecordBatch.from_arrays([b.column(0)[part], pa.array(n[part]), pa.array(crc[part], pa.int64()), own[part].cast(pa.binary())], names=names)
            del ids, raw, view, own
            trim()
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([-1], pa.int64()), pa.array([0], pa.int64()), pa.array([total.astype("<i8").tobytes()], pa.binary())], names=names)
        trim()

    return run


def _spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for raw in b.column(0).to_pylist():
            counts = np.frombuffer(raw, "<i8")
            seen = np.nonzero(counts)[0]
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(counts[seen], pa.int64())], names=["id", "n"])


def _joined(column: pa.BinaryArray, kind: str) -> np.ndarray:
    """All values of a column without nulls, one after the other, as they lie in memory."""
    if not len(column):
        return np.empty(0, kind)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, "<i4", len(column) + 1, 4 * column.offset)
    return np.frombuffer(data, kind, (at[-1] - at[0]) // np.dtype(kind).itemsize, at[0]).copy() if at[-1] > at[0] else np.empty(0, kind)


def _write(folder: str, lengths: np.ndarray, kind: str):
    codes = huffman.canonical_codes(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        doc_ids, counts, ids = [], [], []
        for b in batches:
            doc_ids.append(b.column(0).to_numpy(zero_copy_only=False))
            counts.append(b.column(1).to_numpy(zero_copy_only=False))
            ids.append(_joined(b.column(3), kind))
        if doc_ids:
            part = TaskContext.get().partitionId()
            content = huffman.write_file(np.concatenate(doc_ids), np.concatenate(counts), np.concatenate(ids), lengths, codes)
            files, at = _filesystem(folder)
            files.create_dir(at, recursive=True)
            name = f"{at}/part-{part:06d}.tokens"
            with files.open_output_stream(own := f"{name}.{uuid.uuid4().hex}.tmp") as out:
                out.write(content)
            files.move(own, name)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([sum(map(len, ids))], pa.int64()), pa.array([len(content)], pa.int64())], names=["part", "n", "n_bytes"])
        trim()

    return run


def _read(checksums: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                part = int(path.rpartition("part-")[2].split(".")[0])
                doc_ids, counts, ids = huffman.read_file(content.as_buffer().to_pybytes())
                raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
                ends = np.cumsum(counts.astype(np.int64))
                begins = ends - counts.astype(np.int64)
                for lo in range(0, len(doc_ids), 2000):
                    at = [raw[4 * s : 4 * e] for s, e in zip(begins[lo : lo + 2000].tolist(), ends[lo : lo + 2000].tolist())]
                    n = len(at)
                    own = pa.array([zlib.crc32(x) for x in at], pa.int64()) if checksums else pa.array([bytes(x) for x in at], pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part] * n, pa.int64()), pa.array(doc_ids[lo : lo + n]), pa.array(begins[lo : lo + n]), pa.array(counts[lo : lo + n].astype(np.int64)), own],
                        names=["part", "doc_id", "start", "n_tokens", "ids_crc32" if checksums else "ids"],
                    )
        trim()

    return run


def write_token_files(docs: DataFrame, folder: str, vocab: str = "word_bpe_49k.json", end_id: int = 1, per_file: int = 8_000_000) -> DataFrame:
    """Writes the ids of all documents, ``end_id`` after each, in ascending doc_id order.

    One file for each range of (doc_id, number of ids, their checksum), of about
    ``per_file`` tokens, so that rows of one doc_id have an order of their own
    and may fill many files; files are numbered in order of their ranges and
    appear under their final names only when whole, so a task that runs again
    replaces its own file. Codes come from the counts of ids over all documents.
    A task holds the ids of an Arrow batch, then those of one file; a document's
    ids are never parted. Returns part, n and n_bytes of each file.
    """
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "ids")
    size = load(vocab).get_vocab_size()
    kind = "<u2" if size <= 65536 else "<u4"
    rows = texts(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    ids = scratch.save(rows.mapInArrow(_tokenise(vocab, end_id, size), IDS), "ids", codec="uncompressed")
    counts = np.zeros(size, np.int64)
    counted = ids.where("n < 0").select("ids").mapInArrow(_spell, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts[counted["id"].to_numpy()] = counted["n"].to_numpy()
    lengths = huffman.code_lengths(counts)
    parts = max(1, math.ceil(int(counts.sum()) / per_file))
    order = ("doc_id", "n", "crc")
    ordered = ids.where("n >= 0").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    files = scratch.save(ordered.mapInArrow(_write(qualified(spark, folder), lengths, kind), "part long, n long, n_bytes long"), "files")
    scratch.drop("ids")
    return files


def bases(files: DataFrame, many: int = 1024) -> DataFrame:
    """part and base, the ids in all files before it: sums of ``many`` files at a time, then within them."""
    files = files.select("part", "n", F.floor(F.col("part") / many).alias("run"))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    runs = files.groupBy("run").agg(F.sum("n").alias("n")).select("run", F.coalesce(F.sum("n").over(before().orderBy("run")), F.lit(0)).alias("first"))
    return files.join(runs, "run").select("part", (F.col("first") + F.coalesce(F.sum("n").over(before("run").orderBy("part")), F.lit(0))).alias("base"))


def read_token_files(spark: SparkSession, folder: str, files: DataFrame, checksums: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian, 32 bits) of each document in the files; with ``checksums``, ids_crc32 in place of ids."""
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.tokens").load(folder).select("path", "content")
    last = "ids_crc32 long" if checksums else "ids binary"
    docs = content.mapInArrow(_read(checksums), f"part long, doc_id long, start long, n_tokens long, {last}")
    return docs.join(bases(files), "part").select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), (F.col("base") + F.col("start")).alias("start"), "n_tokens", last.split()[0])


def round_trip(docs: DataFrame) -> DataFrame:
    """Writes the files below the shared folder and reads them back, with a checksum in place of ids.

    Null texts are empty: their end id alone. Rows that share a doc_id (null is
    one, before all others) lie in order of their number of ids, then checksum,
    whatever the partitions of ``docs`` are.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "token-files")
    files = write_token_files(docs, f"{scratch.path}/tokens")
    if not files.take(1):
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_token_files(spark, f"{scratch.path}/tokens", files, checksums=True)
