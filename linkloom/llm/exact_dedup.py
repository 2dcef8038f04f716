"""Exact deduplication through a cuckoo-filter index over live digests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import NO_ID, Scratch, forget, fresh, lower_ascii, partitions, prepare

SLOTS = 4


class CuckooFilter:
    """16-bit fingerprints in buckets of four; keys are digests of at least 16 bytes.

    ``add`` never fails: when an insertion runs out of kicks the table doubles
    and is rebuilt from ``stored()``, the keys that live beside it.
    """

    def __init__(self, stored, buckets: int = 1024, kicks: int = 200) -> None:
        self.stored, self.kicks = stored, kicks
        self.resizes = 0
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.table = np.zeros(buckets * SLOTS, np.uint16).tolist()
        self.victim = 0

    @staticmethod
    def _hashes(key: bytes) -> tuple[int, int]:
        return int.from_bytes(key[:2], "little") or 1, int.from_bytes(key[4:12], "little")

    def _other(self, i: int, fp: int) -> int:
        return (i ^ (fp * 0x5BD1E995)) & self.mask

    def __contains__(self, key: bytes) -> bool:
        fp, h = self._hashes(key)
        i = h & self.mask
        j = self._other(i, fp)
        t = self.table
        return fp in t[i * SLOTS : i * SLOTS + SLOTS] or fp in t[j * SLOTS : j * SLOTS + SLOTS]

    def _place(self, i: int, fp: int) -> bool:
        t = self.table
        for s in range(i * SLOTS, i * SLOTS + SLOTS):
            if not t[s]:
                t[s] = fp
                return True
        return False

    def _insert(self, key: bytes) -> bool:
        fp, h = self._hashes(key)
        i = h & self.mask
        j = self._other(i, fp)
        if self._place(i, fp) or self._place(j, fp):
            return True
        for _ in range(self.kicks):
            self.victim = (self.victim + 1) % SLOTS
            s = j * SLOTS + self.victim
            fp, self.table[s] = self.table[s], fp
            j = self._other(j, fp)
            if self._place(j, fp):
                return True
        return False

    def add(self, key: bytes) -> None:
        if self._insert(key):
            return
        while True:
            self.resizes += 1
            self._clear((self.mask + 1) * 2)
            if all(self._insert(k) for k in self.stored()) and self._insert(key):
                return

    def discard(self, key: bytes) -> bool:
        fp, h = self._hashes(key)
        i = h & self.mask
        for b in (i, self._other(i, fp)):
            for s in range(b * SLOTS, b * SLOTS + SLOTS):
                if self.table[s] == fp:
                    self.table[s] = 0
                    return True
        return False


class DigestIndex:
    """Live digests: the filter answers first, a hit is verified against the content of its bucket.

    Content lies in buckets by a part of the digest that the filter does not
    use. An entry is the text's SHA-256 digest and its length in bytes, and the
    group seen so far (greatest row, rows). Texts of equal digest and unequal
    length are different texts, each with an entry. A hit without an equal entry
    in its bucket counts as new. When buckets grow long, their number doubles.
    """

    def __init__(self, buckets: int = 1024) -> None:
        self.buckets: list[list[list]] = [[] for _ in range(buckets)]
        self.filter = CuckooFilter(self.stored)
        self.count = self.false_hits = 0

    def stored(self) -> Iterator[bytes]:
        return (e[0] for bucket in self.buckets for e in bucket)

    def _bucket(self, digest: bytes) -> list[list]:
        return self.buckets[int.from_bytes(digest[12:20], "little") & (len(self.buckets) - 1)]

    def _entry(self, digest: bytes, n_bytes: int) -> list | None:
        return next((e for e in self._bucket(digest) if e[0] == digest and e[1] == n_bytes), None)

    def add(self, digest: bytes, n_bytes: int, row: tuple, count: int = 1) -> None:
        if digest in self.filter:
            held = self._entry(digest, n_bytes)
            if held is not None:
                if row > held[2]:
                    held[2] = row
                held[3] += count
                return
            self.false_hits += 1
        self.filter.add(digest)
        if self.count >= 4 * len(self.buckets):
            self._widen()
        self._bucket(digest).append([digest, n_bytes, row, count])
        self.count += 1

    def _widen(self) -> None:
        old = self.buckets
        self.buckets = [[] for _ in range(2 * len(old))]
        for bucket in old:
            for e in bucket:
                self._bucket(e[0]).append(e)

    def remove(self, digest: bytes, n_bytes: int) -> list | None:
        """Takes a live text out again: its entry, or None."""
        if digest not in self.filter:
            return None
        held = self._entry(digest, n_bytes)
        if held is None:
            return None
        self.filter.discard(digest)
        self._bucket(digest).remove(held)
        self.count -= 1
        return held

    def live(self) -> list[tuple[bytes, int]]:
        return [(e[0], e[1]) for bucket in self.buckets for e in bucket]

    def __len__(self) -> int:
        return self.count


GROUPS = "digest binary, n_bytes long, keep_doc long, keep_row long, size long"


def _emit(rows: list) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 5
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["digest", "n_bytes", "keep_doc", "keep_row", "size"])


def _index(in_order: bool, live: int):
    """Folds rows into groups; at most about ``live`` digests are held.

    With ``in_order`` rows come sorted by digest: those before the last one are
    complete and leave the index. Otherwise half of them leave, as partial groups.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        index = DigestIndex()

        def out(gone: list[tuple[bytes, int]]) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(gone), 50_000):
                held = [index.remove(*x) for x in gone[at : at + 50_000]]
                yield _emit([(e[0], e[1], *e[2], e[3]) for e in held])

        for b in batches:
            d, n, doc, row, size = (b.column(i).to_pylist() for i in range(5))
            for x in zip(d, n, doc, row, size):
                index.add(x[0], x[1], (x[2], x[3]), x[4])
            if len(index) > live:
                gone = index.live()
                yield from out([x for x in gone if x[0] != d[-1]] if in_order else gone[: len(gone) // 2])
        yield from out(index.live())

    return run


def exact_groups(docs: DataFrame, live: int = 200_000) -> DataFrame:
    """Groups of rows whose texts are equal after lower-casing A-Z.

    Adds to doc_id: keep_id (the greatest doc_id of the group), group_size,
    kept, text_sha256 and row_id (the row's number here). Of repeated rows that
    share the greatest doc_id exactly one is kept. Null texts equal empty ones.

    Each task folds its own rows into a live-digest index, so that a group of
    copies however large leaves one row per task; the groups are then folded by
    digest in sorted order. Only digests move, never texts.
    """
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "exact")
    low = lower_ascii(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(F.sha2(low.cast("binary"), 256)).alias("digest"),
        F.octet_length(low).cast("long").alias("n_bytes"),
    ).withColumn("row_id", F.monotonically_increasing_id())
    rows = scratch.save(rows, "rows")
    rank = F.coalesce("doc_id", F.lit(NO_ID))
    local = rows.select("digest", "n_bytes", rank.alias("keep_doc"), F.col("row_id").alias("keep_row"), F.lit(1).cast("long").alias("size")).mapInArrow(_index(False, live), GROUPS)
    groups = local.repartition(partitions(spark), "digest").sortWithinPartitions("digest").mapInArrow(_index(True, live), GROUPS)
    groups = scratch.save(groups, "groups")
    return rows.join(groups, ["digest", "n_bytes"]).select(
        "doc_id",
        F.nullif(F.col("keep_doc"), F.lit(NO_ID)).alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("row_id") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "row_id",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; one row of each group."""
    from pyspark.sql import Window

    low = lower_ascii(F.coalesce(F.col("text").cast("string"), F.lit("")))
    i, digest, n = fresh(docs, "id", "digest", "n")
    kept = exact_groups(docs).where("kept").select(F.coalesce("doc_id", F.lit(NO_ID)).alias(i), F.col("text_sha256").alias(digest))
    own = docs.select("*", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias(i), F.sha2(low.cast("binary"), 256).alias(digest))
    same = Window.partitionBy(i, digest).orderBy(F.lit(0))
    return own.join(kept, [i, digest], "left_semi").withColumn(n, F.row_number().over(same)).where(F.col(n) == 1).select(*docs.columns)
