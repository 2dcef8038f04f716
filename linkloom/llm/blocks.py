"""Documents in compressed blocks: written once, joined by block number, worked on as byte arrays.

A block holds whole documents of a few megabytes together (a longer document is
a block of its own). Operators that must come back to some texts later join
what they found to the blocks, which move compressed, instead of to documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import NO_ID, Scratch, forget, texts, trim

BLOCK_BYTES = 2 << 20

#: A block's number is its task's, 24 bits up; with 16 bits more it names a document.
BLOCK_DOCS = 60_000

SCHEMA = "block long, n_docs int, n_bytes long, doc_ids binary, ends binary, body binary"


@dataclass
class Block:
    number: int
    doc_ids: np.ndarray
    ends: np.ndarray
    bytes: np.ndarray

    @property
    def begins(self) -> np.ndarray:
        return np.concatenate([[0], self.ends[:-1]]).astype(np.int64)


def _fold(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        forget()
        number = TaskContext.get().partitionId() << 24
        codec = pa.Codec("zstd", compression_level=3)
        ids: list[int] = []
        held: list[bytes] = []
        total = 0

        def out():
            nonlocal number, ids, held, total
            ends = np.cumsum([len(x) for x in held], dtype=np.int64)
            body = codec.compress(b"".join(held), asbytes=True) if total else b""
            row = pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([len(ids)], pa.int32()), pa.array([total], pa.int64()), pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([ends.astype("<i8").tobytes()], pa.binary()), pa.array([body], pa.binary())],
                names=[x.split()[0] for x in SCHEMA.split(", ")],
            )
            number, ids, held, total = number + 1, [], [], 0
            return row

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                if held and (total + len(t) > size or len(held) == BLOCK_DOCS):
                    yield out()
                ids.append(i)
                held.append(t)
                total += len(t)
        if held:
            yield out()

    return run


def write_blocks(docs: DataFrame, scratch: Scratch, size: int = BLOCK_BYTES) -> DataFrame:
    rows = texts(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text")
    return scratch.save(rows.mapInArrow(_fold(size), SCHEMA), "blocks", codec="uncompressed")


def read_block(row: dict) -> Block:
    n = row["n_bytes"]
    body = pa.Codec("zstd").decompress(row["body"], n, asbytes=True) if n else b""
    return Block(row["block"], np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["ends"], "<i8"), np.frombuffer(body, np.uint8))


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one at a time: a row may be megabytes."""
    for b in batches:
        for i in range(b.num_rows):
            yield {n: b.column(k)[i].as_py() for k, n in enumerate(b.schema.names)}
        trim()


def binary(x: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(x, kind).tobytes()


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


#: A 64-bit value for each byte, from a fixed seed.
BYTE_VALUES = mix(mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + np.uint64(0x632BE59BD9B4E019))


def gram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the n bytes from each position on, by doubling."""
    if len(data) < n:
        return np.empty(0, np.uint64)
    h, size = BYTE_VALUES[data], 1
    while size * 2 <= n:
        h = mix(h[:-size] * np.uint64(0x9E3779B97F4A7C15) + h[size:])
        size *= 2
    if size < n:
        k = n - size
        h = mix(h[:-k] * np.uint64(0xC2B2AE3D27D4EB4F) + h[k:])
    return h


def sliding(x: np.ndarray, w: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over each run of w values."""
    size = 1
    while size * 2 <= w:
        x = pick(x[:-size], x[size:])
        size *= 2
    return pick(x[: len(x) - (w - size)], x[w - size :]) if size < w else x


def groups_of(key: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin in a sorted array."""
    if not len(key):
        return np.empty(0, np.int64)
    return np.concatenate([[0], np.nonzero(key[1:] != key[:-1])[0] + 1])
