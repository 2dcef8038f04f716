"""Multi-length packing: context tiers, gaps filled from shorter tiers, balanced steps."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import prepare, texts, trim
from linkloom.llm.vocab import word_ids

#: Context sizes, all powers of two; the last is the longest sequence.
TIERS = (256, 512, 1024, 2048)

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class Pool:
    """Pieces of one tier by length: the longest that fits, or any to cut."""

    def __init__(self) -> None:
        self.items: list[tuple[int, int, int]] = []  # length, document, start

    def put(self, item: tuple[int, int, int]) -> None:
        bisect.insort(self.items, item)

    def longest_within(self, room: int) -> tuple[int, int, int] | None:
        i = bisect.bisect_right(self.items, (room, 1 << 62, 1 << 62))
        return self.items.pop(i - 1) if i else None


class Packer:
    """Packs the documents of one block; a sequence is a list of (document, start, length)."""

    def __init__(self, tiers: tuple[int, ...] = TIERS) -> None:
        self.tiers = tiers
        self.pools = [Pool() for _ in tiers]
        self.done: list[tuple[int, list[tuple[int, int, int]]]] = []

    def route(self, length: int) -> int:
        return bisect.bisect_left(self.tiers, length)

    def add(self, doc: int, length: int) -> None:
        longest, start = self.tiers[-1], 0
        while length - start >= longest:
            self.done.append((longest, [(doc, start, longest)]))
            start += longest
        if length > start:
            self._put(doc, start, length - start)

    def _put(self, doc: int, start: int, length: int) -> None:
        self.pools[self.route(length)].put((length, doc, start))

    def _fill(self, room: int, upto: int) -> list[tuple[int, int, int]]:
        """Whole pieces of the tiers up to ``upto``, longest first; then one is cut to close the gap."""
        got = []
        while room:
            for k in range(min(upto, self.route(room)), -1, -1):
                if (p := self.pools[k].longest_within(room)) is not None:
                    got.append((p[1], p[2], p[0]))
                    room -= p[0]
                    break
            else:
                k = next((k for k in range(upto + 1) if self.pools[k].items), None)
                if k is None:
                    return got
                n, doc, start = self.pools[k].items.pop(0)  # longer than the room
                got.append((doc, start, room))
                self._put(doc, start + room, n - room)
                room = 0
        return got

    def finish(self) -> list[tuple[int, list[tuple[int, int, int]]]]:
        """Tiers from the longest down; what does not fill a window becomes windows of smaller powers of two."""
        for k in range(len(self.tiers) - 1, -1, -1):
            while self.pools[k].items:
                n, doc, start = self.pools[k].items.pop()
                pieces = [(doc, start, n), *self._fill(self.tiers[k] - n, k)]
                used = sum(p[2] for p in pieces)
                if used == self.tiers[k]:
                    self.done.append((used, pieces))
                else:
                    self._cut(used, pieces)
        return self.done

    def _cut(self, used: int, pieces: list[tuple[int, int, int]]) -> None:
        rest = list(reversed(pieces))
        for bit in range(used.bit_length() - 1, -1, -1):
            room = used & (1 << bit)
            if not room:
                continue
            window = []
            size = room
            while room:
                doc, start, n = rest.pop()
                take = min(n, room)
                window.append((doc, start, take))
                room -= take
                if n > take:
                    rest.append((doc, start + take, n - take))
            self.done.append((size, window))


def step_groups(sizes: list[int], tokens: int) -> list[int]:
    """Deals sequences, longest first, to steps: each to the step with the fewest tokens so far."""
    import heapq

    n = max(1, round(sum(sizes) / tokens))
    heap = [(0, g) for g in range(n)]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        had, g = heapq.heappop(heap)
        out[i] = g
        heapq.heappush(heap, (had + sizes[i], g))
    return out


def _pack(vocab: str, end_id: int, block: int, step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        trim()
        words = word_ids(vocab)
        base = TaskContext.get().partitionId() << 32
        sequences = groups = 0
        held: list[tuple[int | None, np.ndarray]] = []
        tokens = 0

        def flush():
            nonlocal sequences, groups
            packer = Packer()
            for i, (_, ids) in enumerate(held):
                packer.add(i, len(ids))
            done = packer.finish()
            steps = step_groups([n for n, _ in done], step)
            cols: list[list] = [[] for _ in range(9)]
            size = 0
            for (tier, pieces), g in zip(done, steps):
                at = 0
                for doc, start, n in pieces:
                    doc_id, ids = held[doc]
                    row = (doc_id, start, n, ids[start : start + n].astype("<u4").tobytes(), len(ids), base + sequences, at, tier, base + groups + g)
                    for c, v in zip(cols, row):
                        c.append(v)
                    at += n
                size += 4 * tier
                sequences += 1
                if size > 4 << 20:
                    yield _rows(cols)
                    cols, size = [[] for _ in range(9)], 0
            groups += max(steps, default=-1) + 1
            yield _rows(cols)

        for b in batches:
            ids, n = words.flat(b.column(0).to_pylist(), end_id)
            for doc_id, own in zip(b.column(1).to_pylist(), np.split(ids, np.cumsum(n)[:-1])):
                held.append((doc_id, own))
                tokens += len(own)
            if tokens >= block:
                yield from flush()
                held, tokens = [], 0
            trim()
        yield from flush()
        held.clear()
        trim()

    return run


def _rows(cols: list[list]) -> pa.RecordBatch:
    i, b = pa.int64(), pa.binary()
    kinds = [i, i, i, b, i, i, i, pa.int32(), i]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


def pack(docs: DataFrame, vocab: str = "word_bpe_49k.json", end_id: int = 1, block: int = 4_000_000, step: int = 65_536) -> DataFrame:
    """Packs all documents into sequences of at most 2048 tokens; one row for each piece.

    A document is its ids and ``end_id``. Whole windows come off long documents
    first; what remains goes to the smallest tier that holds it. Tiers are
    packed from the longest down: a window's gap takes whole pieces of its own
    and shorter tiers, and one piece is cut to close it. The last, part-filled
    windows are cut to smaller powers of two, so no sequence needs padding.
    ``step_group`` deals the sequences of a block to steps of about ``step``
    tokens, longest first, each to the step with the fewest tokens so far.

    Packing happens where the texts are read, in blocks of about ``block``
    tokens: nothing is shuffled and memory is bounded by a block, an Arrow batch
    and the ids of the longest document (two bytes a token; its text is cut into
    words in slices). sequence_id holds the task in its upper half. ids are
    little-endian unsigned 32-bit integers. Repeated rows are packed each.
    """
    prepare(docs.sparkSession)
    return texts(docs).select("text", "doc_id").mapInArrow(_pack(vocab, end_id, block, step), SCHEMA)


def digest(pieces: DataFrame) -> DataFrame:
    """A checksum in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")
