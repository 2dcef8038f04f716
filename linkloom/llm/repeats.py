"""Suffix-array deduplication: bytes that lie in a long string seen before.

Every string of ``size`` bytes holds the smallest hash of its ``GRAM``-byte
grams, its anchor; equal strings have equal anchors at equal places. So only
suffixes that begin at anchors need to meet, and only where an anchor's gram
occurs twice: those, with the bytes around them, make the suffix arrays whose
interval trees name every later occurrence.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.blocks import BLOCK_BYTES, Block, binary, gram_hashes, groups_of, mix, read_block, rows_of, sliding, write_blocks
from linkloom.llm.common import NO_ID, Scratch, partitions, prepare, release
from linkloom.llm.suffix_tree import RepeatTree

GRAM = 50


def anchors(data: np.ndarray, ends: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions and gram hashes of the anchors of all strings of ``size`` bytes within documents, and each string's least hash (0: crosses documents)."""
    n = len(data) - size + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    h = gram_hashes(data, gram) | np.uint64(1)
    w = size - gram + 1
    least = sliding(h, w, np.minimum)
    limit = np.repeat(ends, np.diff(ends, prepend=0))[:n]
    least[np.arange(n) + size > limit] = 0  # such a string would cross documents
    pad = np.zeros(w - 1, np.uint64)
    best = sliding(np.concatenate([pad, least, pad]), w, np.maximum)
    at = np.nonzero((best == h) & (best > 0))[0]
    return at, h[at], least


def _code(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of a hash, and its next 32 bits."""
    h = mix(h)
    bucket = (h >> np.uint64(64 - bits)) if bits else np.zeros(len(h), np.uint64)
    return bucket.astype(np.int64), ((h << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)


def _split(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    begins = groups_of(bucket)
    for b, e in zip(begins, np.append(begins[1:], len(bucket))):
        yield int(bucket[b]), slice(b, e)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")))
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    cols = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), types[k]) for c, k in zip(cols, kinds)], names=list(names))


GRAMS = "bucket int, block long, codes binary"


def _grams(size: int, gram: int, bits: int):
    """Each block's distinct anchor grams by bucket; one that the block has twice is there twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            block = read_block(row)
            _, h, _ = anchors(block.bytes, block.ends, size, gram)
            bucket, code = _code(h, bits)
            key = np.sort((bucket.astype(np.uint64) << np.uint64(32)) | code)
            begins = groups_of(key)
            twice = begins[np.diff(begins, append=len(key)) > 1]
            key = np.sort(np.concatenate([key[begins], key[twice]]))
            out = [(b, block.number, binary(key[s] & np.uint64(0xFFFFFFFF), "<u4")) for b, s in _split(key >> np.uint64(32))]
            yield _batch(out, GRAMS)

    return run


FLAGS = "block long, bucket int, codes binary, hot binary"


def _repeated(hot_blocks: int):
    """For each block, those of its grams that occur again; ``hot``: in more than ``hot_blocks`` blocks."""

    def solve(bucket: int, blocks: list[int], codes: list[np.ndarray]) -> pa.RecordBatch:
        code = np.concatenate(codes)
        owner = np.repeat(np.arange(len(blocks)), [len(c) for c in codes])
        order = np.argsort(code, kind="stable")
        begins = groups_of(code[order])
        n = np.diff(begins, append=len(code))
        n_of = np.empty(len(code), np.int64)
        n_of[order] = np.repeat(n, n)
        out = []
        for i, block in enumerate(blocks):
            own = slice(*np.searchsorted(owner, [i, i + 1]))
            c, k = code[own], n_of[own]
            if (k > 1).any():
                out.append((block, bucket, binary(np.unique(c[(k > 1) & (k <= hot_blocks)]), "<u4"), binary(np.unique(c[k > hot_blocks]), "<u4")))
        return _batch(out, FLAGS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks, codes = None, [], []
        for row in rows_of(batches):
            if row["bucket"] != now:
                if blocks:
                    yield solve(now, blocks, codes)
                now, blocks, codes = row["bucket"], [], []
            blocks.append(row["block"])
            codes.append(np.frombuffer(row["codes"], "<u4"))
        if blocks:
            yield solve(now, blocks, codes)

    return run


FOUND = "kind int, bucket int, block long, n int, body binary"
#: Contexts come by their gram, or, of frequent grams, by longer strings behind or before it: an anchor is in a bucket of a kind once.
REMOVED, CONTEXTS, BEHIND, BEFORE = range(4)

#: The columns of a contexts body, before the bytes of the contexts.
HEAD = (("doc", "<i8"), ("pos", "<i8"), ("at", "<u4"), ("left", "u1"), ("right", "u1"))


def _body(head, values: dict, extra: bytes = b"") -> bytes:
    raw = b"".join([binary(values[k], kind) for k, kind in head]) + extra
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(raw, asbytes=True)


def _unbody(head, body: bytes, n: int) -> tuple[dict, np.ndarray]:
    size = int.from_bytes(body[:8], "little")
    raw = pa.Codec("zstd").decompress(body[8:], size, asbytes=True)
    out, at = {}, 0
    for k, kind in head:
        out[k] = np.frombuffer(raw, kind, n, at)
        at += out[k].nbytes
    return out, np.frombuffer(raw, np.uint8, offset=at)


def _intervals(begin: np.ndarray, end: np.ndarray) -> bytes:
    """Unions of intervals, as 32-bit begins and ends."""
    if not len(begin):
        return b""
    order = np.argsort(begin, kind="stable")
    b, e = begin[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], b[1:] > e[:-1]])
    starts = np.nonzero(new)[0]
    return binary(np.stack([b[starts], e[np.append(starts[1:], len(b)) - 1]]), "<u4")


def _first_of(keys: tuple, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the earliest row of each distinct key, and of all others."""
    order = np.lexsort((pos, doc, *keys))
    new = np.zeros(len(order), bool)
    if len(new):
        new[0] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    return order[new], order[~new]


def _line_hashes(rows: np.ndarray, extra: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of the rows of a byte matrix."""
    width = rows.shape[1]
    out = []
    for seed in (1, 2):
        r = mix(mix(np.arange(1, width + 8, dtype=np.uint64) * np.uint64(seed * 0x9E3779B97F4A7C15 & (2**64 - 1)))) | np.uint64(1)
        h = np.zeros(len(rows), np.uint64)
        for i in range(0, len(rows), 20_000):
            part = rows[i : i + 20_000]
            h[i : i + 20_000] = ((part.astype(np.uint64) + np.uint64(1)) * r[:width]).sum(axis=1, dtype=np.uint64)
        for k, x in enumerate(extra):
            h += x.astype(np.uint64) * r[width + k]
        out.append(mix(h))
    return out[0], out[1]


def _contexts(block: Block, at: np.ndarray, h: np.ndarray, least: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, place in it, left and right lengths, and bytes of the contexts of anchors.

    A context is the union of the strings whose anchor this is.
    """
    d = np.searchsorted(block.ends, at, "right")
    reach = size - gram
    left, right = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
    for lo in range(0, len(at), 20_000):
        p = slice(lo, lo + 20_000)
        start = at[p][:, None] - np.arange(reach + 1)  # strings from o = 0 on
        own = (start >= 0) & (start < len(least)) & (least[np.clip(start, 0, len(least) - 1)] == h[p][:, None])
        right[p] = size - own.argmax(axis=1)
        left[p] = reach - own[:, ::-1].argmax(axis=1)
    cols = np.arange(-reach, size)
    where = at[:, None] + cols
    ctx = block.bytes[np.clip(where, 0, len(block.bytes) - 1)]
    ctx = np.where(ctx == 0, np.uint8(0xFF), ctx)
    ctx[(cols < -left[:, None]) | (cols >= right[:, None])] = 0
    return d, at - block.begins[d], left, right, ctx


def _wanted(flags: list, name: str) -> np.ndarray:
    """The anchors' keys that a block was told of."""
    each = [(np.uint64(f["bucket"]) << np.uint64(32)) | np.frombuffer(f[name], "<u4").astype(np.uint64) for f in flags]
    return np.concatenate(each) if each else np.empty(0, np.uint64)


def _packed(kind: int, block: int, bucket: np.ndarray, values: dict, ctx: np.ndarray) -> list[tuple]:
    """Rows of contexts by bucket."""
    order = np.argsort(bucket, kind="stable")
    out = []
    for k, s in _split(bucket[order]):
        i = order[s]
        out.append((kind, k, block, len(i), _body(HEAD, {c: v[i] for c, v in values.items()}, ctx[i].tobytes())))
    return out


def _longer(size: int, gram: int) -> tuple[int, int]:
    """Bytes from an anchor on, and before it, of the longer keys: a window has the one or the other."""
    behind = gram + (size - gram) // 2
    return behind, size - behind + 1


def _longer_keys(ctx: np.ndarray, left: np.ndarray, right: np.ndarray, size: int, gram: int, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Contexts of frequent grams and their buckets by longer strings: half of what a window has beside the gram, behind the gram or before it.

    Any two contexts that share a window meet in one of the two.
    """
    reach = size - gram
    behind, before = _longer(size, gram)
    for kind, need, lo, hi, have in ((BEHIND, behind, reach, reach + behind, right), (BEFORE, before, reach - before, reach + gram, left)):
        i = np.nonzero(have >= need)[0]
        if len(i):
            a, _ = _line_hashes(ctx[i, lo:hi], ())
            yield kind, i, _code(a, bits)[0]


def _gather(size: int, gram: int, bits: int, hot: bool = False, every: bool = False):
    """The contexts of a block's flagged anchors: the first of each different one goes on, the others are covered by it.

    ``hot``: those of grams in very many blocks, by longer keys. ``every``: all
    go on, for groups with all their occurrences.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            block = read_block(row)
            at, h, least = anchors(block.bytes, block.ends, size, gram)
            bucket, code = _code(h, bits)
            keep = np.isin((bucket.astype(np.uint64) << np.uint64(32)) | code, _wanted(row["flags"], "hot" if hot else "codes"))
            at, h, bucket = at[keep], h[keep], bucket[keep]
            out, gone = [], []
            for lo in range(0, len(at), 100_000):
                part = slice(lo, lo + 100_000)
                out += _one(block, at[part], h[part], least, bucket[part], gone)
            begin, end = (np.concatenate(x) for x in zip(*gone)) if gone else (np.empty(0, np.int64),) * 2
            out.append((REMOVED, block.number & 0x3FFFFFFF, block.number, 0, _intervals(begin, end)))
            yield _batch(out, FOUND)

    def _one(block, at, h, least, bucket, gone) -> list:
        d, pos, left, right, ctx = _contexts(block, at, h, least, size, gram)
        doc = block.doc_ids[d]
        first = np.arange(len(at))
        if not every:
            a, b = _line_hashes(ctx, (left, right))
            first, other = _first_of((a, b), doc, pos)
            gone.append((at[other] - left[other], at[other] + right[other]))
        values = {"doc": doc[first], "pos": pos[first], "at": at[first], "left": left[first], "right": right[first]}
        ctx, bucket = ctx[first], bucket[first]
        if not hot:
            return _packed(CONTEXTS, block.number, bucket, values, ctx)
        out = []
        for kind, i, to in _longer_keys(ctx, values["left"], values["right"], size, gram, bits):
            out += _packed(kind, block.number, to, {c: v[i] for c, v in values.items()}, ctx[i])
        return out

    return run


def _unpacked(rows: list[dict], width: int) -> tuple[dict, np.ndarray, np.ndarray]:
    """Columns and bytes of the contexts of some rows, and the row of each."""
    parts = [_unbody(HEAD, r["body"], r["n"]) for r in rows]
    v = {k: np.concatenate([p[0][k] for p in parts]) for k, _ in HEAD}
    return v, np.concatenate([p[1] for p in parts]).reshape(-1, width), np.repeat(np.arange(len(rows)), [r["n"] for r in rows])


def _by(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[tuple, list[dict]]]:
    """Runs of rows with equal values of these columns."""
    now, held = None, []
    for row in rows_of(batches):
        key = tuple(row[n] for n in names)
        if key != now:
            if held:
                yield now, held
            now, held = key, []
        held.append(row)
    if held:
        yield now, held


def _covered(held: list[dict], number: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[tuple]:
    """(block, intervals) of what was found in the rows of these numbers."""
    order = np.argsort(number, kind="stable")
    return [(held[k]["block"], _intervals(begin[order[s]], end[order[s]])) for k, s in _split(number[order])]


def _thin(size: int, gram: int):
    """Of equal contexts of some blocks the first goes on, the others are covered: a frequent gram's contexts before they meet in one bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (kind, bucket, _), held in _by(batches, "kind", "bucket", "batch"):
            if kind == REMOVED:
                yield _batch([(r["kind"], r["bucket"], r["block"], r["n"], r["body"]) for r in held], FOUND)
                continue
            v, ctx, number = _unpacked(held, 2 * size - gram)
            a, b = _line_hashes(ctx, (v["left"], v["right"]))
            first, other = _first_of((a, b), v["doc"], v["pos"])
            at = v["at"].astype(np.int64)[other]
            out = [(REMOVED, block & 0x3FFFFFFF, block, 0, x) for block, x in _covered(held, number[other], at - v["left"][other], at + v["right"][other])]
            first = first[np.argsort(number[first], kind="stable")]
            for k, s in _split(number[first]):
                i = first[s]
                out += _packed(kind, held[k]["block"], np.full(len(i), bucket), {c: x[i] for c, x in v.items()}, ctx[i])
            yield _batch(out, FOUND)

    return run


GONE = "block long, body binary"


def _tree(v: dict, ctx: np.ndarray, size: int, gram: int) -> RepeatTree:
    reach = size - gram
    left, right = v["left"].astype(np.int64), v["right"].astype(np.int64)
    return RepeatTree(np.ascontiguousarray(ctx[:, reach:]), right, np.ascontiguousarray(ctx[:, reach - 1 :: -1] if reach else ctx[:, :0]), left, gram)


def _solve(size: int, gram: int):
    """Buckets of contexts to intervals that an earlier occurrence covers."""
    reach = size - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (kind, _), held in _by(batches, "kind", "bucket"):
            if kind == REMOVED:
                yield _batch([(r["block"], r["body"]) for r in held], GONE)
                continue
            v, ctx, number = _unpacked(held, reach + size)
            rank = np.empty(len(ctx), np.int64)
            rank[np.lexsort((number, v["pos"], v["doc"]))] = np.arange(len(ctx))
            found = _tree(v, ctx, size, gram).repeated_windows(size, rank)
            hit = np.nonzero(found.any(axis=1))[0]
            low = found[hit].argmax(axis=1)
            high = reach - found[hit][:, ::-1].argmax(axis=1)
            at = v["at"].astype(np.int64)[hit]
            yield _batch(_covered(held, number[hit], at - high, at - low + size), GONE)

    return run


GROUPS = "repeat long, length long, doc_id long, start long"


def _groups(size: int, gram: int):
    """Buckets of contexts to groups of maximal repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name = TaskContext.get().partitionId() << 40
        for (kind, _), held in _by(batches, "kind", "bucket"):
            if kind == REMOVED:
                continue
            v, ctx, _ = _unpacked(held, 2 * size - gram)
            behind, before = _longer(size, gram)
            for left, right, starts, members in _tree(v, ctx, size, gram).maximal_repeats(size):
                # by a longer key only strings that have it: their occurrences are all here
                whole = {CONTEXTS: right >= 0, BEHIND: right >= behind, BEFORE: (left >= before) & (right < behind)}[kind]
                n = np.diff(starts, append=len(members))
                left, right, members, n = left[whole], right[whole], members[np.repeat(whole, n)], n[whole]
                starts = np.cumsum(n) - n
                group = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(members)))
                cols = [name + group, (left + right)[group], v["doc"][members], v["pos"][members] - left[group]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[x.split()[0] for x in GROUPS.split(", ")])
                name += len(starts)

    return run


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            block = read_block(row)
            n = len(block.bytes)
            step = np.zeros(n + 1, np.int32)
            for body in row["gone"] or ():
                b, e = np.frombuffer(body, "<u4").reshape(2, -1)
                np.add.at(step, b, 1)
                np.add.at(step, e, -1)
            cut = np.cumsum(step[:n]) > 0
            rows = []
            for doc, s, e in zip(block.doc_ids.tolist(), block.begins.tolist(), block.ends.tolist()):
                own = cut[s:e]
                removed = int(own.sum())
                spans = int(own[0]) + int((own[1:] & ~own[:-1]).sum()) if removed else 0
                kept = block.bytes[s:e][~own].tobytes() if removed else block.bytes[s:e].tobytes()
                rows.append((doc, e - s, removed, spans, hashlib.sha256(kept).hexdigest(), *([kept] if keep_text else [])))
            yield _batch(rows, RESULT + (", kept binary" if keep_text else ""))

    return run


#: Blocks whose equal contexts of a frequent gram are told apart together.
TOGETHER = 4096


def _flagged(docs: DataFrame, scratch: Scratch, size: int, gram: int, hot_blocks: int, block_bytes: int) -> tuple[DataFrame, DataFrame, int]:
    """Blocks, their repeated anchors, and the bits of a bucket's number."""
    blocks = write_blocks(docs, scratch, block_bytes)
    total = blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).head()[0]
    bits = max(0, min(30, (int(total) // (4 << 20)).bit_length()))
    grams = blocks.mapInArrow(_grams(size, gram, bits), GRAMS)
    flags = grams.repartition(partitions(docs.sparkSession), "bucket").sortWithinPartitions("bucket").mapInArrow(_repeated(hot_blocks), FLAGS)
    flags = scratch.save(flags.groupBy("block").agg(F.collect_list(F.struct("bucket", "codes", "hot")).alias("flags")), "flags", codec="uncompressed")
    release(docs.sparkSession)
    return blocks, flags, bits


def _found(blocks: DataFrame, flags: DataFrame, size: int, gram: int, bits: int, every: bool = False) -> DataFrame:
    """Contexts by bucket, and what is covered already."""
    found = blocks.join(flags.hint("merge"), "block").mapInArrow(_gather(size, gram, bits, every=every), FOUND)
    hot = flags.where(F.exists("flags", lambda f: F.length(f["hot"]) > 0))
    if hot.take(1):
        more = blocks.join(hot.hint("merge"), "block").mapInArrow(_gather(size, gram, bits, hot=True, every=every), FOUND)
        if not every:
            groups = F.pmod(F.xxhash64("block"), F.lit(max(1, blocks.count() // TOGETHER))).cast("int")
            more = more.withColumn("batch", groups).repartition(partitions(blocks.sparkSession), "bucket", "batch").sortWithinPartitions("kind", "bucket", "batch").mapInArrow(_thin(size, gram), FOUND)
        found = found.unionByName(more)
    return found.repartition(partitions(blocks.sparkSession), "bucket").sortWithinPartitions("bucket", "kind")


def maximal_repeats(docs: DataFrame, size: int = 100, gram: int = GRAM, hot_blocks: int = 256, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Groups of maximal repeats of ``size`` bytes or more: repeat (the group), length, and doc_id and start (byte) of each occurrence.

    All occurrences of a group are there, and no byte before or after its string
    is common to all of them, as far as contexts reach: from size - gram bytes
    before an anchor to size behind it. A longer repeat is a chain of groups, one
    for each of its anchors, that overlap. A string may come up by two anchors.
    """
    spark = docs.sparkSession
    prepare(spark)
    blocks, flags, bits = _flagged(docs, Scratch(spark, "maximal-repeats"), size, gram, hot_blocks, block_bytes)
    groups = _found(blocks, flags, size, gram, bits, every=True).mapInArrow(_groups(size, gram), GROUPS)
    return groups.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def drop_repeats(docs: DataFrame, size: int = 100, gram: int = GRAM, hot_blocks: int = 256, block_bytes: int = BLOCK_BYTES, keep_text: bool = False) -> DataFrame:
    """Removes each byte of a ``size``-byte string that also starts earlier; one row for each row of ``docs``.

    Earlier: in a document of smaller doc_id, or further ahead in the same one
    (rows that share a doc_id count in the order they are read). Matches never
    cross documents; occurrences may overlap. Returns doc_id, n_bytes,
    n_removed, n_spans (maximal removed runs), kept_sha256 and, with
    ``keep_text``, the kept bytes (a cut may fall inside a character).

    Three rounds over compressed blocks: which anchor grams occur twice; the
    contexts of those, one for each different context and block, through
    interval trees by bucket, whose groups of maximal repeats cover all members
    but the first; the removal. The contexts of a gram in more than
    ``hot_blocks`` blocks go by longer strings to more buckets, and equal ones of
    some thousand blocks become one before that; they pass the same trees.
    """
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "repeats")
    blocks, flags, bits = _flagged(docs, scratch, size, gram, hot_blocks, block_bytes)
    found = _found(blocks, flags, size, gram, bits)
    gone = found.mapInArrow(_solve(size, gram), GONE).groupBy("block").agg(F.collect_list("body").alias("gone"))
    gone = scratch.save(gone, "gone", codec="uncompressed")
    del flags, found
    scratch.drop("flags")
    release(spark)
    schema = RESULT + (", kept binary" if keep_text else "")
    cut = blocks.join(gone.hint("merge"), "block", "left").mapInArrow(_cut(keep_text), schema)
    return cut.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))
