"""Near duplicates by Jaccard similarity of word n-grams: token-combination prefixes, then verification.

With all tokens in one order, two sets whose overlap is at least c share their
k smallest common tokens within their first n - c + k tokens each. Rare tokens
come first in the order and are indexed one by one (k = 1). Frequent tokens are
indexed two by two (k = 2), from prefixes one token longer: where the smallest
common token is frequent, so is the second.

Pairs grow with the square of a prefix, so long sets are parted by a hash of
their tokens into as many parts as their size asks for: of two sets with a
similarity of t, one pair of parts has a similarity of t or more, since the
whole's ratio lies between those of its parts. Prefixes are taken of each part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.blocks import BLOCK_BYTES, BYTE_VALUES, Block, binary, groups_of, mix, read_block, rows_of, write_blocks
from linkloom.llm.common import NO_ID, Scratch, fresh, partitions, prepare, release
from linkloom.llm.components import Forest, components

#: Cells of the token histogram by which two sets' overlap is bounded from above.
CELLS = 16

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

BASE = np.uint64(0x9E3779B97F4A7C15)
C1, C2, C3 = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5)


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


def word_hashes(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word (bytes between \\x20 and \\x09-\\x0D, A-Z lowered), and its document."""
    data = LOWER[block.bytes]
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    word = (data != 32) & ((data < 9) | (data > 13))
    edge = np.zeros(n + 1, bool)
    edge[block.ends] = True
    edge[0] = True
    before = np.concatenate([[False], word[:-1]])
    begin = np.nonzero(word & (~before | edge[:-1]))[0]
    after = np.concatenate([word[1:], [False]])
    end = np.nonzero(word & (~after | edge[1:]))[0] + 1
    powers = np.full(n, BASE, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_VALUES[data] * powers, dtype=np.uint64)])
    down = np.full(n, np.uint64(_inverse(int(BASE))), np.uint64)
    down[0] = 1
    down = np.cumprod(down, dtype=np.uint64)
    h = (sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64) * C3
    return mix(h), np.searchsorted(block.ends, begin, "right")


def shingle_sets(block: Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """All documents' sets, one after the other and each in order, and where each ends.

    A document of fewer words than ``size`` has its whole sequence as one
    shingle, one without words the empty set.
    """
    words, doc = word_hashes(block)
    docs = len(block.ends)
    count = np.bincount(doc, minlength=docs)
    first = np.cumsum(count) - count
    k = len(words) - size + 1
    if k > 0:
        h = np.zeros(k, np.uint64)
        for i in range(size):
            h = mix(h * C1 + words[i : i + k])
        inside = doc[:k] == doc[size - 1 :]
        h, owner = h[inside], doc[:k][inside]
    else:
        h, owner = np.empty(0, np.uint64), np.empty(0, np.int64)
    ends_of = np.searchsorted(owner, np.arange(docs), "right")
    sets, ends, total = [], np.empty(docs, np.int64), 0
    begin = 0
    for d in range(docs):
        if 0 < count[d] < size:
            x = np.zeros(1, np.uint64) + C2 * np.uint64(count[d])
            for w in words[first[d] : first[d] + count[d]]:
                x = mix(x * C1 + w)
        else:
            x = np.sort(h[begin : ends_of[d]])
            if len(x):
                x = x[np.concatenate([[True], x[1:] != x[:-1]])]
        begin = ends_of[d]
        sets.append(x)
        total += len(x)
        ends[d] = total
    return (np.concatenate(sets) if sets else np.empty(0, np.uint64)), ends


@dataclass
class Sets:
    """A block's sets: tokens of all documents, where each one's end, and for each document the first of the block with its set."""

    tokens: np.ndarray
    ends: np.ndarray
    same: np.ndarray
    digests: tuple[np.ndarray, np.ndarray]

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.ends, prepend=0)

    def of(self, d: int) -> np.ndarray:
        return self.tokens[self.ends[d - 1] if d else 0 : self.ends[d]]


def block_sets(block: Block, size: int) -> Sets:
    tokens, ends = shingle_sets(block, size)
    n = np.diff(ends, prepend=0)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tokens * C2), dtype=np.uint64)])
    more = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tokens + C3), dtype=np.uint64)])
    begins = ends - n
    a, b = sums[ends] - sums[begins], more[ends] - more[begins]
    order = np.lexsort((np.arange(len(n)), b, a, n))
    new = np.ones(len(n), bool)
    for x in (n, a, b):
        x = x[order]
        if len(x):
            new[1:] &= x[1:] == x[:-1]
    new[1:] = ~new[1:]
    same = np.empty(len(n), np.int64)
    same[order] = order[np.nonzero(new)[0]][np.cumsum(new) - 1] if len(n) else []
    same[n == 0] = np.nonzero(n == 0)[0]  # empty sets equal nothing
    return Sets(tokens, ends, same, (a, b))


PROFILE = "block long, doc_ids binary, sizes binary, same binary, first binary, second binary"


def _profile(size: int):
    """Each block's set sizes and equal sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            block = read_block(row)
            s = block_sets(block, size)
            values = [block.number, row["doc_ids"], binary(s.sizes, "<u4"), binary(s.same, "<u2"), *[binary(x, "<u8") for x in s.digests]]
            kinds = [pa.int64()] + [pa.binary()] * 5
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=[x.split()[0] for x in PROFILE.split(", ")])

    return run


COUNTS = "bucket int, block long, codes binary, counts binary"

#: Bits of a token's code beside its bucket's. Two tokens of one code share a
#: class, which costs time where it happens and changes no result.
CODE_BITS = 24


def token_codes(tokens: np.ndarray, bits: int) -> np.ndarray:
    return mix(tokens * C1 + C2) >> np.uint64(64 - bits - CODE_BITS)


def three_bytes(code: np.ndarray) -> bytes:
    return np.ascontiguousarray(code.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]).tobytes()


def from_three(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 3, 4), np.uint8)
    out[:, :3] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
    return out.view("<u4").ravel()


def _token_counts(size: int, bits: int):
    """By bucket, the codes of a block's tokens and how many of its different sets have each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            block = read_block(row)
            s = block_sets(block, size)
            own = np.repeat(s.same == np.arange(len(s.same)), s.sizes)
            code = np.sort(token_codes(s.tokens[own], bits))
            begins = groups_of(code)
            n = np.minimum(np.diff(begins, append=len(code)), 255).astype(np.uint8)
            code = code[begins]
            bucket = (code >> np.uint64(CODE_BITS)).astype(np.int64)
            at = groups_of(bucket)
            low = code & np.uint64((1 << CODE_BITS) - 1)
            out = [(int(bucket[x]), block.number, three_bytes(low[x:y]), n[x:y].tobytes()) for x, y in zip(at, np.append(at[1:], len(code)))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=[x.split()[0] for x in COUNTS.split(", ")])

    return run


FLAGS = "block long, bucket int, codes binary, often binary"

#: Classes of tokens, in their order: of one set alone, of several, of many.
ALONE, SHARED, FREQUENT = range(3)


def _shared(least: int):
    """For each block, those of its codes that other sets have, too, and whether at least ``least`` of all blocks do."""

    def solve(held: list[dict]) -> pa.RecordBatch:
        codes = [from_three(r["codes"]) for r in held]
        code, where = np.unique(np.concatenate(codes), return_inverse=True)
        total = np.bincount(where, np.concatenate([np.frombuffer(r["counts"], np.uint8) for r in held]))
        total = total[where]
        out, at = [], 0
        for r, c in zip(held, codes):
            mine = total[at : at + len(c)]
            at += len(c)
            k = mine > 1
            if k.any():
                out.append((r["block"], r["bucket"], three_bytes(c[k]), np.packbits(mine[k] >= least).tobytes()))
        cols = list(zip(*out)) if out else [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["block", "bucket", "codes", "often"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for row in rows_of(batches):
            if row["bucket"] != now:
                if held:
                    yield solve(held)
                now, held = row["bucket"], []
            held.append(row)
        if held:
            yield solve(held)

    return run


KEYS = "unit long, block long, n int, body binary"

#: A key's unit is its bucket and a size class of its holders.
CLASSES = 64


def prefix_keys(tokens: np.ndarray, kind: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of one set: its rare prefix tokens, and its frequent ones two by two.

    tokens in ascending order, ``kind`` their classes, ``need`` the least overlap
    c. Tokens of this set alone come first in the order and are no keys. Where an
    overlap of one token may do, frequent tokens are keys by themselves, too.
    """
    n = len(tokens)
    prefix = n - need + 1
    alone = int((kind == ALONE).sum())
    rare, often = tokens[kind == SHARED], tokens[kind == FREQUENT]
    one = rare[: max(0, prefix - alone)]
    before = alone + len(rare)
    if need < 2 and before < prefix:
        one = np.concatenate([one, often[: prefix - before]])
    two = np.empty(0, np.uint64)
    if before <= prefix and n > 1:
        o = often[: prefix + 1 - before]
        i, j = np.triu_indices(len(o), 1)
        two = mix(mix(o[i] * C1) + o[j] * C2)
    return one, two


def parts_for(n: int, most: int) -> int:
    """Parts of a set of n tokens, a power of two, such that about ``most`` are in each."""
    return 1 << max(0, -(-n // most) - 1).bit_length()


def set_keys(tokens: np.ndarray, kind: np.ndarray, num: int, den: int, most: int) -> list[np.ndarray]:
    """Keys of a set's parts, for each number of parts that a partner's size may ask for."""
    n = len(tokens)
    out = []
    m = parts_for(-(-n * num // den), most)
    while m <= parts_for(n * den // num, most):
        if m == 1:
            parts = [(tokens, kind)]
        else:
            where = (mix(tokens * C3 + C1) & np.uint64(m - 1)).astype(np.int64)
            order = np.argsort(where, kind="stable")
            cuts = np.searchsorted(where[order], np.arange(1, m))
            parts = list(zip(np.split(tokens[order], cuts), np.split(kind[order], cuts)))
        salt = np.full(1, m, np.uint64) * C2
        for own, often in parts:
            if len(own):
                out += [k + salt for k in prefix_keys(own, often, -(-len(own) * num // den)) if len(k)]
        m *= 2
    return out


def size_class(n: np.ndarray) -> np.ndarray:
    """Sizes from one power of two to the next."""
    return np.frexp(n.astype(np.float64))[1] - 1


def _kinds(codes: np.ndarray, flags: list) -> np.ndarray:
    """The classes of tokens by what their block was told."""
    out = np.full(len(codes), ALONE, np.int8)
    if flags:
        known = [(np.uint64(f["bucket"]) << np.uint64(CODE_BITS)) | from_three(f["codes"]) for f in flags]
        often = [np.unpackbits(np.frombuffer(f["often"], np.uint8), count=len(k)) for f, k in zip(flags, known)]
        known, often = np.concatenate(known), np.concatenate(often)
        order = np.argsort(known)
        known, often = known[order], often[order]
        at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
        hit = known[at] == codes
        out[hit] = SHARED + often[at[hit]]
    return out


def _keys(size: int, num: int, den: int, most: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            block = read_block(row)
            s = block_sets(block, size)
            n = s.sizes
            kind = _kinds(token_codes(s.tokens, bits), row["flags"] or ())
            owner = np.repeat(np.arange(len(n)), n)
            cells = np.bincount(owner * CELLS + (s.tokens & np.uint64(CELLS - 1)).astype(np.int64), minlength=len(n) * CELLS)
            cells = np.minimum(cells, 255).astype(np.uint8).reshape(-1, CELLS)
            mine = (s.same == np.arange(len(n))) & (n > 0)
            mine[row["copies"] or []] = False
            keys, docs = [], []
            for d in np.nonzero(mine)[0].tolist():
                b, e = s.ends[d] - n[d], s.ends[d]
                own = set_keys(s.tokens[b:e], kind[b:e], num, den, most)
                keys += own
                docs.append(np.full(sum(map(len, own)), d))
            if not keys:
                continue
            h = mix(np.concatenate(keys) + C2)
            d = np.concatenate(docs)
            bucket = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
            code = ((h << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
            # a set meets partners of its own size class, and in the class below those that may be smaller
            own_class, low_class = size_class(n[d]), size_class(-(-n[d] * num // den))
            lower = np.nonzero(low_class < own_class)[0]
            unit = np.concatenate([bucket * CLASSES + own_class, bucket[lower] * CLASSES + low_class[lower]])
            at = np.concatenate([np.arange(len(h)), lower])
            order = np.argsort(unit, kind="stable")
            out = []
            begins = groups_of(unit[order])
            for x, y in zip(begins, np.append(begins[1:], len(order))):
                i = at[order[x:y]]
                own = d[i]
                body = b"".join([binary(code[i], "<u4"), binary(own, "<u2"), binary(n[own], "<u4"), cells[own].tobytes()])
                out.append((int(unit[order[x]]), block.number, len(i), body))
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["unit", "block", "n", "body"])

    return run


def may_link(n1, c1, n2, c2, num: int, den: int) -> np.ndarray:
    """Whether sets of these sizes and histograms can be similar enough; broadcasts over rows."""
    least, most = np.minimum(n1, n2), np.maximum(n1, n2)
    bound = np.minimum(c1, c2).sum(axis=-1, dtype=np.int64)
    full = ((c1 == 255) & (c2 == 255)).any(axis=-1)
    bound = np.where(full, least, bound)
    return (den * least >= num * most) & (den * bound >= num * (n1 + n2 - bound))


def _candidates(num: int, den: int):
    """Stars of documents that share a key and may be similar, from buckets of keys."""

    def solve(rows: list[dict]) -> np.ndarray:
        code, own, n, cells, block = [], [], [], [], []
        for r in rows:
            k, body = r["n"], r["body"]
            code.append(np.frombuffer(body, "<u4", k))
            own.append(np.frombuffer(body, "<u2", k, 4 * k))
            n.append(np.frombuffer(body, "<u4", k, 6 * k))
            cells.append(np.frombuffer(body, np.uint8, CELLS * k, 10 * k).reshape(k, CELLS))
            block.append(np.full(k, r["block"], np.int64))
        code, n, cells = np.concatenate(code), np.concatenate(n).astype(np.int64), np.concatenate(cells)
        place = (np.concatenate(block) << 16) | np.concatenate(own)
        order = np.lexsort((n, code))
        sizes = np.diff(groups_of(code[order]), append=len(order))
        order = order[np.repeat(sizes > 1, sizes)]
        sizes = sizes[sizes > 1]
        code, n, cells, place = code[order], n[order], cells[order], place[order]
        begins = np.cumsum(sizes) - sizes
        out = []
        small = np.repeat(sizes <= 8, sizes)
        for d in range(1, 8):
            i = np.nonzero(small[:-d] & (code[d:] == code[:-d]))[0]
            i = i[may_link(n[i], cells[i], n[i + d], cells[i + d], num, den)]
            out.append(np.stack([place[i], place[i + d]], axis=1))
        for b, k in zip(begins[sizes > 8].tolist(), sizes[sizes > 8].tolist()):
            out.append(reach(place[b : b + k], n[b : b + k], cells[b : b + k]))
        out = np.concatenate(out) if out else np.empty((0, 2), np.int64)
        return np.unique(out[out[:, 0] != out[:, 1]], axis=0)

    def reach(place, n, cells) -> np.ndarray:
        """From one document of a bucket to all it may reach: each step asks only those not yet reached."""
        left = np.arange(len(place))
        out = []
        while len(left):
            root, left, queue = left[0], left[1:], [left[0]]
            while queue and len(left):
                x = queue.pop()
                hit = may_link(n[x], cells[x], n[left], cells[left], num, den)
                got = left[hit]
                if len(got):
                    left = left[~hit]
                    queue.extend(got.tolist())
                    out.append(np.stack([np.full(len(got), place[root]), place[got]], axis=1))
        return np.concatenate(out) if out else np.empty((0, 2), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, now, held = Forest(), None, []

        def take():
            for x, y in solve(held).tolist():
                forest.union(x, y)

        for row in rows_of(batches):
            if row["task"] != now:
                if held:
                    take()
                now, held = row["task"], []
                if len(forest.parent) > 500_000:
                    yield forest.stars()
                    forest.parent.clear()
            held.append(row)
        if held:
            take()
        yield forest.stars()

    return run


def dealt(rows: DataFrame, unit: str, parts: Column, by: Column) -> DataFrame:
    """Adds task: the unit itself, or for a unit of several ``parts`` each pair of parts that a row's own is one of; own, other."""
    own = F.pmod(F.xxhash64(by), parts).cast("int")
    out = rows.select("*", own.alias("own"), parts.alias("parts")).select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    task = F.when(F.col("parts") == 1, F.col(unit)).otherwise(F.xxhash64(unit, F.least("own", "other"), F.greatest("own", "other")))
    return out.withColumn("task", task)


HISTOGRAMS = "grp long, place long, n int, cells binary"

#: Cells of the finer histogram that parts long documents, too.
FINE = 512


def _histograms(size: int):
    """The finer histograms of a block's candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            block = read_block(row)
            s = block_sets(block, size)
            out = []
            for w in row["wanted"]:
                tokens = s.of(w["place"] & 0xFFFF)
                cells = np.bincount((tokens & np.uint64(FINE - 1)).astype(np.int64), minlength=FINE)
                out.append((w["grp"], w["place"], len(tokens), np.minimum(cells, 255).astype(np.uint8).tobytes()))
            for i in range(0, len(out), 5000):
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out[i : i + 5000]), (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["grp", "place", "n", "cells"])

    return run


def _refine(num: int, den: int):
    """Stars of candidates that the finer bounds leave together; what stands alone goes."""

    def solve(places: list[int], sizes: list[int], cells: list[bytes]) -> pa.RecordBatch:
        order = np.argsort(np.array(sizes), kind="stable")
        place, n = np.array(places, np.int64)[order], np.array(sizes, np.int64)[order]
        grid = np.frombuffer(b"".join(cells), np.uint8).reshape(-1, FINE)[order]
        low = np.searchsorted(n, -(-n * num // den))
        high = np.searchsorted(n, n * den // num, "right")
        left = np.ones(len(n), bool)
        out_a, out_b = [], []
        for root in range(len(n)):
            if not left[root]:
                continue
            left[root] = False
            group, queue = [root], [root]
            while queue:
                x = queue.pop()
                near = np.arange(low[x], high[x])[left[low[x] : high[x]]]
                for i in range(0, len(near), 4096):
                    part = near[i : i + 4096]
                    hit = part[may_link(n[x], grid[x], n[part], grid[part], num, den)]
                    left[hit] = False
                    group.extend(hit.tolist())
                    queue.extend(hit.tolist())
            if len(group) > 1:
                members = place[group]
                out_a.extend(members.tolist())
                out_b.extend([int(members.min())] * len(group))
        return pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [], [])
        for b in batches:
            for grp, *rest in zip(*(b.column(i).to_pylist() for i in range(4))):
                if grp != now:
                    if held[0]:
                        yield solve(*held)
                    now, held = grp, ([], [], [])
                for h, x in zip(held, rest):
                    h.append(x)
        if held[0]:
            yield solve(*held)

    return run


MEMBERS = "grp long, part int, place long, doc_id long, weight long, tokens binary"


def _members(size: int):
    """The sets of a block's candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            block = read_block(row)
            s = block_sets(block, size)
            weight = np.bincount(s.same, minlength=len(s.same))
            rows = [(w["grp"], w["part"], w["place"], int(block.doc_ids[d]), int(weight[d]) if w["weight"] is None else w["weight"], s.of(d).tobytes()) for w in row["wanted"] for d in (w["place"] & 0xFFFF,)]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            for i in range(0, len(rows), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows[i : i + 2000]), kinds)], names=["grp", "part", "place", "doc_id", "weight", "tokens"])

    return run


LINKS = "kind int, a long, b long"
EDGE, DEGREE = 0, 1


def linked(a: list[np.ndarray], b: list[np.ndarray] | None, num: int, den: int) -> np.ndarray:
    """Which sets of ``a`` (rows) and ``b`` (columns; None: a itself) are similar enough; exact, by counting shared tokens.

    Tokens of few sets count pair by pair, those of many through a matrix.
    """
    every = a if b is None else [*a, *b]
    size, cut = len(every), len(a)
    n = np.array([len(x) for x in every], np.int64)
    token = np.concatenate(every)
    owner = np.repeat(np.arange(size), n)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    begins = groups_of(token)
    times = np.diff(begins, append=len(token))
    column = np.repeat(np.arange(len(begins)), times)
    few = np.repeat((times > 1) & (times <= 24), times)
    shared = np.zeros(size * size, np.int64)
    o, c = owner[few], column[few]
    for d in range(1, 24):
        i = np.nonzero(c[d:] == c[:-d])[0]
        if not len(i):
            break
        shared += np.bincount(o[i] * size + o[i + d], minlength=size * size)
    shared = shared.reshape(size, size)
    many = times > 24
    place = np.cumsum(many) - 1
    wide = np.repeat(many, times)
    o, c = owner[wide], place[column[wide]]
    width, step = int(many.sum()), 2048
    for lo in range(0, width, step):
        i = slice(*np.searchsorted(c, [lo, lo + step]))
        grid = np.zeros((size, min(step, width - lo)), np.float32)
        grid[o[i], c[i] - lo] = 1
        shared += np.triu(grid @ grid.T, 1).astype(np.int64)
    shared += shared.T
    if b is None:
        np.fill_diagonal(shared, n)
        rows, cols = n, n
    else:
        shared, rows, cols = shared[:cut, cut:], n[:cut], n[cut:]
    return den * shared >= num * (rows[:, None] + cols[None, :] - shared)


def _verify(num: int, den: int):
    """Links within a group's part, or between its two parts: stars of what is connected, and degrees."""

    def solve(rows: list[dict]) -> pa.RecordBatch:
        sets = [np.frombuffer(r["tokens"], np.uint64) for r in rows]
        weight = np.array([r["weight"] for r in rows], np.int64)
        doc = [r["doc_id"] for r in rows]
        part = np.array([r["part"] for r in rows])
        kinds = np.unique(part)
        forest, out = Forest(), []
        if len(kinds) == 1 and kinds[0]:  # the other part is empty
            return _no_links()
        if len(kinds) == 1:
            link = linked(sets, None, num, den)
            degree = link @ weight - 1
            i, j = np.nonzero(np.triu(link, 1))
        else:
            x, y = (np.nonzero(part == k)[0] for k in kinds)
            link = linked([sets[i] for i in x], [sets[i] for i in y], num, den)
            degree = np.zeros(len(rows), np.int64)
            degree[x], degree[y] = link @ weight[y], link.T @ weight[x]
            i, j = np.nonzero(link)
            i, j = x[i], y[j]
        for a, b in _spanning(i, j, len(rows)):
            forest.union(doc[a], doc[b])
        stars = forest.stars()
        out = [(EDGE, a, b) for a, b in zip(stars.column(0).to_pylist(), stars.column(1).to_pylist())]
        out += [(DEGREE, r["place"], int(g)) for r, g in zip(rows, degree)]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), (pa.int32(), pa.int64(), pa.int64()))], names=["kind", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for row in rows_of(batches):
            if row["grp"] != now:
                if held:
                    yield solve(held)
                now, held = row["grp"], []
            held.append(row)
        if held:
            yield solve(held)

    return run


def _no_links() -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([], pa.int32()), pa.array([], pa.int64()), pa.array([], pa.int64())], names=["kind", "a", "b"])


def _spanning(i: np.ndarray, j: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Few of the pairs (i, j) that connect the same: labels fall until they rest."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return [(x, int(label[x])) for x in range(n) if label[x] != x]


DOCS = "doc_id long, place long, n_shingles long, weight long"
NO_BODY = "a long, b long"


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in rows_of(batches):
        ids = np.frombuffer(row["doc_ids"], "<i8")
        same = np.frombuffer(row["same"], "<u2").astype(np.int64)
        weight = np.bincount(same, minlength=len(same))[same] if len(same) else same
        sizes = np.frombuffer(row["sizes"], "<u4").astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array((row["block"] << 16) | same), pa.array(sizes), pa.array(weight)], names=["doc_id", "place", "n_shingles", "weight"])


def _equal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of one block with equal sets."""
    for row in rows_of(batches):
        ids = np.frombuffer(row["doc_ids"], "<i8")
        same = np.frombuffer(row["same"], "<u2").astype(np.int64)
        k = np.nonzero(same != np.arange(len(same)))[0]
        yield pa.RecordBatch.from_arrays([pa.array(ids[k]), pa.array(ids[same[k]])], names=["a", "b"])


def shares(full: int) -> Column:
    """Parts of a group of ``held`` members: up to sixteen share its work, beyond that each has ``full`` members."""
    held = F.col("held")
    return F.greatest(F.least(F.ceil(held / F.lit(max(1, min(full, 1000) // 16))), F.lit(16)), F.ceil(held / F.lit(full))).cast("int")


DIFFERENT = "place long, doc_id long, n long, first long, second long, weight long"


def _different(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different sets of each block that are not empty: digests, and how many documents have each."""
    for row in rows_of(batches):
        ids = np.frombuffer(row["doc_ids"], "<i8")
        same = np.frombuffer(row["same"], "<u2").astype(np.int64)
        sizes = np.frombuffer(row["sizes"], "<u4").astype(np.int64)
        k = np.nonzero((same == np.arange(len(same))) & (sizes > 0))[0]
        weight = np.bincount(same, minlength=len(same))[k] if len(same) else k
        cols = [(row["block"] << 16) | k, ids[k], sizes[k], *[np.frombuffer(row[x], "<i8")[k] for x in ("first", "second")], weight]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[x.split()[0] for x in DIFFERENT.split(", ")])


def copies_of(profile: DataFrame, scratch: Scratch) -> DataFrame:
    """place, doc_id, rep, rep_doc and weight for each different set of a block that other blocks have, too.

    rep is the first place of such a set, weight the number of all documents with it.
    """
    key = ["n", "first", "second"]
    sets = profile.select("block", "doc_ids", "sizes", "same", "first", "second").mapInArrow(_different, DIFFERENT)
    shared = sets.groupBy(*key).agg(F.count("*").alias("blocks"), F.min(F.struct("place", "doc_id")).alias("rep"), F.sum("weight").alias("weight")).where("blocks > 1")
    found = sets.drop("weight").join(shared, key)
    return scratch.save(found.select("place", "doc_id", F.col("rep.place").alias("rep"), F.col("rep.doc_id").alias("rep_doc"), "weight"), "copies")


def near_duplicates(
    docs: DataFrame,
    size: int = 3,
    num: int = 9,
    den: int = 10,
    most: int = 200,
    frequent: int = 16,
    unit: int = 50_000,
    refined: int = 20_000,
    group: int = 1000,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links for each row of ``docs``.

    Two documents link when the Jaccard similarity of their sets of ``size``-word
    shingles is at least num / den (a half or more); component_id is the smallest
    doc_id that links reach. n_links counts the rows a row links with. A document
    without words links with nothing. Rows that share a doc_id (null is one)
    share its component.

    Sets that are equal count as one from the start, in a block and between
    blocks. A token is frequent when ``frequent`` or more different sets hold it
    (at most 255 of a block count). Blocks learn which of their own tokens are,
    and which no other set has, through the same buckets as anything else;
    nothing is broadcast. Sets of more
    than ``most`` tokens are parted. These choices move work, never results.

    Holders of a key meet by size class. Where more than ``unit`` entries of a
    bucket and class come together, they are dealt to parts, and each pair of
    parts is a task. Candidates that pass size and histogram bounds form groups,
    which finer histograms take apart, ``refined`` of a group at a time, and
    which are then verified whole, part against part, by tasks of at most two
    parts of ``group`` sets: no link is lost, and no task grows with a group.
    """
    if 2 * num < den:
        raise ValueError("similarities below a half are not served")
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "ngrams")
    n_parts = partitions(spark)
    blocks = write_blocks(docs, scratch, block_bytes)
    total = blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).head()[0]
    bits = max(0, min(30, (int(total) // (4 << 20)).bit_length()))
    profile = scratch.save(blocks.mapInArrow(_profile(size), PROFILE), "profile")
    copies = copies_of(profile, scratch)
    counts = blocks.mapInArrow(_token_counts(size, bits), COUNTS).repartition(n_parts, "bucket").sortWithinPartitions("bucket")
    flags = counts.mapInArrow(_shared(frequent), FLAGS).groupBy("block").agg(F.collect_list(F.struct("bucket", "codes", "often")).alias("flags"))
    skipped = copies.where("place <> rep").groupBy(F.shiftright("place", 16).alias("block")).agg(F.collect_list(F.col("place").bitwiseAND(0xFFFF).cast("int")).alias("copies"))
    told = scratch.save(flags.join(skipped, "block", "full"), "told")
    del counts, flags
    release(spark)
    keys = scratch.save(blocks.join(told.hint("merge"), "block", "left").mapInArrow(_keys(size, num, den, most, bits), KEYS), "keys")
    scratch.drop("told")
    del told
    release(spark)
    heavy = keys.groupBy("unit").agg(F.sum("n").alias("held")).where(F.col("held") > unit).select("unit", F.ceil(F.col("held") / unit).cast("int").alias("asked"))
    met = dealt(keys.join(heavy, "unit", "left"), "unit", F.coalesce("asked", F.lit(1)), F.col("block")).select("task", "block", "n", "body")
    stars = met.repartition(n_parts, "task").sortWithinPartitions("task").mapInArrow(_candidates(num, den), "a long, b long")
    candidates = components(stars, scratch, "candidates")
    del met, stars, keys
    scratch.drop("keys")
    release(spark)

    sized = candidates.join(candidates.groupBy("component").agg(F.count("*").alias("held")), "component")
    asked = dealt(sized, "component", shares(refined), F.col("node"))
    asked = asked.groupBy(F.shiftright("node", 16).alias("block")).agg(F.collect_list(F.struct(F.col("task").alias("grp"), F.col("node").alias("place"))).alias("wanted"))
    fine = blocks.join(asked.hint("merge"), "block").mapInArrow(_histograms(size), HISTOGRAMS).repartition(n_parts, "grp").sortWithinPartitions("grp")
    candidates = components(fine.mapInArrow(_refine(num, den), "a long, b long"), scratch, "groups")
    del sized, asked, fine
    release(spark)

    member = candidates.join(candidates.groupBy("component").agg(F.count("*").alias("held")), "component").join(copies.select(F.col("place").alias("node"), "weight"), "node", "left")
    wanted = dealt(member, "component", shares(group), F.col("node")).select(
        F.shiftright("node", 16).alias("block"),
        F.struct(F.col("task").alias("grp"), F.when(F.col("own") == F.col("other"), 0).otherwise(F.when(F.col("own") < F.col("other"), 1).otherwise(2)).alias("part"), F.col("node").alias("place"), "weight").alias("w"),
    )
    wanted = wanted.groupBy("block").agg(F.collect_list("w").alias("wanted"))
    members = blocks.join(wanted.hint("merge"), "block").mapInArrow(_members(size), MEMBERS).repartition(n_parts, "grp").sortWithinPartitions("grp")
    links = scratch.save(members.mapInArrow(_verify(num, den), LINKS), "links")
    del wanted, members
    scratch.drop("blocks")

    equal = profile.select("doc_ids", "same").mapInArrow(_equal, NO_BODY)
    apart = copies.where("place <> rep").select(F.col("doc_id").alias("a"), F.col("rep_doc").alias("b"))
    edges = links.where(f"kind = {EDGE}").select("a", "b").unionByName(equal).unionByName(apart)
    label = components(edges, scratch, "links").withColumnRenamed("node", "doc_id")
    degree = links.where(f"kind = {DEGREE}").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("degree"))
    rows = profile.select("block", "doc_ids", "sizes", "same").mapInArrow(_documents, DOCS)
    rows = rows.join(copies.select("place", "rep", F.col("weight").alias("all")), "place", "left").withColumn("rep", F.coalesce("rep", "place"))
    out = rows.join(degree, "rep", "left").join(label, "doc_id", "left")
    return out.select(
        F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"),
        "n_shingles",
        F.nullif(F.coalesce("component", "doc_id"), F.lit(NO_ID)).alias("component_id"),
        F.when(F.col("n_shingles") == 0, 0).otherwise(F.coalesce("degree", F.coalesce("all", "weight") - 1)).cast("long").alias("n_links"),
    )


def keep_one(docs: DataFrame, size: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One document of each component, with all its columns: the rows whose doc_id is the smallest there.

    All rows of that doc_id stay. Rows without a doc_id have one component.
    """
    (name,) = fresh(docs, "id")
    found = near_duplicates(docs, size, num, den).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.coalesce("doc_id", F.lit(NO_ID)).alias(name)).distinct()
    own = docs.withColumn(name, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    return own.join(found, name, "left_semi").select(*docs.columns)
