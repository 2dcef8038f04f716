"""Canonical length-limited Huffman coding of token ids, and a file format for it.

A file holds whole documents in ascending order and can be read alone:

    magic "LKTH", version u32, documents u64, tokens u64, segment u32, table bytes u32
    code lengths of all ids (u8 each, deflated)
    doc_ids i64[documents], tokens of each document u64[documents]
    checkpoints u64[ceil(tokens / segment)]: the bit where each segment begins
    the codes, most significant bit first, and three bytes of padding

Segments decode independently: their checkpoints let them advance side by side,
each step looking up the next code of every segment in one table.
"""

from __future__ import annotations

import heapq
import struct
import zlib

import numpy as np

MAGIC, VERSION = b"LKTH", 1
HEAD = struct.Struct("<4sIQQII")
LIMIT = 16


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 where the count is 0."""
    used = np.nonzero(counts)[0]
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols do not fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    n = len(order)
    # A package is known by its weight and by how many leaves, lightest first, it is made of at each level.
    levels, packages = [], np.empty(0)
    for _ in range(limit):
        merged = np.concatenate([weights, packages])
        is_leaf = np.concatenate([np.ones(n, bool), np.zeros(len(packages), bool)])
        rank = np.argsort(merged, kind="stable")
        merged, is_leaf = merged[rank], is_leaf[rank]
        levels.append(is_leaf)
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
    take = 2 * n - 2
    lengths = np.zeros(n, np.int64)
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes by length, then by id."""
    codes = np.zeros(len(lengths), np.uint32)
    code = last = 0
    for i in sorted(np.nonzero(lengths)[0].tolist(), key=lambda i: (lengths[i], i)):
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


def decode_table(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """For each value of the next ``limit`` bits: the id, and the bits of its code."""
    order = np.array(sorted(np.nonzero(lengths)[0].tolist(), key=lambda i: (lengths[i], i)), np.uint32)
    spans = 1 << (limit - lengths[order].astype(np.int64))
    ids = np.repeat(order, spans)
    pad = (1 << limit) - len(ids)
    ids = np.concatenate([ids, np.zeros(pad, np.uint32)])
    return ids, lengths[ids].astype(np.uint8)


def encode_ids(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, segment: int) -> tuple[bytes, np.ndarray]:
    """The packed codes, and the bit at which each segment begins."""
    bits = lengths.astype(np.uint64)
    if len(ids) and not lengths[ids].all():
        raise ValueError("an id has no code")
    left = codes.astype(np.uint64) << ((np.uint64(64) - bits) & np.uint64(63))
    ends = np.cumsum(lengths[ids], dtype=np.uint64)
    begins = np.concatenate([np.zeros(1, np.uint64), ends[segment - 1 : -1 : segment]]) if len(ids) else np.empty(0, np.uint64)
    words = np.zeros((int(ends[-1]) >> 5) + 2 if len(ids) else 0, np.uint32)
    step = 1 << 16  # small enough to stay in a core's cache
    for i in range(0, len(ids), step):
        own = ids[i : i + step]
        at = ends[i : i + step] - bits[own]
        # each code lies within the 64 bits from the word in which it begins
        value = left[own] >> (at & np.uint64(31))
        word = (at >> np.uint64(5)).astype(np.int64)
        first = np.concatenate([[0], np.nonzero(word[1:] != word[:-1])[0] + 1])
        both = np.bitwise_or.reduceat(value, first)
        at = word[first]
        words[at] |= (both >> np.uint64(32)).astype(np.uint32)
        words[at + 1] |= both.astype(np.uint32)
    size = -(-int(ends[-1]) // 8) if len(ids) else 0
    return words.astype(">u4").tobytes()[:size], begins


def decode_ids(payload: np.ndarray, begins: np.ndarray, n: int, segment: int, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """All segments step by step, side by side."""
    if not n:
        return np.empty(0, np.uint32)
    entry = (table[0].astype(np.uint32) << np.uint32(8)) | table[1]
    words = np.zeros(-(-len(payload) // 4) * 4 + 8, np.uint8)
    words[: len(payload)] = payload
    words = words.view(">u4").astype(np.uint64)
    seen = (words[:-1] << np.uint64(32)) | words[1:]  # 64 bits from each word on
    grid = np.zeros((segment, len(begins)), np.uint32)
    at = begins.astype(np.uint64)
    rest = n - (len(begins) - 1) * segment
    for k in range(min(segment, n)):
        if k == rest:
            at = at[:-1]
        code = (seen[at >> np.uint64(5)] >> (np.uint64(64 - LIMIT) - (at & np.uint64(31)))) & np.uint64((1 << LIMIT) - 1)
        got = entry[code]
        grid[k, : len(at)] = got >> np.uint32(8)
        at = at + (got & np.uint32(255))
    return grid.T.reshape(-1)[:n]


def write_file(doc_ids: np.ndarray, doc_tokens: np.ndarray, ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, segment: int = 256) -> bytes:
    table = zlib.compress(lengths.astype(np.uint8).tobytes())
    payload, begins = encode_ids(ids, lengths, codes, segment)
    head = HEAD.pack(MAGIC, VERSION, len(doc_ids), len(ids), segment, len(table))
    return b"".join([head, table, doc_ids.astype("<i8").tobytes(), doc_tokens.astype("<u8").tobytes(), begins.astype("<u8").tobytes(), payload, b"\0\0\0"])


def read_file(content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, tokens of each, and all ids."""
    magic, version, docs, n, segment, size = HEAD.unpack_from(content)
    if (magic, version) != (MAGIC, VERSION):
        raise ValueError("not a token file of this version")
    at = HEAD.size
    lengths = np.frombuffer(zlib.decompress(content[at : at + size]), np.uint8)
    at += size
    doc_ids = np.frombuffer(content, "<i8", docs, at)
    doc_tokens = np.frombuffer(content, "<u8", docs, at + 8 * docs)
    at += 16 * docs
    segments = -(-n // segment)
    begins = np.frombuffer(content, "<u8", segments, at)
    payload = np.frombuffer(content, np.uint8, offset=at + 8 * segments)
    return doc_ids, doc_tokens, decode_ids(payload, begins, n, segment, decode_table(lengths))
