"""Quality rules: word statistics, and how well public vocabularies fit a text."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import Scratch, lower_ascii, prepare, trim
from linkloom.llm.vocab import piece_ids, word_ids

#: First and last code points of blocks that tell scripts apart.
SCRIPTS = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF),),
    "cyrillic": ((0x400, 0x52F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x77F),),
    "devanagari": ((0x900, 0x97F),),
    "thai": ((0xE00, 0xE7F),),
    "kana": ((0x3040, 0x30FF),),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7A3)),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF)),
}

SYMBOLS = "#*$%&|<>"

#: Measures of the first vocabulary, then of the second.
MEASURES = ("chars_per_token", "byte_share", "token_entropy")
SECOND = tuple(f"word_{m}" for m in MEASURES)

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, " + "".join(f"{m} double, " for m in MEASURES + SECOND) + "script string"


def word_stats(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    words = text.encode().split()  # bytes are split at exactly \x20 and \x09-\x0D
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    symbols = sum(map(text.count, SYMBOLS))
    dup = 0
    if "\n" in text:
        lines = [x for x in text.split("\n") if x.encode().split()]
        dup = len(lines) - len(set(lines))
    repeated = 0
    windows = list(zip(words, words[1:], words[2:]))
    seen = Counter(windows)
    if len(seen) < len(windows):
        upto = 0
        for i, w in enumerate(windows):
            if seen[w] > 1:
                repeated += i + 3 - max(i, upto)
                upto = i + 3
    return len(words), chars, symbols, dup, repeated


def script_of(text: str) -> str:
    """The script of most letters; "none" without letters of a known one."""
    if text.isascii():
        return "latin" if any(c.isalpha() for c in text) else "none"
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    counts = {s: sum(int(((points >= a) & (points <= b)).sum()) for a, b in r) for s, r in SCRIPTS.items()}
    best = max(counts, key=counts.get)
    return best if counts[best] else "none"


#: Tokens of a block over which entropy is taken, so that it does not follow a text's length.
BLOCK = 128


def block_entropy(ids: np.ndarray) -> float:
    """Mean entropy of whole blocks over its greatest value; a shorter text is one block."""
    size = min(BLOCK, len(ids))
    if size < 2:
        return 1.0
    grid = np.sort(ids[: len(ids) // size * size].reshape(-1, size), axis=1).ravel()
    begins = np.empty(len(grid), bool)
    begins[0] = True
    np.not_equal(grid[1:], grid[:-1], out=begins[1:])
    begins[::size] = True
    at = np.nonzero(begins)[0]
    runs = np.diff(at, append=len(grid))
    runs = runs[runs > 1]
    lost = float((runs * np.log2(runs)).sum()) / len(grid)
    return 1.0 - lost / math.log2(size)


def fertility(ids: np.ndarray, chars: int, fallback: np.ndarray) -> tuple[float | None, float | None, float | None]:
    """Characters per token, share of byte tokens, and block entropy."""
    n = len(ids)
    if not n:
        return None, None, None
    return chars / n, int(fallback[ids].sum()) / n, block_entropy(ids)


def _measure(pieces: str, words: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        vocabularies = piece_ids(pieces), word_ids(words)
        names = [x.split()[0] for x in STATS.split(", ")]
        kinds = [pa.int64()] * 6 + [pa.float64()] * 6 + [pa.string()]
        for b in batches:
            texts = b.column(0).to_pylist()
            base = [word_stats(t) for t in texts]
            each = []
            for v in vocabularies:
                ids, n = v.flat(texts)
                each.append([(len(own), *fertility(own, x[1], v.bytes)) for own, x in zip(np.split(ids, np.cumsum(n)[:-1]), base)])
            rows = [(*x, *first, *second[1:], script_of(t)) for x, first, second, t in zip(base, *each, texts)]
            cols = [pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), *cols], names=["own", "lang", *names])
            del texts, base, each, rows, cols, ids
            trim()

    return run


#: What a band holds: the lower and upper distance from the quartiles, in
#: interquartile ranges, and the least such range. None: no bound on that side.
FENCES = dict(zip(MEASURES + SECOND, ((3.0, 3.0, 0.12), (None, 3.0, 0.008), (3.0, None, 0.015), (4.0, 4.0, 0.12), (None, 4.0, 0.008), (4.0, None, 0.015))))


#: Least and greatest of each measure that prose of a script may have,
#: whatever the corpus holds, by the first vocabulary. It has words of Latin and Cyrillic, and
#: of the others letters only: a token is a letter there and entropy is lower.
#: Entropy of Latin lies below the least of labelled good documents of sf0.1
#: (0.768); the rest is set wide around a paragraph of prose in 15 languages.
LIMITS = {
    "latin": {"chars_per_token": (1.0, 8.0), "byte_share": (None, 0.25), "token_entropy": (0.75, None)},
    "cyrillic": {"chars_per_token": (0.7, 8.0), "byte_share": (None, 0.25), "token_entropy": (0.65, None)},
    **{s: {"chars_per_token": (0.4, 4.0), "byte_share": (None, 0.4), "token_entropy": (0.45, None)} for s in ("greek", "hebrew", "arabic", "devanagari", "thai")},
    **{s: {"chars_per_token": (0.3, 4.0), "byte_share": (None, 0.6), "token_entropy": (0.5, None)} for s in ("kana", "hangul", "han")},
    "none": {"token_entropy": (0.3, None)},
}

#: Different texts that a band needs; with fewer, the fixed limits hold alone.
LEAST_TEXTS = 50


def bands(stats: DataFrame) -> DataFrame:
    """For each language (without one: script), the least and greatest accepted value of each measure.

    Quartiles are exact over the different texts that pass the base rules and the
    fixed limits, of values rounded to a thousandth, so that their state stays
    small at any size.
    Copies (as exact dedup sees them) count once: no text moves a band by its
    number. Languages with fewer than ``LEAST_TEXTS`` of them have no band.
    """
    sound = reduce(lambda a, m: a & possible(m), FENCES, ~F.col("base_failed"))
    once = stats.where(sound).groupBy("band", "copy").agg(*[F.min(F.round(m, 3)).alias(m) for m in FENCES])
    q = {m: F.percentile(m, F.array(F.lit(0.25), F.lit(0.75))) for m in FENCES}
    out = once.groupBy("band").agg(F.count("*").alias("texts"), *[c.alias(m) for m, c in q.items()]).where(F.col("texts") >= LEAST_TEXTS)
    cols = []
    for m, (below, above, least) in FENCES.items():
        a, b = F.col(m)[0], F.col(m)[1]
        spread = F.greatest(b - a, F.lit(least))
        cols += [(a - below * spread if below else F.lit(None).cast("double")).alias(f"{m}_min"), (b + above * spread if above else F.lit(None).cast("double")).alias(f"{m}_max")]
    return out.select("band", *cols)


def within(m: str) -> Column:
    x = F.col(m)
    return F.coalesce(x.isNotNull() & (x >= F.coalesce(f"{m}_min", x)) & (x <= F.coalesce(f"{m}_max", x)), F.lit(False))


def possible(m: str) -> Column:
    """Whether a measure lies within the fixed limits of the text's script."""
    x, ok = F.col(m), F.lit(True)
    for script, limits in LIMITS.items():
        a, b = limits.get(m, (None, None))
        outside = (x < a if a is not None else F.lit(False)) | (x > b if b is not None else F.lit(False))
        ok = ok & ~((F.col("script") == script) & outside)
    return F.coalesce(ok, F.lit(False))


def _judged(docs: DataFrame, own: Column, pieces: str, words: str, scratch: Scratch) -> DataFrame:
    """``own`` (a struct of a row's columns) beside the row's measures, base_failed, band and kept; texts are read once."""
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(text.alias("text"), F.struct(own.alias("own"), F.xxhash64(lower_ascii(text)).alias("copy")).alias("own"), lang.alias("lang"))
    measured = rows.mapInArrow(_measure(pieces, words), f"own {rows.schema['own'].dataType.simpleString()}, lang string, {STATS}")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    band = F.coalesce(F.concat(F.lit("lang:"), F.col("lang")), F.concat(F.lit("script:"), F.col("script")))
    saved = scratch.save(measured.select(F.col("own.own").alias("own"), F.col("own.copy").alias("copy"), *[x.split()[0] for x in STATS.split(", ")], failed.alias("base_failed"), band.alias("band")), "stats")
    kept = ~F.col("base_failed")
    for m in FENCES:
        kept = kept & within(m) & possible(m)
    limits = scratch.save(bands(saved), "bands")  # a table of its own: a join to an aggregate could not split a large language
    return saved.join(limits, "band", "left").withColumn("kept", kept)


def quality(docs: DataFrame, pieces: str = "piece_bpe_32k.model", words: str = "word_bpe_49k.json") -> DataFrame:
    """One row for each row of ``docs``: doc_id, word statistics, base_failed, kept, the measures, band.

    base_failed: under 50 words, or over half of them in repeated 3-word
    windows. Others are kept if characters per token, byte share and token
    entropy (in blocks of 128 tokens) lie within the fixed limits of their
    script, and, by each of two vocabularies, within the bands of their language,
    or of their script where lang is null. Bands come from the quartiles of the
    different texts themselves: those that a vocabulary splits far worse or
    better than it splits most texts of that language go. Languages of few texts
    have no band. A row is judged by its own text and lang, whatever rows share
    its doc_id. A task holds a batch of texts, or one long text, with its words
    and ids.
    """
    spark = docs.sparkSession
    prepare(spark)
    judged = _judged(docs, F.struct(F.col("doc_id").cast("long").alias("doc_id")), pieces, words, Scratch(spark, "quality"))
    return judged.select("own.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *FENCES, "band")


def keep_good(docs: DataFrame, pieces: str = "piece_bpe_32k.model", words: str = "word_bpe_49k.json") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns: each row is judged where it is read."""
    spark = docs.sparkSession
    prepare(spark)
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return _judged(docs, own, pieces, words, Scratch(spark, "quality")).where("kept").select(*[F.col("own").getField(c).alias(c) for c in docs.columns])
