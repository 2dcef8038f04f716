"""Token counts from distinct pre-tokens; ids of a text are never made."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import Scratch, partitions, prepare, texts
from linkloom.llm.vocab import Pieces

#: Pre-tokens a worker may hold before it passes on what it has counted.
HELD = 250_000


def _frequencies(vocab: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, seen = Pieces(vocab), Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(pieces.split(t)[0])
                if len(seen) > HELD:
                    yield _pairs(seen)
                    seen = Counter()
        yield _pairs(seen)

    return run


def _pairs(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["pre_token", "n"])


def _count_pieces(vocab: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(vocab)
        for b in batches:
            for i in range(0, b.num_rows, 5000):
                part = b.slice(i, 5000)
                n = pieces.count(part.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int32())], names=["pre_token", "n", "pieces"])

    return run


def _per_document(vocab: str, common: dict[str, int]):
    """Frequencies of each document, summed at once where the piece count came along.

    Two kinds of rows: for each document its sum so far (pre_token null), and for
    each of its other pre-tokens the frequency that waits for the join.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(vocab)
        get = common.get
        for b in batches:
            cols: tuple[list, ...] = ([], [], [], [], [])
            rows, docs, sizes, tokens, freqs = cols
            for row, doc, size, t in zip(*(b.column(i).to_pylist() for i in range(4))):
                pre, total = pieces.split(t)
                for w, f in Counter(pre).items():
                    if (c := get(w)) is not None:
                        total += f * c
                    else:
                        rows.append(row)
                        docs.append(None)
                        sizes.append(None)
                        tokens.append(w)
                        freqs.append(f)
                rows.append(row)
                docs.append(doc)
                sizes.append(size)
                tokens.append(None)
                freqs.append(total)
                if len(rows) > 100_000:
                    yield _waiting(cols)
                    for c in cols:
                        c.clear()
            yield _waiting(cols)

    return run


WAITING = "row long, doc_id long, n_bytes long, pre_token string, f long"


def _waiting(cols) -> pa.RecordBatch:
    i = pa.int64()
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (i, i, i, pa.string(), i))], names=[x.split()[0] for x in WAITING.split(", ")])


def most_frequent(counted: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows, none of them rarer than a row left out: all above a cut found from a histogram of ``n``.

    Cells are counts up to 1024, then 64 to each doubling; of these few thousand
    the driver takes the highest that fit together. No task sorts candidates.
    """
    cell = F.when(F.col("n") <= 1024, F.col("n")).otherwise(F.floor(F.log2("n") * 64) + 384).cast("int")
    held = counted.groupBy(cell.alias("cell")).count().collect()
    left, cut = most, None
    for r in sorted(held, key=lambda r: -r["cell"]):
        if r["count"] > left:
            break
        left, cut = left - r["count"], r["cell"]
    return counted.where(cell >= cut) if cut is not None else counted.limit(0)


def token_counts(docs: DataFrame, vocab: str = "byte_bpe_50k.json", limit: int = 1024, common: int = 200_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of ``docs``.

    The vocabulary's library counts the pieces of every distinct pre-token of
    the corpus once. Up to ``common`` most frequent pre-tokens, a number that does
    not depend on the corpus, travel with the tasks; the frequencies of all
    others are joined to their counts by pre-token, so that no frequent
    pre-token is ever shuffled. A special token inside a text is one piece.
    An empty text has none. Repeated rows each get a row.
    """
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "tokens")
    rows = texts(docs)
    counted = rows.select("text").mapInArrow(_frequencies(vocab), "pre_token string, n long").groupBy("pre_token").agg(F.sum("n").alias("n"))
    counted = scratch.save(counted.mapInArrow(_count_pieces(vocab), "pre_token string, n long, pieces int"), "pieces")
    top = most_frequent(counted, common).select("pre_token", "pieces").toArrow().to_pydict()
    known = dict(zip(top["pre_token"], top["pieces"]))

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    # written once: a row's number need not be the same in a second scan
    waiting = scratch.save(numbered.mapInArrow(_per_document(vocab, known), WAITING), "frequencies")
    own = waiting.where("pre_token is null").select("row", "doc_id", "n_bytes", F.col("f").alias("t"))
    rare = waiting.where("pre_token is not null").select("row", "pre_token", "f").join(counted.select("pre_token", "pieces"), "pre_token")
    sums = rare.groupBy("row").agg(F.sum(F.col("f") * F.col("pieces")).alias("more"))
    out = own.join(sums, "row", "left").withColumn("n_tokens", F.col("t") + F.coalesce("more", F.lit(0)))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
