"""Mixing by iterative proportional fitting: token weights raked to marginals, documents sampled by calibrated probabilities.

DataFrame expressions only. The contingency table of tokens is aggregated once;
the fit runs on that table, never on documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.llm.common import Scratch, fresh, prepare

DIMENSIONS = ("source", "lang", "topic")

#: Fixed value: stands for a null source or lang.
MISSING = "(none)"

#: A draw is the first 13 hex digits of a digest over 16 ** 13.
DRAW_DIGITS = 13


def text_of() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def count_words() -> Column:
    """Runs of characters outside \\x20 and \\x09-\\x0D."""
    return F.regexp_count(text_of(), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def topic() -> Column:
    """A coarse topic by form: legal notes, contacts, tables, lists of symbols, brief or long prose."""
    t = text_of()

    def share(mark: str, parts: int) -> Column:
        return parts * (F.length(t) - F.length(F.replace(t, F.lit(mark)))) > F.length(t)

    return (
        F.when(F.contains(t, F.lit("Licensed under")) | F.contains(t, F.lit("License, ")), "legal")
        .when(F.contains(t, F.lit("@")) | F.contains(t, F.lit("+1 ")), "contact")
        .when(share("|", 40), "table")
        .when(share("$", 100) | share("*", 50), "symbols")
        .when(F.length(t) < 1000, "brief")
        .otherwise("prose")
    )


def one_task(cells: DataFrame) -> DataFrame:
    """A table of cells, or of their marginals, as one partition: aggregates and windows over it need no shuffle."""
    return cells.coalesce(1)


def cells_of(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").cast("double").alias("n"), F.count("*").alias("docs")).where("n > 0")


def targets_of(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """Shares of tokens to the given power, made to sum to 1: under 1 lifts the rare, 0 makes all equal."""
    own = cells.groupBy(dimension).agg(F.sum("n").alias("own"))
    own = own.withColumn("own", F.pow("own", F.lit(power)))
    total = own.agg(F.sum("own")).head()[0]
    return own.select(dimension, (F.col("own") / F.lit(total or 1.0)).alias("target"))


def given(spark: SparkSession, dimension: str, weights: dict[str, float]) -> DataFrame:
    """Targets as a caller gives them, made to sum to 1."""
    total = sum(weights.values())
    if total <= 0 or min(weights.values()) < 0:
        raise ValueError(f"weights of {dimension} must be at least 0 and not all 0")
    return spark.createDataFrame([(k, w / total) for k, w in weights.items()], f"{dimension} string, target double")


def rake(cells: DataFrame, targets: dict[str, DataFrame], scratch: Scratch, rounds: int, tolerance: float = 1e-7) -> DataFrame:
    """cells with ``w``: shares of tokens whose marginals are the targets, as near as the cells allow.

    Each round scales the weights to every dimension's targets in turn. It ends
    after ``rounds``, or once a whole round moved no weight by more than
    ``tolerance`` of itself. Target values without cells fall away; values
    without a target keep no weight. One round's table is written before the
    next reads it. The table of cells is one task's: a round shuffles and
    broadcasts nothing, however many partitions a shuffle has.
    """
    total = cells.agg(F.sum("n")).head()[0]
    now = cells.where(F.concat(*DIMENSIONS).isNotNull()).withColumn("w", F.col("n") / F.lit(total or 1.0))
    for d in DIMENSIONS:
        now = now.join(targets[d].select(d, F.col("target").alias(f"target_{d}")), d, "left")
    now = one_task(scratch.save(one_task(now), "raked-0"))
    for k in range(1, rounds + 1):
        step = now.withColumn("was", F.col("w"))
        for d in DIMENSIONS:
            step = step.withColumn("margin", F.sum("w").over(Window.partitionBy(d)))
            step = step.withColumn("w", F.when(F.col("margin") > 0, F.col("w") * F.coalesce(f"target_{d}", F.lit(0.0)) / F.col("margin")).otherwise(0.0)).drop("margin")
        step = one_task(scratch.save(step, f"raked-{k}"))
        moved = step.agg(F.max(F.abs(F.col("w") - F.col("was")) / F.greatest("was", F.lit(1e-300)))).head()[0]
        now = step.drop("was")
        scratch.drop(f"raked-{k - 1}")
        if moved is None or moved <= tolerance:
            break
    return now.select(*cells.columns, "w")


def probabilities(raked: DataFrame, scratch: Scratch, keep: float, rounds: int = 40) -> DataFrame:
    """cells with ``p``: min(1, f * w / n), where f makes the expected tokens ``keep`` of all.

    f is found by bisection on the table of cells; where every cell with weight
    is kept whole and that is less than asked for, p is 1 there.
    """
    cells = one_task(scratch.save(raked.select(*DIMENSIONS, "n", "w", (F.col("w") / F.col("n")).alias("r")), "rates"))
    total, least = cells.agg(F.sum("n"), F.min(F.when(F.col("r") > 0, F.col("r")))).head()
    if not total or not least:
        return cells.withColumn("p", F.lit(0.0)).drop("r")
    low, high = 0.0, 1.0 / least
    grid = 64
    for _ in range(rounds // 6 + 1):  # each round reads the cells once and cuts the range 64-fold
        at = [low + (high - low) * (i + 1) / grid for i in range(grid)]
        each = cells.select("r", "n", F.posexplode(F.array(*[F.lit(f) for f in at])).alias("i", "f"))
        got = [x.tokens for x in each.groupBy("i").agg(F.sum(F.least(F.lit(1.0), F.col("r") * F.col("f")) * F.col("n")).alias("tokens")).orderBy("i").collect()]
        i = next((i for i, x in enumerate(got) if x >= keep * total), grid - 1)
        low, high = (at[i - 1] if i else low), at[i]
    return cells.withColumn("p", F.least(F.lit(1.0), F.col("r") * high)).drop("r")


def draw(seed: str) -> Column:
    """A number from 0 to 1 that depends on doc_id and seed alone."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, DRAW_DIGITS), 16, 10).cast("double") / float(16**DRAW_DIGITS)


def value_of(docs: DataFrame, c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) if c in docs.columns else F.lit(MISSING)


def marked(docs: DataFrame, topic_of: Callable[[], Column] = topic) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), value_of(docs, "source").alias("source"), value_of(docs, "lang").alias("lang"), topic_of().alias("topic"), count_words().alias("tokens"))


def fitted(rows: DataFrame, scratch: Scratch, powers: tuple[float, float, float], keep: float, rounds: int, targets: dict[str, dict[str, float]] | None) -> DataFrame:
    """source, lang, topic and p of each cell of the marked ``rows``."""
    cells = one_task(scratch.save(cells_of(rows), "cells"))
    asked = {d: given(cells.sparkSession, d, targets[d]) if targets and d in targets else targets_of(cells, d, a) for d, a in zip(DIMENSIONS, powers)}
    asked = {d: scratch.save(t, f"target-{d}") for d, t in asked.items()}
    return scratch.save(probabilities(rake(cells, asked, scratch, rounds), scratch, keep).select(*DIMENSIONS, "p"), "p")


def mixture_rates(docs: DataFrame, powers: tuple[float, float, float] = (0.5, 0.7, 0.8), keep: float = 0.5, rounds: int = 30, topic_of: Callable[[], Column] = topic, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """source, lang, topic and p of each cell of ``docs``: the probability with which a row of it with words is kept."""
    prepare(docs.sparkSession)
    return fitted(marked(docs, topic_of), Scratch(docs.sparkSession, "mixing"), powers, keep, rounds, targets)


def mixture(
    docs: DataFrame,
    powers: tuple[float, float, float] = (0.5, 0.7, 0.8),
    keep: float = 0.5,
    rounds: int = 30,
    seed: str = "mix",
    topic_of: Callable[[], Column] = topic,
    targets: dict[str, dict[str, float]] | None = None,
) -> DataFrame:
    """doc_id, source, lang, topic, tokens, p and kept for each row of ``docs``.

    Tokens are words. Targets of each marginal are the weights that ``targets``
    gives for its values (made to sum to 1; a value without a weight gets none),
    or else the shares of source, lang and topic to ``powers``. p is the row's
    probability: equal within a cell, such that the expected tokens of the cells
    are in the raked proportions (where they do not exceed what a cell has) and
    sum to ``keep`` of all. kept: the row's draw lies below p. Rows without words
    have p 0 and are not kept; rows that share a doc_id share a draw. Null source
    and lang are a value, "(none)". topic is a form of text unless ``topic_of``
    gives another expression.
    """
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "mixing")
    rows = scratch.save(marked(docs, topic_of), "rows")
    p = fitted(rows, scratch, powers, keep, rounds, targets)
    out = rows.join(p, list(DIMENSIONS), "left")
    chance = F.when(F.col("tokens") > 0, F.coalesce("p", F.lit(0.0))).otherwise(0.0)
    return out.select("doc_id", *DIMENSIONS, "tokens", chance.alias("p")).withColumn("kept", draw(seed) < F.col("p"))


def sample(docs: DataFrame, keep: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the mixture keeps, with all their columns.

    A row's cell and draw say whether it is kept, so no text moves: the cells
    with their probabilities meet the rows.
    """
    names = fresh(docs, *DIMENSIONS, "words", "chance")
    cell = dict(zip(DIMENSIONS, names))
    p = mixture_rates(docs, keep=keep).select(*[F.col(d).alias(n) for d, n in cell.items()], F.col("p").alias(names[-1]))
    own = docs.select("*", value_of(docs, "source").alias(cell["source"]), value_of(docs, "lang").alias(cell["lang"]), topic().alias(cell["topic"]), (count_words() > 0).alias(names[-2]))
    return own.join(p, names[:3]).where(F.col(names[-2]) & (draw("mix") < F.col(names[-1]))).select(*docs.columns)
