"""Recall, coverage, multiplicity, and reports over pair measures.

Counts stand beside every ratio. Percentiles are exact and interpolate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.operators.pairs import IDS


def evaluation(truth: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row: candidates in all and by source, true, retrieved and missed pairs, pair recall, and S1 coverage."""
    flags = candidates.select(*IDS, F.lit(1).alias("c"), F.lit(0).alias("t")).unionByName(truth.select(*IDS, F.lit(0).alias("c"), F.lit(1).alias("t")))
    pairs = flags.groupBy(*IDS).agg(F.max("c").alias("c"), F.max("t").alias("t"))
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    by_s1 = pairs.groupBy("source1_entity_id").agg(
        F.sum("c").alias("c"),
        F.sum(F.when(F.col("candidate_entity_id").startswith("S2-"), F.col("c")).otherwise(0)).alias("s2"),
        F.sum(F.when(F.col("candidate_entity_id").startswith("S3-"), F.col("c")).otherwise(0)).alias("s3"),
        F.sum("t").alias("t"),
        F.sum(F.col("c") * F.col("t")).alias("r"),
    )
    out = by_s1.agg(
        total("c").alias("candidate_pairs"),
        total("s2").alias("s2_pairs"),
        total("s3").alias("s3_pairs"),
        total("t").alias("true_pairs"),
        total("r").alias("retrieved_pairs"),
        F.count_if(F.col("t") > 0).alias("s1_with_truth"),
        F.count_if(F.col("r") > 0).alias("s1_covered"),
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return out.select("*", (F.col("true_pairs") - F.col("retrieved_pairs")).alias("missed_pairs"), ratio("retrieved_pairs", "true_pairs").alias("pair_recall"), ratio("s1_covered", "s1_with_truth").alias("s1_coverage"))


def multiplicity(candidates: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """Candidates of each S1 record; with ``references``, those without any count as 0."""
    n = candidates.groupBy("source1_entity_id").agg(F.count("*").alias("n"))
    if references is None:
        return n
    return references.select(F.col("entity_id").alias("source1_entity_id")).join(n, "source1_entity_id", "left").select("source1_entity_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def distribution(counts: DataFrame, column: str = "n", prefix: str = "candidates") -> DataFrame:
    p = F.percentile(column, F.array(*[F.lit(x) for x in (0.5, 0.9, 0.95, 0.99)]))
    out = counts.agg(F.count("*").alias("records"), p.alias("p"), F.max(column).alias(f"max_{prefix}"), F.avg(column).alias(f"mean_{prefix}"))
    return out.select("records", *[F.col("p")[i].alias(f"{x}_{prefix}") for i, x in enumerate(("median", "p90", "p95", "p99"))], f"max_{prefix}", f"mean_{prefix}")


def above(counts: DataFrame, thresholds: Iterable[int] = (10, 25, 50, 100, 250, 500, 1000, 5000), column: str = "n") -> DataFrame:
    """For each threshold, the records with more: one pass, one row per threshold."""
    ts = list(thresholds)
    row = counts.agg(*[F.count_if(F.col(column) > t).alias(f"t{i}") for i, t in enumerate(ts)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(t).cast("long").alias("threshold"), F.col(f"t{i}").alias("records")) for i, t in enumerate(ts)])).alias("x")).select("x.*")


def counting(weight: str | None) -> tuple[Column, Callable[[Column], Column]]:
    """Of all rows, and of those that meet a condition: how many, or with ``weight`` the sum of that column."""
    if weight is None:
        return F.count("*"), F.count_if
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return total(F.col(weight)), lambda e: total(F.when(e, F.col(weight)))


def threshold_table(measures: DataFrame, columns: Iterable[str], thresholds: Iterable[float], weight: str | None = None) -> DataFrame:
    """metric, threshold, pairs with at least that, and all pairs. weight: a column that says how many pairs a row is."""
    cells = [(c, t) for c in columns for t in thresholds]
    every, those = counting(weight)
    row = measures.agg(every.alias("total"), *[those(F.col(c) >= t).alias(f"c{i}") for i, (c, t) in enumerate(cells)])
    each = [F.struct(F.lit(c).alias("metric"), F.lit(float(t)).alias("threshold"), F.col(f"c{i}").alias("pairs"), "total") for i, (c, t) in enumerate(cells)]
    return row.select(F.explode(F.array(*each)).alias("x")).select("x.*").withColumn("pct", F.when(F.col("total") > 0, F.col("pairs") * 100.0 / F.col("total")).otherwise(0.0))


#: Named conditions over the measures of a pair.
CONDITIONS = {
    "name_ge_80": "name_jaccard >= 0.80",
    "address_ge_50": "address_jaccard >= 0.50",
    "name_ge_80_and_address_ge_50": "name_jaccard >= 0.80 and address_jaccard >= 0.50",
    "name_ge_80_or_address_ge_50": "name_jaccard >= 0.80 or address_jaccard >= 0.50",
    "name_lt_50_address_ge_50": "name_jaccard < 0.50 and address_jaccard >= 0.50",
    "both_lt_50": "name_jaccard < 0.50 and address_jaccard < 0.50",
    "char3_name_ge_70": "name_char3_jaccard >= 0.70",
    "char3_address_ge_70": "address_char3_jaccard >= 0.70",
    "common_number": "address_common_numbers >= 1",
    "exact_name": "name_exact_normalized = 1",
    "exact_address": "address_exact_normalized = 1",
    "exact_country": "country_exact = 1",
}


#: Named conditions over the character similarities of a pair: combined evidence, then combinations of strong and weak.
CHAR_CONDITIONS = {
    "name_ge_80_or_address_ge_50": "name_char_similarity >= 0.80 or address_char_similarity >= 0.50",
    "name_ge_80_and_address_ge_50": "name_char_similarity >= 0.80 and address_char_similarity >= 0.50",
    "name_ge_70_or_address_ge_40": "name_char_similarity >= 0.70 or address_char_similarity >= 0.40",
    "name_ge_85_or_address_ge_85": "name_char_similarity >= 0.85 or address_char_similarity >= 0.85",
    "name_jaccard_ge_50_or_address_jaccard_ge_50": "name_jaccard >= 0.50 or address_jaccard >= 0.50",
    "name_char3_ge_50_or_address_char3_ge_50": "name_char3_jaccard >= 0.50 or address_char3_jaccard >= 0.50",
    "strong_name_weak_address": "name_char_similarity >= 0.85 and address_char_similarity < 0.50",
    "weak_name_strong_address": "name_char_similarity < 0.70 and address_char_similarity >= 0.85",
    "strong_name_strong_address": "name_char_similarity >= 0.85 and address_char_similarity >= 0.85",
    "weak_name_weak_address": "name_char_similarity < 0.70 and address_char_similarity < 0.70",
}

#: Conditions that are reported for each source.
SOURCE_CONDITIONS = {
    "name_char_ge_80": "name_char_similarity >= 0.80",
    "name_char_ge_90": "name_char_similarity >= 0.90",
    "address_char_ge_80": "address_char_similarity >= 0.80",
    "address_char_ge_90": "address_char_similarity >= 0.90",
    "name_ge_80_or_address_ge_50": CHAR_CONDITIONS["name_ge_80_or_address_ge_50"],
}

#: Thresholds of the character similarities.
CHAR_THRESHOLDS = {
    "name_char_similarity": (0.50, 0.60, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95),
    "address_char_similarity": (0.30, 0.40, 0.50, 0.60, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95),
}


def high_similarity(measures: DataFrame, least: float = 0.85) -> DataFrame:
    """Pairs whose names or addresses are nearly equal."""
    return measures.where((F.col("name_char_similarity") >= least) | (F.col("address_char_similarity") >= least))


def shared_summary(rarity: DataFrame, kinds: Iterable[str] = ("name", "address")) -> DataFrame:
    """For each kind of key: pairs that share one or more, of how many, and how many a pair shares on average."""
    kinds = list(kinds)
    row = rarity.agg(F.count("*").alias("total"), *[F.count_if(F.col(f"{k}_shared_count") > 0).alias(f"{k}_n") for k in kinds], *[F.avg(f"{k}_shared_count").alias(f"{k}_mean") for k in kinds])
    each = [F.struct(F.lit(k).alias("kind"), F.col(f"{k}_n").alias("pairs_sharing"), F.col(f"{k}_mean").alias("mean_shared")) for k in kinds]
    out = row.select("total", F.explode(F.array(*each)).alias("x")).select("x.*", "total")
    return out.withColumn("pct", F.when(F.col("total") > 0, F.col("pairs_sharing") * 100.0 / F.col("total")).otherwise(0.0))


def condition_rates(measures: DataFrame, by: str | None = None, conditions: dict[str, str] | None = None, weight: str | None = None) -> DataFrame:
    """Pairs that meet each condition, of how many. weight: a column that says how many pairs a row is."""
    conditions = conditions or CONDITIONS
    every, those = counting(weight)
    aggs: list[Column] = [every.alias("total"), *[those(F.expr(e)).alias(f"c{i}") for i, e in enumerate(conditions.values())]]
    rows = measures.groupBy(by).agg(*aggs) if by else measures.agg(*aggs)
    keys = [by] if by else []
    each = F.array(*[F.struct(F.lit(n).alias("condition"), F.col(f"c{i}").alias("pairs")) for i, n in enumerate(conditions)])
    out = rows.select(*keys, "total", F.explode(each).alias("x")).select(*keys, "x.condition", "x.pairs", "total")
    return out.withColumn("pct", F.when(F.col("total") > 0, F.col("pairs") * 100.0 / F.col("total")).otherwise(0.0))


def describe(measures: DataFrame, columns: Iterable[str]) -> DataFrame:
    """metric, n, mean, std (of a sample), min, quartiles and max: exact, one pass."""
    cols = list(columns)
    aggs = []
    for c in cols:
        aggs.append(F.struct(F.lit(c).alias("metric"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min_value"), F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.max(c).cast("double").alias("max_value")).alias(c))
    row = measures.agg(*aggs)
    return row.select(F.explode(F.array(*cols)).alias("x")).select("x.metric", "x.n", "x.mean", "x.std", "x.min_value", F.col("x.q")[0].alias("q25"), F.col("x.q")[1].alias("q50"), F.col("x.q")[2].alias("q75"), "x.max_value")
