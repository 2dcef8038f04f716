"""Profiles of sources and of ground truth."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators.pairs import matched_ids


def missing(df: DataFrame, columns: Iterable[str], blank: bool = True) -> DataFrame:
    """column, missing values, rows and percentage; ``blank`` text counts as missing."""
    cols = list(columns)
    gone = lambda c: F.col(c).isNull() | (F.lit(blank) & (F.col(c).cast("string") == ""))
    row = df.agg(F.count("*").alias("total"), *[F.count_if(gone(c)).alias(c) for c in cols])
    each = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("missing")) for c in cols])
    out = row.select("total", F.explode(each).alias("x")).select("x.column_name", "x.missing", "total")
    return out.withColumn("pct", F.when(F.col("total") > 0, F.col("missing") * 100.0 / F.col("total")).otherwise(0.0))


def value_distribution(df: DataFrame, column: str, *by: str) -> DataFrame:
    value = F.coalesce(F.nullif(F.col(column).cast("string"), F.lit("")), F.lit("<MISSING>"))
    return df.groupBy(*by, value.alias("value")).agg(F.count("*").alias("n")).orderBy(*by, F.desc("n"), "value")


def distinct_counts(df: DataFrame, columns: Iterable[str], *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("rows"), *[F.countDistinct(c).alias(f"distinct_{c}") for c in columns])


def repeated_values(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """column, different values that occur more than once, and the rows that hold them."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")
    n = df.select(each).select("x.*").where("value is not null").groupBy("column_name", "value").agg(F.count("*").alias("n")).where("n > 1")
    return n.groupBy("column_name").agg(F.count("*").alias("repeated_values"), F.sum("n").cast("long").alias("rows_with_them"))


def lengths(df: DataFrame, columns: Iterable[str], *by: str) -> DataFrame:
    """Least, median, mean and greatest length in code points; nulls are left out."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.length(c).alias("n")) for c in columns])).alias("x")
    rows = df.select(*by, each).select(*by, "x.*").where("n is not null")
    return rows.groupBy(*by, "column_name").agg(F.count("*").alias("values"), F.min("n").alias("min_length"), F.percentile("n", F.lit(0.5)).alias("median_length"), F.avg("n").alias("mean_length"), F.max("n").alias("max_length"))


def with_counts(ground_truth: DataFrame) -> DataFrame:
    ids = matched_ids()
    of = lambda p: F.size(F.filter(ids, lambda x: x.startswith(p))).cast("long")
    return ground_truth.select("source1_entity_id", F.size(ids).cast("long").alias("matches"), of("S2-").alias("s2"), of("S3-").alias("s3"))


def match_distribution(ground_truth: DataFrame) -> DataFrame:
    return with_counts(ground_truth).groupBy("matches").agg(F.count("*").alias("entities")).orderBy("matches")


def match_summary(ground_truth: DataFrame) -> DataFrame:
    c = with_counts(ground_truth)
    return c.agg(
        F.count("*").alias("rows"),
        F.countDistinct("source1_entity_id").alias("entities"),
        F.count_if(F.col("matches") == 0).alias("without_match"),
        F.count_if(F.col("matches") == 1).alias("with_one"),
        F.count_if(F.col("matches") >= 1).alias("with_some"),
        F.sum("matches").cast("long").alias("total_matches"),
        F.max("matches").alias("max_matches"),
        F.avg("matches").alias("mean_matches"),
        F.percentile("matches", F.lit(0.5)).alias("median_matches"),
    )


def source_patterns(ground_truth: DataFrame) -> DataFrame:
    """Composition by source ("S2=x, S3=y", NONE without matches): entities of each, by matches, NONE last."""
    c = with_counts(ground_truth)
    pattern = F.when(F.col("matches") == 0, "NONE").otherwise(F.concat(F.lit("S2="), F.col("s2").cast("string"), F.lit(", S3="), F.col("s3").cast("string")))
    g = c.groupBy(pattern.alias("pattern"), "s2", "s3").agg(F.count("*").alias("entities"))
    return g.orderBy(F.when(F.col("pattern") == "NONE", 999).otherwise(F.col("s2") + F.col("s3")), "pattern")
