"""Tables in tab-separated text and Parquet, and records made of the sample tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from linkloom.functions import normalize as N
from linkloom.functions import tokens as T


def strings(*names: str) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


RECORD = strings("entity_id", "business_name", "business_address", "country")
GROUND_TRUTH = strings("source1_entity_id", "matched_entity_ids")
PAIR = strings("source1_entity_id", "candidate_entity_id")
CANDIDATE = strings("source1_entity_id", "candidate_entity_id", "candidate_source", "blocking_rules")
DIAGNOSTIC = StructType(
    [
        *strings("source1_entity_id", "candidate_entity_id", "candidate_source", "s1_name", "candidate_name", "s1_address", "candidate_address", "s1_country", "candidate_country").fields,
        StructField("name_exact_normalized", LongType()),
        *[StructField(n, DoubleType()) for n in ("name_jaccard", "name_char_similarity", "name_char3_jaccard")],
        StructField("address_exact_normalized", LongType()),
        *[StructField(n, DoubleType()) for n in ("address_jaccard", "address_char_similarity", "address_char3_jaccard")],
        StructField("address_common_numbers", LongType()),
        StructField("country_exact", LongType()),
    ]
)

#: Texts that a profiling scan takes for missing.
NA_TEXTS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def read_tsv(spark: SparkSession, path: str | list[str], schema: StructType, missing: str = "empty", lines_in_values: bool = False) -> DataFrame:
    """A table with a header, types as declared. missing: "empty" keeps blanks as empty text and NA texts as they are; "null" makes both null.

    The file's columns may be more, and in another order, than the schema's. A
    large file is read in splits, unless ``lines_in_values``: quoted values may
    then hold line ends, and a file is one task.
    """
    raw = spark.read.csv(path, sep="\t", header=True, quote='"', escape='"', multiLine=lines_in_values, inferSchema=False)
    cols = []
    for f in schema.fields:
        c = F.col(f"`{f.name}`")
        if missing == "null":
            c = F.when(~c.isin(*NA_TEXTS), c)
        elif isinstance(f.dataType, StringType):
            c = F.coalesce(c, F.lit(""))
        cols.append((c if isinstance(f.dataType, StringType) else c.try_cast(f.dataType)).alias(f.name))
    return raw.select(*cols)


def write_tsv(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """As many files as there are partitions; with ``order``, sorted in the order of their names."""
    out = df.orderBy(*order) if order else df
    out.write.csv(path, sep="\t", header=True, quote='"', escape='"', emptyValue="")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in an order: a head, not a sample."""
    return df.orderBy(*order).limit(n)


def existing(df: DataFrame, columns: list[str]) -> DataFrame:
    """Those of the columns that the table has, in the order asked for."""
    return df.select(*[c for c in columns if c in df.columns])


def lookup(records: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Records whose id is in a column of ``ids``."""
    return records.join(ids.select(F.col(column).alias("entity_id")).distinct(), "entity_id", "left_semi")


def with_source(sources: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in sources.items():
        own = df.withColumn("source", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


def numbered_source(key: Column) -> Column:
    return F.concat(F.lit("S"), (1 + key % 3).cast("string"))


def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the sample pages: title, url and language."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    s = numbered_source(F.col("page_id"))
    return p.select(
        F.concat(s, F.lit("-"), F.col("page_id").cast("string")).alias("entity_id"),
        N.text(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)).alias("business_name"),
        N.text("url").alias("business_address"),
        N.text(F.regexp_extract("html", 'lang="([^"]*)"', 1)).alias("country"),
        s.alias("source"),
    )


def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample documents in lower case."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    s = numbered_source(F.col("doc_id"))
    return d.select(F.concat(s, F.lit("-"), F.col("doc_id").cast("string")).alias("entity_id"), F.lower(N.text("text")).alias("text"), N.text("lang").alias("country"), s.alias("source"))


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the sample documents: words 1-8 as name, 9-24 as address, language as country."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    s = numbered_source(F.col("doc_id"))
    # only as much of the text as holds these words is normalised
    head = F.regexp_extract(F.lower(N.text("text")), "^(?:[^a-z0-9]*+[a-z0-9]++){0,24}", 0)
    w = d.select(F.concat(s, F.lit("-"), F.col("doc_id").cast("string")).alias("entity_id"), T.words(N.ascii_text(head)).alias("w"), N.text("lang").alias("country"), s.alias("source"))
    part = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    return w.select("entity_id", part(1, 8).alias("business_name"), part(9, 16).alias("business_address"), "country", "source")
