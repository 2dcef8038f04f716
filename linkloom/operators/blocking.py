"""Candidate generation: one plan for all blockers.

Keys of both sides meet by equi-join on (key_type, key); a pair's rules are
collected. Frequency caps are part of the semantics: which keys are counted,
and how, is a parameter. Caps also bound the join: a capped key has at most
``cap`` rows on the candidate side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators import keys as K

KEY = ["key_type", "key"]


def split_sides(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The reference side S1, and the candidate side with its source."""
    return records.where("source = 'S1'"), records.where("source <> 'S1'")


def frequency(keys: DataFrame, by: tuple[str, ...] = (), mode: str = "rows") -> DataFrame:
    """cnt of each key within ``by``. mode: "rows" counts occurrences, "documents" the records that have it."""
    count = F.count("*") if mode == "rows" else F.countDistinct("entity_id")
    return keys.groupBy(*by, *KEY).agg(count.alias("cnt"))


def wanted(keys: DataFrame, reference: DataFrame) -> DataFrame:
    """Only keys that the reference side has too: counting fewer, with the same counts for those."""
    return keys.join(reference.select(*KEY).distinct(), KEY, "left_semi")


def rare(keys: DataFrame, freq: DataFrame, cap: int, by: tuple[str, ...] = ()) -> DataFrame:
    return keys.join(freq.where(F.col("cnt") <= cap).drop("cnt"), [*by, *KEY], "left_semi")


def match(reference: DataFrame, candidates: DataFrame) -> DataFrame:
    """Pairs that share a key, with their rules (sorted, joined by |)."""
    left = reference.select(F.col("entity_id").alias("source1_entity_id"), *KEY).distinct()
    right = candidates.select(F.col("entity_id").alias("candidate_entity_id"), F.col("source").alias("candidate_source"), *KEY).distinct()
    pairs = left.join(right, KEY).groupBy("source1_entity_id", "candidate_entity_id", "candidate_source")
    return pairs.agg(F.array_join(F.array_sort(F.collect_set("key_type")), "|").alias("blocking_rules"))


def cost(reference: DataFrame, candidates: DataFrame) -> DataFrame:
    """Rows that the key join would make, by key type: an aggregate to look at before joining."""
    a = reference.groupBy(*KEY).agg(F.count("*").alias("n1"))
    b = candidates.groupBy(*KEY).agg(F.count("*").alias("n2"))
    return a.join(b, KEY).groupBy("key_type").agg(F.sum(F.col("n1") * F.col("n2")).cast("long").alias("join_rows"), F.count("*").alias("shared_keys"))


def index_sizes(keys: DataFrame) -> DataFrame:
    """For each key type: different keys, and assignments of keys to records."""
    return keys.groupBy(*KEY).agg(F.count("*").alias("n")).groupBy("key_type").agg(F.count("*").alias("different_keys"), F.sum("n").alias("assignments"))


def ordered(candidates: DataFrame) -> DataFrame:
    """Candidates by S1 record, source and candidate, as they are written."""
    return candidates.orderBy("source1_entity_id", "candidate_source", "candidate_entity_id")


def exact(records: DataFrame, most_rows: int | None = None) -> DataFrame:
    """Equal names or addresses, alone or with the country.

    Keys have no cap here: n and m records of one name are n * m pairs. With
    ``most_rows``, the join's rows are counted first, and a ValueError names the
    key types that would make more.
    """
    s1, sx = split_sides(records)
    a, b = K.exact_keys(s1), K.exact_keys(sx, "source")
    if most_rows is not None and (large := cost(a, b).where(F.col("join_rows") > most_rows).collect()):
        raise ValueError("too many pairs: " + ", ".join(f"{r.key_type} {r.join_rows}" for r in large))
    return match(a, b)


def structural(records: DataFrame, cap: int = 50) -> DataFrame:
    """Seven structural keys; a key counts within each candidate source, at most ``cap`` rows of it."""
    s1, sx = split_sides(records)
    k = K.structural_keys(sx, "source")
    return match(K.structural_keys(s1), rare(k, frequency(k, ("source",)), cap, ("source",)))


def approximate(records: DataFrame, cap: int = 100, structural_pairs: DataFrame | None = None) -> DataFrame:
    """Approximate signatures; occurrences of a key within each candidate source are capped. With ``structural_pairs``, their union."""
    s1, sx = split_sides(records)
    a = K.approximate_keys(s1)
    b = wanted(K.approximate_keys(sx, "source"), a)
    pairs = match(a, rare(b, frequency(b, ("source",)), cap, ("source",)))
    if structural_pairs is None:
        return pairs
    ids = ["source1_entity_id", "candidate_entity_id", "candidate_source"]
    return pairs.select(*ids).unionByName(structural_pairs.select(*ids)).distinct()


def char4(records: DataFrame, name_cap: int = 5_000, address_cap: int = 10_000, n: int = 4) -> DataFrame:
    """Compact character n-grams whose records in all sources together, S1 included, are at most the caps."""
    k = K.char_keys(records, n, "source")
    s1 = k.where("source = 'S1'")
    freq = frequency(wanted(k, s1), mode="documents")
    cap = F.when(F.col("key_type") == "NAME_CHAR", name_cap).otherwise(address_cap)
    few = freq.where(F.col("cnt") <= cap).drop("cnt")
    return match(s1.join(few, KEY, "left_semi"), k.where("source <> 'S1'").join(few, KEY, "left_semi"))
