"""Key generators: records to long tables (entity_id, key_type, key).

Parts of a key are joined by \\u0001. One long table per record set, never a
join with OR.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import normalize as N
from linkloom.functions import tokens as T

SEP = "\u0001"


def _typed(kind: str, keys: Column) -> Column:
    return F.transform(keys, lambda k: F.struct(F.lit(kind).alias("key_type"), k.alias("key")))


def _spread(records: DataFrame, typed: dict[str, Column], *also: str) -> DataFrame:
    """Rows of all non-empty keys; a column may hold one key or an array of them."""
    parts = [_typed(kind, c) for kind, c in typed.items()]
    rows = records.select("entity_id", *also, F.explode(F.concat(*parts)).alias("k"))
    return rows.select("entity_id", *also, "k.key_type", "k.key")


def _one(c: Column) -> Column:
    """An array of the key, or none if it is empty."""
    return F.filter(F.array(c), lambda k: k.isNotNull() & (k != ""))


def _pair(a: Column, b: Column) -> Column:
    return F.when((a != "") & (b != ""), F.concat_ws(SEP, a, b))


def exact_keys(records: DataFrame, *also: str) -> DataFrame:
    name, address, country = N.ascii_text("business_name"), N.ascii_text("business_address"), N.ascii_text("country")
    return _spread(records, {"NAME": _one(name), "ADDRESS": _one(address), "NAME_COUNTRY": _one(_pair(name, country)), "ADDRESS_COUNTRY": _one(_pair(address, country))}, *also)


def structural_keys(records: DataFrame, *also: str) -> DataFrame:
    n, a = "business_name", "business_address"
    return _spread(
        records,
        {
            "NAME_STRUCT": _one(N.structural_name(n)),
            "NAME_NOSUFFIX": _one(N.name_without_suffix(n)),
            "NAME_COMPACT": _one(N.name_compact(n)),
            "NAME_SORTED": _one(N.name_sorted(n)),
            "ADDRESS_STRUCT": _one(N.structural_address(a)),
            "ADDRESS_COMPACT": _one(N.address_compact(a)),
            "ADDRESS_NUMBERS": _one(N.address_number_key(a)),
        },
        *also,
    )


def _pairs(s: Column) -> Column:
    """All pairs (i before j) of an array, in order."""

    def pairs(x: Column) -> Column:
        return F.flatten(F.transform(x, lambda y, i: F.transform(F.slice(x, i + 2, F.greatest(F.size(x), F.lit(1))), lambda z: F.concat_ws(SEP, y, z))))

    return T.let(s, pairs)


def ordered_pairs(a: Column, first: int) -> Column:
    """All pairs (i before j) of the first elements, in order."""
    return _pairs(F.slice(a, 1, first))


def singles(grams: Column) -> Column:
    """Grams that occur exactly once."""

    def once(g: Column) -> Column:
        return F.filter(F.array_distinct(g), lambda x: F.size(F.filter(g, lambda y: y == x)) == 1)

    return T.let(grams, once)


def prepared(records: DataFrame, *also: str) -> DataFrame:
    """Normalised once: every expression below reads columns, not the normalisers again."""
    return records.select(
        "entity_id",
        *also,
        N.unicode_text("business_name").alias("n"),
        N.unicode_text("business_address").alias("a"),
        N.unicode_text("country").alias("c"),
        N.text("country").alias("raw_country"),
        F.coalesce(T.first_run("business_address"), F.lit("")).alias("num"),
    )


def approximate_keys(records: DataFrame, *also: str) -> DataFrame:
    """Tokens, token pairs, single and folded 3-grams of names; numbers with tokens, token pairs, numbers with country of addresses.

    Keys repeat as they occur: a token twice in a name is two keys.
    """
    r = prepared(records, *also)
    r = r.withColumn("fold", N.ascii_fold(F.col("n")))
    joined = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    r = r.select("*", T.ngrams(joined(F.col("n")), 3).alias("g"), T.ngrams(joined(F.col("fold")), 3).alias("fg"), F.filter(T.words(F.col("n")), lambda x: F.length(x) >= 5).alias("nt"), F.filter(T.words(F.col("a")), lambda x: F.length(x) >= 5).alias("at"))
    none = F.array().cast(T.EMPTY)
    some = (F.col("a") != "") & (F.col("num") != "")
    return _spread(
        r,
        {
            "NAME_TOKEN": F.col("nt"),
            "NAME_TOKEN_PAIR": ordered_pairs(F.col("nt"), 6),
            "NAME_3GRAM": singles(F.col("g")),
            "NAME_FOLD_3GRAM": F.when(F.col("fold") != F.col("n"), F.array_distinct("fg")).otherwise(none),
            "ADDR_NUM_TOKEN": F.when(some, F.transform("at", lambda t: F.concat_ws(SEP, F.col("num"), t))).otherwise(none),
            "ADDR_TOKEN_PAIR": ordered_pairs(F.filter("at", lambda t: F.length(t) >= 6), 8),
            "ADDR_NUM_COUNTRY": F.when(some & (F.col("raw_country") != ""), F.array(F.concat_ws(SEP, "num", "c"))).otherwise(none),
        },
        *also,
    )


def char_keys(records: DataFrame, n: int = 4, *also: str) -> DataFrame:
    r = records.select("entity_id", *also, N.compact("business_name").alias("n"), N.compact("business_address").alias("a"))
    return _spread(r, {"NAME_CHAR": F.array_distinct(T.ngrams(F.col("n"), n)), "ADDRESS_CHAR": F.array_distinct(T.ngrams(F.col("a"), n))}, *also)


def route_keys(records: DataFrame, routes: tuple[str, ...] = tuple(T.ROUTES), *also: str) -> DataFrame:
    return _spread(records, {r: T.route(r) for r in routes}, *also)


def components(records: DataFrame, *also: str) -> DataFrame:
    """Country, name tokens, address tokens and numbers of each record."""
    return records.select("entity_id", *also, N.unicode_text("country").alias("country"), T.name_tokens("business_name").alias("name_tokens"), T.address_tokens("business_address").alias("address_tokens"), T.number_set("business_address").alias("numbers"))


def component_keys(records: DataFrame, *also: str) -> DataFrame:
    """Components as a long table: the parts of composite routes."""
    c = components(records, *also)
    return _spread(c, {"name": F.col("name_tokens"), "address": F.col("address_tokens"), "number": F.col("numbers")}, *also)


def unordered_pairs(a: Column) -> Column:
    return _pairs(F.array_sort(a))


def cross(first: Column, *others: Column) -> Column:
    """One key for each choice of an element from every array."""
    out = first
    for b in others:
        out = _cross(out, b)
    return out


def _cross(a: Column, b: Column) -> Column:
    return T.let(b, lambda y: F.flatten(F.transform(a, lambda x: F.transform(y, lambda z: F.concat_ws(SEP, x, z)))))


#: Composite routes: how many components of each kind a key has.
COMPOSITES = {
    "NAME_NAME": {"name": 2},
    "ADDRESS_ADDRESS": {"address": 2},
    "ADDRESS_NUMBER": {"address": 1, "number": 1},
    "NAME_ADDRESS": {"name": 1, "address": 1},
    "NAME_NUMBER": {"name": 1, "number": 1},
    "NAME_ADDRESS_NUMBER": {"name": 1, "address": 1, "number": 1},
}


def boolean_routes(records: DataFrame) -> DataFrame:
    """One column per direct route; all carry the country, so that empty equals empty where the country does."""
    c = N.unicode_text("country")
    numbers = F.array_join(T.sorted_numbers("business_address"), "|")
    key = lambda x: F.concat_ws(SEP, x, c)
    return records.select(
        "entity_id",
        key(N.unicode_text("business_name")).alias("NAME_NORMALIZED"),
        key(N.core_name("business_name")).alias("NAME_CORE"),
        key(N.compact("business_name")).alias("NAME_COMPACT"),
        key(N.sorted_name("business_name")).alias("NAME_SORTED"),
        key(N.compact("business_address")).alias("ADDRESS_COMPACT"),
        F.when(numbers != "", key(numbers)).alias("ADDRESS_NUMBERS"),
        F.when((numbers != "") & (F.size(T.address_tokens("business_address")) > 0), F.concat_ws(SEP, numbers, F.array_join(F.array_sort(T.address_tokens("business_address")), " "), c)).alias("ADDRESS_NUM_TOKEN_SET"),
        F.when((N.core_name("business_name") != "") & (T.least_number("business_address") != ""), F.concat_ws(SEP, N.core_name("business_name"), T.least_number("business_address"), c)).alias("NAMECORE_NUM"),
    )
