"""The queries of the linkage operators, each with its SQL counterpart.

Records are made of the sample tables: documents (words 1-8 as name, 9-24 as
address) and pages (title and url). Caps fit their size; the operators' own
defaults are for millions of records.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import normalize as N
from linkloom.functions import tokens as T
from linkloom.operators import blocking, evaluate, pairs, profile, sampling, simulate
from linkloom.operators import keys as K
from linkloom.plans import sql as S
from linkloom.sources import tables
from linkloom.sources.store import stored

STRUCTURAL_CAP, APPROXIMATE_CAP, NAME_CAP, ADDRESS_CAP = 10, 10, 5, 10
CAPS = (3, 5, 10, 20, 50, 100)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def docs(spark: SparkSession, d: str) -> DataFrame:
    return tables.document_records(spark, d)


def pages(spark: SparkSession, d: str) -> DataFrame:
    return tables.page_records(spark, d)


def records(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, "records", f"{d}/documents.parquet", lambda: docs(spark, d))


def truth(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, "truth", f"{d}/documents.parquet", lambda: pairs.shingle_truth(tables.document_texts(spark, d)))


def structural(spark: SparkSession, d: str) -> DataFrame:
    return blocking.structural(records(spark, d), STRUCTURAL_CAP)


def approximate(spark: SparkSession, d: str) -> DataFrame:
    return blocking.approximate(docs(spark, d), APPROXIMATE_CAP)


def missed(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, "missed", f"{d}/documents.parquet", lambda: pairs.missed(truth(spark, d), structural(spark, d)))


STRUCTURAL = S.structural("docs_rec", STRUCTURAL_CAP)
APPROXIMATE = S.approximate("docs_rec", APPROXIMATE_CAP, "acand")
IDS = "source1_entity_id, candidate_entity_id"


def _texts(name: str, column: Callable, expression: Callable[[str], str]) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", column("text").alias("value"))

    QUERIES[name] = run
    ORACLE[name] = f"SELECT doc_id, {expression('text')} AS value FROM documents"


_texts("normalize_ascii", N.ascii_text, S.ascii_text)
_texts("normalize_unicode", N.unicode_text, S.unicode_text)
_texts("normalize_punctuated", N.punctuated, S.punctuated)
_texts("compact_text", N.compact, S.compact)
_texts("spaced_text", N.spaced, S.spaced)
_texts("digit_masked_text", N.digit_masked, S.masked)
_texts("folded_text", N.folded, lambda x: f"strip_accents({S.unicode_text(x)})")


def _fields(name: str, records: Query, cte: str, rec: str, cols: dict[str, tuple]) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return records(spark, d).select("entity_id", *[c().alias(k) for k, (c, _) in cols.items()])

    QUERIES[name] = run
    ORACLE[name] = f"{S.with_(cte)}SELECT entity_id, {', '.join(f'{e} AS {k}' for k, (_, e) in cols.items())} FROM {rec}"


_n, _a = "business_name", "business_address"
_core = f"array_to_string(list_filter({S.words(S.unicode_text(_n))}, lambda w: w NOT IN ({S.listed(N.LEGAL_SUFFIXES)})), ' ')"
_fields(
    "structural_forms",
    docs,
    S.DOCUMENTS,
    "docs_rec",
    {
        "structural_name": (lambda: N.structural_name(_n), S.structural_name(_n)),
        "name_nosuffix": (lambda: N.name_without_suffix(_n), S.name_without_suffix(_n)),
        "name_compact": (lambda: N.name_compact(_n), f"regexp_replace({S.name_without_suffix(_n)}, '[^a-z0-9]', '', 'g')"),
        "name_sorted": (lambda: N.name_sorted(_n), S.joined_sorted(f"string_split({S.name_without_suffix(_n)}, ' ')")),
        "structural_address": (lambda: N.structural_address(_a), S.structural_address(_a)),
        "address_compact": (lambda: N.address_compact(_a), f"regexp_replace({S.structural_address(_a)}, '[^a-z0-9]', '', 'g')"),
        "core_name": (lambda: N.core_name(_n), _core),
        "sorted_name": (lambda: N.sorted_name(_n), S.joined_sorted(f"string_split({_core}, ' ')")),
    },
)


def _list(c, sort: bool = False):
    return F.array_join(F.array_sort(c) if sort else c, "|")


def _sqllist(e: str, sort: bool = False) -> str:
    return f"array_to_string({f'list_sort({e})' if sort else e}, '|')"


_fields(
    "number_forms",
    pages,
    S.PAGES,
    "pages_rec",
    {
        "number_key": (lambda: N.address_number_key(_a), S.number_key(_a)),
        "number_runs": (lambda: _list(T.number_runs(_a)), _sqllist(f"regexp_extract_all({_a}, '\\p{{Nd}}+')")),
        "numbers": (lambda: _list(T.sorted_numbers(_a)), _sqllist(S.numbers(_a), True)),
        "first_run": (lambda: F.coalesce(T.first_run(_a), F.lit("")), f"coalesce(regexp_extract_all({_a}, '\\p{{Nd}}+')[1], '')"),
        "least_number": (lambda: T.least_number(_a), f"coalesce(list_min(regexp_extract_all({_a}, '\\p{{Nd}}+')), '')"),
    },
)
_fields(
    "token_sets",
    docs,
    S.DOCUMENTS,
    "docs_rec",
    {
        "tokens": (lambda: _list(T.tokens(_n)), _sqllist(S.words(S.unicode_text(_n)))),
        "long_tokens": (lambda: _list(T.long_tokens(_n)), _sqllist(f"list_filter({S.words(S.unicode_text(_n))}, lambda w: length(w) >= 4)")),
        "ascii_set": (lambda: _list(T.ascii_token_set(_n), True), _sqllist(S.distinct(S.words(S.ascii_text(_n))), True)),
        "name_tokens": (lambda: _list(T.name_tokens(_n), True), _sqllist(S.name_tokens(_n), True)),
        "address_tokens": (lambda: _list(T.address_tokens(_a), True), _sqllist(S.address_tokens(_a), True)),
    },
)
_route_cols = {
    "char4": (lambda: T.compact_grams(_n, 4), S.distinct(S.ngrams(S.compact(_n), 4))),
    "name_grams": (lambda: T.name_grams(_n, 3), S.ngrams(f"replace({S.unicode_text(_n)}, ' ', '')", 3)),
    "spaced3": (lambda: T.spaced_grams(_n, 3), S.distinct(S.ngrams(S.spaced(_n), 3))),
    "sorted3": (lambda: T.sorted_grams(_n, 3), f"list_distinct(list_transform({S.ngrams(S.compact(_n), 3)}, lambda g: array_to_string(list_sort(string_split(g, '')), '')))"),
    "masked3": (lambda: T.masked_grams(_a, 3), S.distinct(S.ngrams(S.masked(_a), 3))),
}
_fields("gram_sets", pages, S.PAGES, "pages_rec", {k: (lambda c=c: _list(c(), True), _sqllist(e, True)) for k, (c, e) in _route_cols.items()})


def _keys(name: str, records: Query, made: Callable[[DataFrame], DataFrame], cte: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return made(records(spark, d)).groupBy("entity_id", "key_type", "key").agg(F.count("*").alias("n"))

    QUERIES[name] = run
    ORACLE[name] = f"{cte}SELECT entity_id, key_type, key, count(*) AS n FROM k GROUP BY ALL"


_keys("keys_exact", docs, K.exact_keys, S.with_(S.DOCUMENTS, S.exact_keys("docs_rec")))
_keys("keys_structural", docs, K.structural_keys, S.with_(S.DOCUMENTS, S.structural_keys("docs_rec")))
_keys("keys_approximate", docs, K.approximate_keys, S.with_(S.DOCUMENTS, S.approximate_keys("docs_rec")))
_keys("keys_approximate_pages", pages, K.approximate_keys, S.with_(S.PAGES, S.approximate_keys("pages_rec")))
_keys("keys_routes", pages, K.route_keys, S.with_(S.PAGES, S.routes("pages_rec")))
_keys("keys_components", pages, K.component_keys, S.with_(S.PAGES, S.component_keys("pages_rec")))

CANDIDATE = "source1_entity_id, candidate_entity_id, candidate_source, blocking_rules"


@query(f"{S.with_(S.DOCUMENTS, S.exact_keys('docs_rec'), S.match('k', 'k'))}SELECT {CANDIDATE} FROM cand")
def exact_candidates(spark: SparkSession, d: str) -> DataFrame:
    return blocking.exact(docs(spark, d))


@query(f"{S.with_(S.PAGES, S.exact_keys('pages_rec'), S.match('k', 'k'))}SELECT {CANDIDATE} FROM cand")
def exact_candidates_pages(spark: SparkSession, d: str) -> DataFrame:
    return blocking.exact(pages(spark, d))


@query(f"{S.with_(S.DOCUMENTS, STRUCTURAL)}SELECT {CANDIDATE} FROM cand")
def structural_candidates(spark: SparkSession, d: str) -> DataFrame:
    return structural(spark, d)


@query(f"{S.with_(S.DOCUMENTS, APPROXIMATE)}SELECT {CANDIDATE} FROM acand")
def approx_candidates(spark: SparkSession, d: str) -> DataFrame:
    return approximate(spark, d)


@query(f"{S.with_(S.DOCUMENTS, S.char4('docs_rec', NAME_CAP, ADDRESS_CAP))}SELECT {CANDIDATE} FROM cand")
def char4_candidates(spark: SparkSession, d: str) -> DataFrame:
    return blocking.char4(docs(spark, d), NAME_CAP, ADDRESS_CAP)


@query(
    f"""{S.with_(S.DOCUMENTS, STRUCTURAL, APPROXIMATE)}SELECT {IDS}, candidate_source FROM cand UNION SELECT {IDS}, candidate_source FROM acand"""
)
def candidate_union(spark: SparkSession, d: str) -> DataFrame:
    return blocking.approximate(docs(spark, d), APPROXIMATE_CAP, structural(spark, d))


@query(
    f"""{S.with_(S.DOCUMENTS, STRUCTURAL, APPROXIMATE)}, o AS (SELECT {IDS} FROM cand), n AS (SELECT {IDS} FROM acand)
    SELECT (SELECT count(*) FROM o) AS old_pairs, (SELECT count(*) FROM n) AS new_pairs, (SELECT count(*) FROM (FROM o INTERSECT FROM n)) AS both_pairs,
    (SELECT count(*) FROM (FROM o EXCEPT FROM n)) AS only_old, (SELECT count(*) FROM (FROM n EXCEPT FROM o)) AS only_new"""
)
def candidate_overlap(spark: SparkSession, d: str) -> DataFrame:
    return pairs.overlap(structural(spark, d), approximate(spark, d))


@query(f"{S.with_(S.DOCUMENTS, S.structural_keys('docs_rec'))}SELECT source, key_type, key, count(*) AS cnt FROM k GROUP BY ALL")
def key_frequency(spark: SparkSession, d: str) -> DataFrame:
    return blocking.frequency(K.structural_keys(docs(spark, d), "source"), ("source",))


@query(f"{S.with_(S.DOCUMENTS, S.component_keys('docs_rec'))}SELECT key_type, key, count(DISTINCT entity_id) AS cnt FROM k GROUP BY ALL")
def token_frequency(spark: SparkSession, d: str) -> DataFrame:
    return blocking.frequency(K.component_keys(docs(spark, d)), mode="documents")


@query(f"{S.with_(S.DOCUMENTS, S.char_keys('docs_rec'))}SELECT key_type, key, count(DISTINCT entity_id) AS cnt FROM k GROUP BY ALL")
def char4_frequency(spark: SparkSession, d: str) -> DataFrame:
    return blocking.frequency(K.char_keys(docs(spark, d)), mode="documents")


@query(
    f"""{S.with_(S.DOCUMENTS, S.exact_keys('docs_rec'))}, a AS (SELECT key_type, key, count(*) AS n1 FROM k WHERE source = 'S1' GROUP BY ALL), b AS (SELECT key_type, key, count(*) AS n2 FROM k WHERE source <> 'S1' GROUP BY ALL)
    SELECT key_type, sum(n1 * n2)::BIGINT AS join_rows, count(*) AS shared_keys FROM a JOIN b USING (key_type, key) GROUP BY key_type"""
)
def join_cost(spark: SparkSession, d: str) -> DataFrame:
    s1, sx = blocking.split_sides(docs(spark, d))
    return blocking.cost(K.exact_keys(s1), K.exact_keys(sx))


@query(f"{S.with_(S.DOCUMENTS, S.structural_keys('docs_rec'))}SELECT key_type, count(DISTINCT key) AS different_keys, count(*) AS assignments FROM k GROUP BY key_type")
def index_sizes(spark: SparkSession, d: str) -> DataFrame:
    return blocking.index_sizes(K.structural_keys(docs(spark, d)))


@query(f"{S.with_(S.DOCUMENTS, STRUCTURAL)}SELECT {CANDIDATE} FROM cand ORDER BY source1_entity_id, candidate_source, candidate_entity_id")
def sorted_candidates(spark: SparkSession, d: str) -> DataFrame:
    return blocking.ordered(structural(spark, d))


@query(f"{S.with_(S.WORDS, S.TRUTH)}SELECT {IDS} FROM truth")
def true_pairs(spark: SparkSession, d: str) -> DataFrame:
    return truth(spark, d)


@query(f"{S.with_(S.DOCUMENTS, S.TRUTH, STRUCTURAL, S.MISSED)}SELECT {IDS} FROM missed ORDER BY ALL")
def missed_pairs(spark: SparkSession, d: str) -> DataFrame:
    return missed(spark, d).orderBy(*pairs.IDS)


@query(f"{S.with_(S.DOCUMENTS, S.TRUTH, STRUCTURAL)}SELECT {IDS} FROM truth SEMI JOIN cand USING ({IDS})")
def retrieved_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs.retrieved(truth(spark, d), structural(spark, d))


def _evaluation(cand: str) -> str:
    return f""", r AS (SELECT t.* FROM truth t SEMI JOIN {cand} USING ({IDS})),
    e AS (SELECT (SELECT count(*) FROM {cand}) AS candidate_pairs, (SELECT count(*) FROM {cand} WHERE candidate_source = 'S2') AS s2_pairs, (SELECT count(*) FROM {cand} WHERE candidate_source = 'S3') AS s3_pairs,
      (SELECT count(*) FROM truth) AS true_pairs, (SELECT count(*) FROM r) AS retrieved_pairs, (SELECT count(DISTINCT source1_entity_id) FROM truth) AS s1_with_truth, (SELECT count(DISTINCT source1_entity_id) FROM r) AS s1_covered)
    SELECT *, true_pairs - retrieved_pairs AS missed_pairs, CASE WHEN true_pairs > 0 THEN retrieved_pairs / true_pairs::DOUBLE ELSE 0.0 END AS pair_recall, CASE WHEN s1_with_truth > 0 THEN s1_covered / s1_with_truth::DOUBLE ELSE 0.0 END AS s1_coverage FROM e"""


@query(S.with_(S.DOCUMENTS, S.TRUTH, S.exact_keys("docs_rec"), S.match("k", "k")) + _evaluation("cand"))
def recall_exact(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.evaluation(truth(spark, d), blocking.exact(docs(spark, d)))


@query(S.with_(S.DOCUMENTS, S.TRUTH, STRUCTURAL) + _evaluation("cand"))
def recall_structural(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.evaluation(truth(spark, d), structural(spark, d))


@query(S.with_(S.DOCUMENTS, S.TRUTH, APPROXIMATE) + _evaluation("acand"))
def recall_approximate(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.evaluation(truth(spark, d), approximate(spark, d))


_MULT = "m AS (SELECT r.entity_id AS source1_entity_id, count(c.candidate_entity_id) AS n FROM docs_rec r LEFT JOIN acand c ON r.entity_id = c.source1_entity_id WHERE r.source = 'S1' GROUP BY ALL)"


def _multiplicity(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.multiplicity(approximate(spark, d), blocking.split_sides(docs(spark, d))[0])


@query(
    f"""{S.with_(S.DOCUMENTS, APPROXIMATE, _MULT)}SELECT count(*) AS records, quantile_cont(n, 0.5)::DOUBLE AS median_candidates, quantile_cont(n, 0.9)::DOUBLE AS p90_candidates, quantile_cont(n, 0.95)::DOUBLE AS p95_candidates,
    quantile_cont(n, 0.99)::DOUBLE AS p99_candidates, max(n) AS max_candidates, avg(n) AS mean_candidates FROM m"""
)
def multiplicity_stats(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.distribution(_multiplicity(spark, d))


@query(f"{S.with_(S.DOCUMENTS, APPROXIMATE, _MULT)}SELECT t::BIGINT AS threshold, count(*) FILTER (WHERE n > t) AS records FROM m, (SELECT unnest([10, 25, 50, 100, 250, 500, 1000, 5000]) AS t) GROUP BY t")
def multiplicity_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.above(_multiplicity(spark, d))


# ---- pair measures ----

_gram = lambda x: f"CASE WHEN length({x}) = 0 THEN [] WHEN length({x}) < 3 THEN [{x}] ELSE list_distinct({S.ngrams(x, 3)}) END"
DIAGNOSED = f"""
side AS MATERIALIZED (SELECT entity_id, business_name AS name, business_address AS address, country, {S.ascii_text('business_name')} AS an, {S.ascii_text('business_address')} AS aa, {S.ascii_text('country')} AS ac, {S.numbers('business_address')} AS nu FROM docs_rec),
side2 AS MATERIALIZED (SELECT *, list_distinct({S.words('an')}) AS tn, list_distinct({S.words('aa')}) AS ta, {_gram('an')} AS gn, {_gram('aa')} AS ga FROM side),
diag AS MATERIALIZED (SELECT t.{IDS.replace(', ', ', t.')}, a.an = b.an AND a.an <> '' AS ne, a.aa = b.aa AND a.aa <> '' AS ae, a.ac = b.ac AS ce, {S.jaccard('a.tn', 'b.tn')} AS name_jaccard, {S.jaccard('a.ta', 'b.ta')} AS address_jaccard,
  {S.jaccard('a.gn', 'b.gn')} AS name_char3_jaccard, {S.jaccard('a.ga', 'b.ga')} AS address_char3_jaccard, len(list_intersect(a.nu, b.nu)) AS nums,
  a.name AS s1_name, b.name AS candidate_name, a.address AS s1_address, b.address AS candidate_address, a.country AS s1_country, b.country AS candidate_country FROM truth t JOIN side2 a ON a.entity_id = t.source1_entity_id JOIN side2 b ON b.entity_id = t.candidate_entity_id),
measures AS MATERIALIZED (SELECT {IDS}, CASE WHEN candidate_entity_id LIKE 'S2-%' THEN 'S2' WHEN candidate_entity_id LIKE 'S3-%' THEN 'S3' ELSE 'OTHER' END AS candidate_source, s1_name, candidate_name, s1_address, candidate_address, s1_country, candidate_country,
  ne::INT AS name_exact_normalized, name_jaccard, name_char3_jaccard, ae::INT AS address_exact_normalized, address_jaccard, address_char3_jaccard, nums::INT AS address_common_numbers, ce::INT AS country_exact FROM diag)"""
MEASURED = S.with_(S.DOCUMENTS, S.TRUTH, DIAGNOSED)


def measures(spark: SparkSession, d: str, ratios: bool = False) -> DataFrame:
    return pairs.diagnostics(truth(spark, d), records(spark, d), ratios)


@query(f"{MEASURED}SELECT * FROM measures")
def pair_measures(spark: SparkSession, d: str) -> DataFrame:
    return measures(spark, d)


@query()
def pair_sequence_ratio(spark: SparkSession, d: str) -> DataFrame:
    return measures(spark, d, True).select(*pairs.IDS, "name_char_similarity", "address_char_similarity")


METRICS = ("name_jaccard", "address_jaccard", "name_char3_jaccard", "address_char3_jaccard")
THRESHOLDS = tuple(x / 10 for x in range(1, 10))


@query(
    MEASURED
    + "SELECT metric, t::DOUBLE AS threshold, count(*) FILTER (WHERE v >= t) AS pairs, count(*) AS total, CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE v >= t) * 100.0::DOUBLE / count(*) ELSE 0.0 END AS pct FROM ("
    + " UNION ALL ".join(f"SELECT '{m}' AS metric, {m} AS v FROM measures" for m in METRICS)
    + f"), (SELECT unnest([{', '.join(f'{t}::DOUBLE' for t in THRESHOLDS)}]) AS t) GROUP BY metric, t"
)
def threshold_table(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.threshold_table(measures(spark, d), METRICS, THRESHOLDS)


def _conditions(by: str = "") -> str:
    keys = f"{by}, " if by else ""
    return (
        " UNION ALL ".join(
            f"SELECT {keys}'{n}' AS condition, count(*) FILTER (WHERE {e}) AS pairs, count(*) AS total, CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE {e}) * 100.0::DOUBLE / count(*) ELSE 0.0 END AS pct FROM measures" + (f" GROUP BY {by}" if by else "")
            for n, e in evaluate.CONDITIONS.items()
        )
    )


@query(MEASURED + _conditions())
def condition_rates(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.condition_rates(measures(spark, d))


@query(MEASURED + _conditions("candidate_source"))
def source_split_rates(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.condition_rates(measures(spark, d), "candidate_source")


@query(
    MEASURED
    + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, count({m}) AS n, round(avg({m}), 9) AS mean, round(stddev_samp({m}), 9) AS std, min({m}) AS min_value, quantile_cont({m}, 0.25) AS q25, quantile_cont({m}, 0.5) AS q50, quantile_cont({m}, 0.75) AS q75, max({m}) AS max_value FROM measures"
        for m in METRICS
    )
)
def metric_describe(spark: SparkSession, d: str) -> DataFrame:
    out = evaluate.describe(measures(spark, d), METRICS)
    return out.withColumns({"mean": F.round("mean", 9), "std": F.round("std", 9)})


@query(
    MEASURED
    + ", g AS ("
    + " UNION ALL ".join(f"SELECT '{k}' AS diagnostic_group, * FROM measures WHERE {e}" for k, e in sampling.STRATA.items())
    + f") SELECT {IDS}, diagnostic_group, name_jaccard, address_jaccard FROM g QUALIFY row_number() OVER (PARTITION BY diagnostic_group ORDER BY md5('42|' || source1_entity_id || '|' || candidate_entity_id), {IDS}) <= 20"
)
def stratified_examples(spark: SparkSession, d: str) -> DataFrame:
    return sampling.examples(measures(spark, d), 20).select(*pairs.IDS, "diagnostic_group", "name_jaccard", "address_jaccard")


def ratio_measures(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, "measures", f"{d}/documents.parquet", lambda: measures(spark, d, True))


def counted_ratios(spark: SparkSession, d: str, *also: str) -> DataFrame:
    """The two ratios, with other measures, of different texts and how many pairs have them."""
    names = (*evaluate.CHAR_THRESHOLDS, *also)
    return stored(spark, "-".join(("counted", *also)), f"{d}/documents.parquet", lambda: pairs.counted_diagnostics(truth(spark, d), records(spark, d), names))


@query()
def char_threshold_table(spark: SparkSession, d: str) -> DataFrame:
    own = counted_ratios(spark, d)
    tables_ = [evaluate.threshold_table(own, [c], ts, "pairs") for c, ts in evaluate.CHAR_THRESHOLDS.items()]
    return tables_[0].unionByName(tables_[1])


@query()
def char_condition_rates(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.condition_rates(counted_ratios(spark, d, *METRICS), conditions=evaluate.CHAR_CONDITIONS, weight="pairs")


@query()
def char_source_rates(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.condition_rates(counted_ratios(spark, d), "candidate_source", evaluate.SOURCE_CONDITIONS, "pairs")


@query()
def char_describe(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.describe(ratio_measures(spark, d), (*METRICS, *evaluate.CHAR_THRESHOLDS, "address_common_numbers"))


@query()
def char_examples(spark: SparkSession, d: str) -> DataFrame:
    return sampling.examples(ratio_measures(spark, d), 20, strata=sampling.CHAR_STRATA).select(*pairs.IDS, "diagnostic_group", "name_char_similarity", "address_char_similarity")


@query()
def high_similarity_pairs(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.high_similarity(ratio_measures(spark, d)).select(*pairs.IDS, "name_char_similarity", "address_char_similarity")


# ---- recovery of missed pairs ----

_CAPS = f"(SELECT unnest([{', '.join(map(str, CAPS))}]) AS cap)"
SHARED = """
ks AS MATERIALIZED (SELECT DISTINCT entity_id, key_type, key FROM kk),
kf2 AS MATERIALIZED (SELECT key_type, key, count(*) AS cnt FROM kk GROUP BY ALL),
shared AS MATERIALIZED (SELECT t.source1_entity_id, t.candidate_entity_id, a.key_type, a.key, f.cnt FROM missed t JOIN ks a ON a.entity_id = t.source1_entity_id JOIN ks b ON b.entity_id = t.candidate_entity_id AND b.key_type = a.key_type AND b.key = a.key JOIN kf2 f ON f.key_type = a.key_type AND f.key = a.key)"""


def _rare(kinds: dict[str, str]) -> str:
    cols = []
    for k, n in kinds.items():
        s = f"list_sort(list(cnt) FILTER (WHERE key_type = '{k}'))"
        cols.append(f"count(cnt) FILTER (WHERE key_type = '{k}') AS {n}_shared_count, {s}[1] AS {n}_min_freq, {s}[2] AS {n}_second_min_freq, {s}[3] AS {n}_third_min_freq, {s}[-1] AS {n}_max_freq")
    return f"\nrare AS MATERIALIZED (SELECT m.{IDS.replace(', ', ', m.')}, {', '.join(cols)} FROM missed m LEFT JOIN shared USING ({IDS}) GROUP BY ALL)"


TOKENS = S.with_(S.DOCUMENTS, S.TRUTH, STRUCTURAL, S.MISSED, S.component_keys("docs_rec", "kk"), SHARED, _rare({"name": "name", "address": "address"}))
CHARS = S.with_(S.DOCUMENTS, S.TRUTH, STRUCTURAL, S.MISSED, S.char_keys("docs_rec", 4, "kk"), SHARED, _rare({"NAME_CHAR": "name", "ADDRESS_CHAR": "address"}))


def _shared(spark: SparkSession, d: str, keys: Callable) -> DataFrame:
    k = stored(spark, keys.__name__, f"{d}/documents.parquet", lambda: keys(docs(spark, d)))
    return simulate.shared_keys(missed(spark, d), k, blocking.frequency(k))


def _rarity(spark: SparkSession, d: str, keys: Callable, kinds: dict[str, str]) -> DataFrame:
    return simulate.rarity(missed(spark, d), _shared(spark, d, keys), kinds)


def token_rarity(spark: SparkSession, d: str) -> DataFrame:
    return _rarity(spark, d, K.component_keys, {"name": "name", "address": "address"})


def char_rarity(spark: SparkSession, d: str) -> DataFrame:
    kinds = {"NAME_CHAR": "name", "ADDRESS_CHAR": "address"}
    return stored(spark, "char-rarity", f"{d}/documents.parquet", lambda: simulate.rarity_by_text(missed(spark, d), records(spark, d), K.char_keys, kinds))


def _curve(names: dict[str, str]) -> str:
    cols = [f"count(*) FILTER (WHERE {e} <= cap) AS {n}_recovered" for n, e in names.items()]
    rates = [f"count(*) FILTER (WHERE {e} <= cap) * 100.0::DOUBLE / count(*) AS {n}_pct" for n, e in names.items()]
    return f"SELECT cap::BIGINT AS cap, count(*) AS total, {', '.join(cols + rates)} FROM rare, {_CAPS} GROUP BY cap"


COMBINED = {"name": "name_min_freq", "address": "address_min_freq", "any": "coalesce(least(name_min_freq, address_min_freq), name_min_freq, address_min_freq)", "both": "CASE WHEN name_min_freq IS NOT NULL AND address_min_freq IS NOT NULL THEN greatest(name_min_freq, address_min_freq) END"}
MULTI = {"one": "name_min_freq", "two": "name_second_min_freq", "three": "name_third_min_freq"}


@query(TOKENS + _curve(COMBINED))
def token_recovery_curve(spark: SparkSession, d: str) -> DataFrame:
    return simulate.curve(token_rarity(spark, d), simulate.combined("name_min_freq", "address_min_freq"), CAPS)


@query(CHARS + _curve(COMBINED))
def rarity_recovery_curve(spark: SparkSession, d: str) -> DataFrame:
    kinds = {"NAME_CHAR": "name", "ADDRESS_CHAR": "address"}
    values = stored(spark, "counted-rarity", f"{d}/documents.parquet", lambda: simulate.counted_rarity(missed(spark, d), records(spark, d), K.char_keys, kinds))
    return simulate.curve(values, simulate.combined("name_min_freq", "address_min_freq"), CAPS, "pairs")


@query(CHARS + _curve(MULTI))
def multi_signature_curve(spark: SparkSession, d: str) -> DataFrame:
    return simulate.curve(char_rarity(spark, d), simulate.multi_signature("name"), CAPS)


@query(CHARS + "SELECT * FROM rare")
def pair_rarity(spark: SparkSession, d: str) -> DataFrame:
    return char_rarity(spark, d)


@query(CHARS + " UNION ALL ".join(f"SELECT '{k}' AS kind, count(*) FILTER (WHERE {k}_shared_count > 0) AS pairs_sharing, avg({k}_shared_count) AS mean_shared, count(*) AS total, CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE {k}_shared_count > 0) * 100.0::DOUBLE / count(*) ELSE 0.0 END AS pct FROM rare" for k in ("name", "address")))
def shared_gram_summary(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.shared_summary(char_rarity(spark, d))


POINTS = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


@query(CHARS + " UNION ALL ".join(f"SELECT '{m}' AS metric, {p}::DOUBLE AS quantile, quantile_cont({m}, {p})::DOUBLE AS freq FROM rare" for m in ("name_min_freq", "address_min_freq") for p in POINTS))
def freq_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return simulate.quantiles(char_rarity(spark, d), ("name_min_freq", "address_min_freq"), POINTS)


@query(TOKENS + "SELECT key_type, key, count(*) AS true_pair_occurrences, max(cnt) AS global_frequency FROM shared GROUP BY ALL ORDER BY true_pair_occurrences DESC, key_type, key LIMIT 50")
def top_shared_tokens(spark: SparkSession, d: str) -> DataFrame:
    return simulate.top_shared(_shared(spark, d, K.component_keys))


def _near(keys: str, value: str) -> str:
    return f"""{S.with_(S.DOCUMENTS, S.TRUTH, STRUCTURAL, S.MISSED, keys)},
kf2 AS MATERIALIZED (SELECT key_type, key, count(*) AS cnt FROM kk GROUP BY ALL HAVING count(*) <= {max(CAPS)}),
kr2 AS MATERIALIZED (SELECT DISTINCT entity_id, key_type, key, cnt FROM kk JOIN kf2 USING (key_type, key)),
near AS MATERIALIZED (SELECT a.entity_id AS source1_entity_id, b.entity_id AS candidate_entity_id, a.key_type, a.cnt FROM kr2 a JOIN kr2 b USING (key_type, key) WHERE a.entity_id IN (SELECT source1_entity_id FROM missed) AND b.entity_id IN (SELECT candidate_entity_id FROM missed)),
vals AS MATERIALIZED ({value})"""


CHAR_VALUES = f"SELECT {IDS}, key_type AS route, min(cnt) AS v FROM near GROUP BY ALL"
_kth = lambda k, i: f"(list_sort(list(cnt) FILTER (WHERE key_type = '{k}'))[{i}])"
COMPOSITE_VALUES = (
    f"SELECT {IDS}, route, v FROM (SELECT {IDS}, unnest(["
    + ", ".join(
        "{'route': '%s', 'v': %s}" % (r, _kth(*next(iter(p.items()))) if len(p) == 1 else "CASE WHEN " + " AND ".join(f"{_kth(k, n)} IS NOT NULL" for k, n in p.items()) + " THEN greatest(" + ", ".join(_kth(k, n) for k, n in p.items()) + ") END")
        for r, p in K.COMPOSITES.items()
    )
    + f"], recursive := true) FROM near GROUP BY {IDS}) WHERE v IS NOT NULL"
)


def _sweep(route_names) -> str:
    return f""",
grid AS (SELECT unnest([{S.listed(route_names)}]) AS route), caps AS {_CAPS},
per AS MATERIALIZED (SELECT g.route, c.cap, m.source1_entity_id, m.candidate_entity_id, count(v.v) AS n, coalesce(bool_or(v.candidate_entity_id = m.candidate_entity_id), false) AS hit
  FROM missed m CROSS JOIN grid g CROSS JOIN caps c LEFT JOIN vals v ON v.source1_entity_id = m.source1_entity_id AND v.route = g.route AND v.v <= c.cap GROUP BY ALL),
swept AS (SELECT route, cap::BIGINT AS cap, count(*) FILTER (WHERE hit) AS recovered, count(*) FILTER (WHERE hit) * 100.0::DOUBLE / count(*) AS recovery_pct, quantile_cont(n, 0.5)::DOUBLE AS median_candidates, quantile_cont(n, 0.9)::DOUBLE AS p90_candidates,
  quantile_cont(n, 0.95)::DOUBLE AS p95_candidates, quantile_cont(n, 0.99)::DOUBLE AS p99_candidates, max(n) AS max_candidates, sum(n)::DOUBLE / count(*) AS mean_candidates, count(*) FILTER (WHERE hit) * 100.0::DOUBLE / count(*) AS sample_coverage FROM per GROUP BY route, cap)"""


CHAR_SWEEP = _near(S.routes("docs_rec", "kk"), CHAR_VALUES) + _sweep(T.ROUTES)
COMPOSITE_SWEEP = _near(S.component_keys("docs_rec", "kk"), COMPOSITE_VALUES) + _sweep(K.COMPOSITES)


@query(f"{CHAR_SWEEP} SELECT * FROM swept")
def char_route_sweep(spark: SparkSession, d: str) -> DataFrame:
    m = missed(spark, d)
    values = stored(spark, "char-values", f"{d}/documents.parquet", lambda: simulate.char_values(m, docs(spark, d), max(CAPS)))
    return simulate.sweep(m, values, T.ROUTES, CAPS)


@query(f"{COMPOSITE_SWEEP} SELECT * FROM swept")
def composite_route_sweep(spark: SparkSession, d: str) -> DataFrame:
    m = missed(spark, d)
    values = stored(spark, "composite-values", f"{d}/documents.parquet", lambda: simulate.composite_values(m, docs(spark, d), max(CAPS)))
    return simulate.sweep(m, values, K.COMPOSITES, CAPS)


@query(f"{COMPOSITE_SWEEP} SELECT route, cap AS best_cap, recovered, recovery_pct FROM swept QUALIFY row_number() OVER (PARTITION BY route ORDER BY recovered DESC, cap) = 1")
def best_cap_per_route(spark: SparkSession, d: str) -> DataFrame:
    return simulate.best_cap(composite_route_sweep(spark, d))


_key = lambda *x: " || chr(1) || ".join(x)
_nums = f"array_to_string(list_sort({S.numbers(_a)}), '|')"
_toks = f"array_to_string(list_sort({S.address_tokens(_a)}), ' ')"
_least = f"coalesce(list_min(regexp_extract_all({_a}, '\\p{{Nd}}+')), '')"
_c = S.unicode_text("country")
DIRECT = {
    "NAME_NORMALIZED": _key(S.unicode_text(_n), _c),
    "NAME_CORE": _key(_core, _c),
    "NAME_COMPACT": _key(S.compact(_n), _c),
    "NAME_SORTED": _key(S.joined_sorted(f"string_split({_core}, ' ')"), _c),
    "ADDRESS_COMPACT": _key(S.compact(_a), _c),
    "ADDRESS_NUMBERS": f"CASE WHEN {_nums} <> '' THEN {_key(_nums, _c)} END",
    "ADDRESS_NUM_TOKEN_SET": f"CASE WHEN {_nums} <> '' AND {_toks} <> '' THEN {_key(_nums, _toks, _c)} END",
    "NAMECORE_NUM": f"CASE WHEN {_core} <> '' AND {_least} <> '' THEN {_key(_core, _least, _c)} END",
}
_overlaps = {"NAME_TOKEN_INTERSECTION": "nt", "ADDRESS_TOKEN_INTERSECTION": "at_", "ADDRESS_NUMBER_INTERSECTION": "nu"}
_names = [c for c in (*DIRECT, *_overlaps) if c.startswith("NAME_")]
_addresses = [c for c in (*DIRECT, *_overlaps, "NUMBER_AND_ADDRESS_TOKEN") if c.startswith("ADDRESS") or c == "NUMBER_AND_ADDRESS_TOKEN"]
BOOLEAN = f"""{S.with_(S.DOCUMENTS, S.TRUTH)},
rt AS MATERIALIZED (SELECT entity_id, {', '.join(f'{e} AS {k}' for k, e in DIRECT.items())}, list_distinct({S.words(S.unicode_text(_n))}) AS nt, {S.address_tokens(_a)} AS at_, {S.numbers(_a)} AS nu FROM docs_rec),
b0 AS MATERIALIZED (SELECT t.{IDS.replace(', ', ', t.')}, {', '.join(f'coalesce(a.{k} = b.{k}, false) AS {k}' for k in DIRECT)}, {', '.join(f'len(list_intersect(a.{c}, b.{c})) > 0 AS {k}' for k, c in _overlaps.items())},
  len(list_intersect(a.nu, b.nu)) > 0 AND len(list_intersect(a.at_, b.at_)) > 0 AS NUMBER_AND_ADDRESS_TOKEN FROM truth t JOIN rt a ON a.entity_id = t.source1_entity_id JOIN rt b ON b.entity_id = t.candidate_entity_id),
b1 AS MATERIALIZED (SELECT *, {' OR '.join([*DIRECT, *_overlaps, 'NUMBER_AND_ADDRESS_TOKEN'])} AS ANY_ROUTE, {' OR '.join(_names)} AS NAME_ROUTE, {' OR '.join(_addresses)} AS ADDRESS_ROUTE FROM b0)"""


@query(f"{BOOLEAN} SELECT * FROM b1")
def boolean_routes(spark: SparkSession, d: str) -> DataFrame:
    return simulate.boolean_recovery(truth(spark, d), docs(spark, d))


@query(
    BOOLEAN
    + " SELECT *, CASE WHEN total > 0 THEN recovered * 100.0::DOUBLE / total ELSE 0.0 END AS pct FROM ("
    + " UNION ALL ".join(f"SELECT '{r}' AS route, count(*) FILTER (WHERE {r}) AS recovered, count(*) AS total FROM b1" for r in (*DIRECT, *_overlaps, "NUMBER_AND_ADDRESS_TOKEN", "ANY_ROUTE", "NAME_ROUTE", "ADDRESS_ROUTE"))
    + ")"
)
def route_ranking(spark: SparkSession, d: str) -> DataFrame:
    return simulate.route_ranking(boolean_routes(spark, d))


# ---- profiles ----

FIELDS = ("entity_id", "business_name", "business_address", "country")


@query(S.with_(S.PAGES) + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL OR {c} = '') AS missing, count(*) AS total, count(*) FILTER (WHERE {c} IS NULL OR {c} = '') * 100.0::DOUBLE / count(*) AS pct FROM pages_rec" for c in FIELDS))
def profile_missing(spark: SparkSession, d: str) -> DataFrame:
    return profile.missing(pages(spark, d), FIELDS)


@query(f"{S.with_(S.PAGES)}SELECT source, coalesce(nullif(country, ''), '<MISSING>') AS value, count(*) AS n FROM pages_rec GROUP BY ALL")
def value_distribution(spark: SparkSession, d: str) -> DataFrame:
    return profile.value_distribution(pages(spark, d), "country", "source")


@query(f"{S.with_(S.PAGES)}SELECT source, count(*) AS rows, {', '.join(f'count(DISTINCT {c}) AS distinct_{c}' for c in FIELDS)} FROM pages_rec GROUP BY source")
def profile_source(spark: SparkSession, d: str) -> DataFrame:
    return profile.distinct_counts(pages(spark, d), FIELDS, "source")


@query(
    S.with_(S.DOCUMENTS)
    + "SELECT column_name, count(*) AS repeated_values, sum(n)::BIGINT AS rows_with_them FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS value, count(*) AS n FROM docs_rec GROUP BY ALL HAVING count(*) > 1" for c in FIELDS)
    + ") GROUP BY column_name"
)
def duplicate_values(spark: SparkSession, d: str) -> DataFrame:
    return profile.repeated_values(docs(spark, d), FIELDS)


@query(
    S.with_(S.DOCUMENTS)
    + " UNION ALL ".join(f"SELECT source, '{c}' AS column_name, count(*) AS \"values\", min(length({c}))::INT AS min_length, quantile_cont(length({c}), 0.5)::DOUBLE AS median_length, avg(length({c})) AS mean_length, max(length({c}))::INT AS max_length FROM docs_rec GROUP BY source" for c in ("business_name", "business_address"))
)
def length_profile(spark: SparkSession, d: str) -> DataFrame:
    return profile.lengths(docs(spark, d), ("business_name", "business_address"), "source")


GT = """
gt AS MATERIALIZED (SELECT r.entity_id AS source1_entity_id, coalesce(string_agg(t.candidate_entity_id, ',' ORDER BY t.candidate_entity_id), '') AS matched_entity_ids FROM docs_rec r LEFT JOIN truth t ON t.source1_entity_id = r.entity_id WHERE r.source = 'S1' GROUP BY ALL),
gc AS MATERIALIZED (SELECT source1_entity_id, ids, len(ids) AS matches, len(list_filter(ids, lambda x: x LIKE 'S2-%')) AS s2, len(list_filter(ids, lambda x: x LIKE 'S3-%')) AS s3 FROM (SELECT *, list_filter(string_split(matched_entity_ids, ','), lambda x: x <> '') AS ids FROM gt))"""
LISTED = S.with_(S.DOCUMENTS, S.TRUTH, GT)


def listed(spark: SparkSession, d: str) -> DataFrame:
    return pairs.ground_truth(truth(spark, d), blocking.split_sides(docs(spark, d))[0])


@query(f"{LISTED}SELECT * FROM gt")
def ground_truth_lists(spark: SparkSession, d: str) -> DataFrame:
    return listed(spark, d)


@query(f"{LISTED}SELECT source1_entity_id, unnest(ids) AS candidate_entity_id FROM gc")
def ground_truth_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs.truth_pairs(listed(spark, d))


@query(f"{LISTED}SELECT matches::BIGINT AS matches, count(*) AS entities FROM gc GROUP BY 1")
def gt_match_distribution(spark: SparkSession, d: str) -> DataFrame:
    return profile.match_distribution(listed(spark, d))


@query(f"{LISTED}SELECT count(*) AS rows, count(DISTINCT source1_entity_id) AS entities, count(*) FILTER (WHERE matches = 0) AS without_match, count(*) FILTER (WHERE matches = 1) AS with_one, count(*) FILTER (WHERE matches >= 1) AS with_some, sum(matches)::BIGINT AS total_matches, max(matches)::BIGINT AS max_matches, avg(matches) AS mean_matches, quantile_cont(matches, 0.5)::DOUBLE AS median_matches FROM gc")
def gt_match_summary(spark: SparkSession, d: str) -> DataFrame:
    return profile.match_summary(listed(spark, d))


@query(f"{LISTED}SELECT CASE WHEN matches = 0 THEN 'NONE' ELSE 'S2=' || s2 || ', S3=' || s3 END AS pattern, s2::BIGINT AS s2, s3::BIGINT AS s3, count(*) AS entities FROM gc GROUP BY ALL")
def gt_source_pattern(spark: SparkSession, d: str) -> DataFrame:
    return profile.source_patterns(listed(spark, d))


@query(f"{LISTED}SELECT source1_entity_id, matched_entity_ids, CASE WHEN row_number() OVER (ORDER BY md5('42|' || source1_entity_id), source1_entity_id) <= floor((SELECT count(*) FROM gt) * 0.8) THEN 'train' ELSE 'validation' END AS part FROM gt")
def validation_split(spark: SparkSession, d: str) -> DataFrame:
    return sampling.split(listed(spark, d), "source1_entity_id")


@query(f"{S.with_(S.DOCUMENTS, S.TRUTH)}SELECT {IDS} FROM truth ORDER BY md5('42|' || source1_entity_id || '|' || candidate_entity_id), {IDS} LIMIT 50")
def pair_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample(truth(spark, d), 50, *pairs.IDS)


@query(f"{S.with_(S.DOCUMENTS, S.TRUTH, STRUCTURAL, S.MISSED)}SELECT r.* FROM docs_rec r WHERE entity_id IN (SELECT candidate_entity_id FROM missed)")
def missed_records(spark: SparkSession, d: str) -> DataFrame:
    return tables.lookup(docs(spark, d), missed(spark, d), "candidate_entity_id")


_VALIDATION = """
part AS MATERIALIZED (SELECT source1_entity_id FROM gt QUALIFY row_number() OVER (ORDER BY md5('42|' || source1_entity_id), source1_entity_id) > floor((SELECT count(*) FROM gt) * 0.8)),
all_truth AS MATERIALIZED (SELECT * FROM truth), all_cand AS MATERIALIZED (SELECT * FROM cand)"""
_VALIDATED = _evaluation("vcand").replace("FROM truth", "FROM vtruth")


@query(
    f"""{S.with_(S.DOCUMENTS, S.TRUTH, STRUCTURAL, GT, _VALIDATION)}, vtruth AS MATERIALIZED (SELECT t.* FROM all_truth t SEMI JOIN part USING (source1_entity_id)), vcand AS MATERIALIZED (SELECT c.* FROM all_cand c SEMI JOIN part USING (source1_entity_id))"""
    + _VALIDATED
)
def validation_recall(spark: SparkSession, d: str) -> DataFrame:
    """The structural blocker on the validation part of the split: only its S1 records are blocked and evaluated."""
    part = sampling.split(listed(spark, d), "source1_entity_id").where("part = 'validation'")
    records = docs(spark, d)
    s1 = tables.lookup(records.where("source = 'S1'"), part, "source1_entity_id")
    return evaluate.evaluation(pairs.truth_pairs(part), blocking.structural(s1.unionByName(records.where("source <> 'S1'")), STRUCTURAL_CAP))
