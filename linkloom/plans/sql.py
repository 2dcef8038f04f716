"""Pieces of SQL from which the queries' counterparts are put together."""

from __future__ import annotations

from linkloom.functions import normalize as N


def ascii_text(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', ' ', 'g'))"


def composed(x: str) -> str:
    return f"nfc_normalize(lower(coalesce({x}, '')))"


def unicode_text(x: str) -> str:
    return f"trim(regexp_replace({composed(x)}, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"


def compact(x: str) -> str:
    return f"regexp_replace({composed(x)}, '[^\\p{{L}}\\p{{N}}_]', '', 'g')"


def punctuated(x: str) -> str:
    return f"trim(regexp_replace({composed(x)}, '\\s+', ' ', 'g'))"


def spaced(x: str) -> str:
    return f"regexp_replace({punctuated(x)}, '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g')"


def masked(x: str) -> str:
    kept = f"regexp_replace({punctuated(x)}, '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g')"
    return f"trim(regexp_replace(regexp_replace({kept}, '\\p{{Nd}}+', '#', 'g'), '\\s+', ' ', 'g'))"


def replaced(x: str, words: tuple[tuple[str, str], ...]) -> str:
    for old, new in words:
        x = f"regexp_replace({x}, '\\b{old}\\b', '{new}', 'g')"
    return x


def structural_name(x: str) -> str:
    return replaced(ascii_text(x), N.NAME_WORDS)


def name_without_suffix(x: str) -> str:
    forms = "|".join(N.TRAILING_FORMS)
    return f"regexp_replace({structural_name(x)}, '(^|\\s+)({forms})(\\s+({forms}))*$', '')"


def structural_address(x: str) -> str:
    return replaced(ascii_text(x), N.ADDRESS_WORDS)


def words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def joined_sorted(x: str) -> str:
    return f"array_to_string(list_sort({x}), ' ')"


def number_key(x: str) -> str:
    runs = f"regexp_extract_all({structural_address(x)}, '[0-9]+')"
    return f"CASE WHEN len({runs}) >= 2 THEN array_to_string(list_sort(list_distinct({runs})), '|') ELSE '' END"


def ngrams(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) >= {n} THEN list_transform(range(1, greatest(length({x}) - {n - 1}, 1) + 1), lambda i: substring({x}, i, {n})) ELSE [] END"


def distinct(x: str) -> str:
    return f"list_distinct({x})"


def jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b})))::DOUBLE END"


def listed(items) -> str:
    return ", ".join(f"'{x}'" for x in items)


PAGES = """
pages_rec AS MATERIALIZED (SELECT 'S' || (1 + page_id % 3) || '-' || page_id AS entity_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS business_name,
  coalesce(url, '') AS business_address, regexp_extract(html, 'lang="([^"]*)"', 1) AS country, 'S' || (1 + page_id % 3) AS source FROM pages)"""

WORDS = f"""
doc_words AS MATERIALIZED (SELECT 'S' || (1 + doc_id % 3) || '-' || doc_id AS entity_id, {words(ascii_text("text"))} AS w, coalesce(lang, '') AS country, 'S' || (1 + doc_id % 3) AS source FROM documents)"""

DOCUMENTS = f"""{WORDS},
docs_rec AS MATERIALIZED (SELECT entity_id, array_to_string(w[1:8], ' ') AS business_name, array_to_string(w[9:24], ' ') AS business_address, country, source FROM doc_words)"""

#: Pairs of the evaluation: similar beyond the words that the records are made of.
TRUTH = """
truth_sets AS MATERIALIZED (SELECT entity_id, source, list_distinct(list_transform(range(1, len(r) - 1), lambda i: array_to_string(r[i:i + 2], ' '))) AS g
  FROM (SELECT entity_id, source, w[25:] AS r FROM doc_words WHERE len(w) >= 24) WHERE len(r) >= 3),
truth_long AS MATERIALIZED (SELECT entity_id, source, len(g) AS n, unnest(g) AS t FROM truth_sets),
truth AS MATERIALIZED (SELECT a.entity_id AS source1_entity_id, b.entity_id AS candidate_entity_id FROM truth_long a JOIN truth_long b USING (t)
  WHERE a.source = 'S1' AND b.source <> 'S1' GROUP BY ALL HAVING count(*) >= 0.5 * (any_value(a.n) + any_value(b.n) - count(*)))"""


def with_(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


SEP = "chr(1)"


def exact_keys(rec: str, name: str = "k") -> str:
    a, b, c = ascii_text("business_name"), ascii_text("business_address"), ascii_text("country")
    return f"""
{name}0 AS (SELECT entity_id, source, {a} AS n, {b} AS a, {c} AS c FROM {rec}),
{name} AS MATERIALIZED (SELECT entity_id, source, 'NAME' AS key_type, n AS key FROM {name}0 WHERE n <> ''
  UNION ALL SELECT entity_id, source, 'ADDRESS', a FROM {name}0 WHERE a <> ''
  UNION ALL SELECT entity_id, source, 'NAME_COUNTRY', n || {SEP} || c FROM {name}0 WHERE n <> '' AND c <> ''
  UNION ALL SELECT entity_id, source, 'ADDRESS_COUNTRY', a || {SEP} || c FROM {name}0 WHERE a <> '' AND c <> '')"""


def structural_keys(rec: str, name: str = "k") -> str:
    n, a = "business_name", "business_address"
    bare = f"regexp_replace({name_without_suffix(n)}, '[^a-z0-9]', '', 'g')"
    typed = {
        "NAME_STRUCT": structural_name(n),
        "NAME_NOSUFFIX": name_without_suffix(n),
        "NAME_COMPACT": bare,
        "NAME_SORTED": joined_sorted(f"string_split({name_without_suffix(n)}, ' ')"),
        "ADDRESS_STRUCT": structural_address(a),
        "ADDRESS_COMPACT": f"regexp_replace({structural_address(a)}, '[^a-z0-9]', '', 'g')",
        "ADDRESS_NUMBERS": number_key(a),
    }
    rows = "\n  UNION ALL ".join(f"SELECT entity_id, source, '{t}' AS key_type, {e} AS key FROM {rec}" for t, e in typed.items())
    return f"\n{name} AS MATERIALIZED (SELECT * FROM ({rows}) WHERE key <> '')"


def ordered_pairs(x: str, first: int) -> str:
    return f"flatten(list_transform(range(1, least(len({x}), {first}) + 1), lambda i: list_transform(range(i + 1, least(len({x}), {first}) + 1), lambda j: {x}[i] || {SEP} || {x}[j])))"


def approximate_keys(rec: str, name: str = "k") -> str:
    n, a = unicode_text("business_name"), unicode_text("business_address")
    typed = {
        "NAME_TOKEN": "nt",
        "NAME_TOKEN_PAIR": ordered_pairs("nt", 6),
        "NAME_3GRAM": "list_filter(list_distinct(g), lambda x: len(list_filter(g, lambda y: y = x)) = 1)",
        "NAME_FOLD_3GRAM": "CASE WHEN f <> n THEN list_distinct(fg) ELSE [] END",
        "ADDR_NUM_TOKEN": f"CASE WHEN a <> '' AND num <> '' THEN list_transform(atk, lambda t: num || {SEP} || t) ELSE [] END",
        "ADDR_TOKEN_PAIR": ordered_pairs("at6", 8),
        "ADDR_NUM_COUNTRY": f"CASE WHEN a <> '' AND num <> '' AND raw_country <> '' THEN [num || {SEP} || c] ELSE [] END",
    }
    rows = "\n  UNION ALL ".join(f"SELECT entity_id, source, '{t}' AS key_type, unnest({e}) AS key FROM {name}1" for t, e in typed.items())
    return f"""
{name}0 AS MATERIALIZED (SELECT entity_id, source, {n} AS n, strip_accents({n}) AS f, {a} AS a, {unicode_text("country")} AS c, country AS raw_country,
  coalesce(regexp_extract_all(business_address, '\\p{{Nd}}+')[1], '') AS num FROM {rec}),
{name}1 AS MATERIALIZED (SELECT *, {ngrams("replace(n, ' ', '')", 3)} AS g, {ngrams("replace(f, ' ', '')", 3)} AS fg,
  list_filter(string_split(n, ' '), lambda x: length(x) >= 5) AS nt, list_filter(string_split(a, ' '), lambda x: length(x) >= 5) AS atk,
  list_filter(string_split(a, ' '), lambda x: length(x) >= 6) AS at6 FROM {name}0),
{name} AS MATERIALIZED ({rows})"""


def char_keys(rec: str, n: int = 4, name: str = "k") -> str:
    return f"""
{name}0 AS MATERIALIZED (SELECT entity_id, source, {compact("business_name")} AS n, {compact("business_address")} AS a FROM {rec}),
{name} AS MATERIALIZED (SELECT entity_id, source, 'NAME_CHAR' AS key_type, unnest(list_distinct({ngrams("n", n)})) AS key FROM {name}0
  UNION ALL SELECT entity_id, source, 'ADDRESS_CHAR', unnest(list_distinct({ngrams("a", n)})) FROM {name}0)"""


def routes(rec: str, name: str = "k") -> str:
    cols = {"sn": spaced("business_name"), "cn": compact("business_name"), "sa": spaced("business_address"), "ca": compact("business_address"), "ma": masked("business_address")}
    anagram = lambda x: f"list_transform({ngrams(x, 3)}, lambda g: array_to_string(list_sort(string_split(g, '')), ''))"
    typed = {
        "NAME_CHAR2": ngrams("sn", 2),
        "NAME_CHAR3": ngrams("sn", 3),
        "NAME_CHAR4": ngrams("sn", 4),
        "NAME_COMPACT_CHAR3": ngrams("cn", 3),
        "NAME_COMPACT_CHAR4": ngrams("cn", 4),
        "NAME_SORTED_CHAR3": anagram("cn"),
        "ADDRESS_CHAR3": ngrams("sa", 3),
        "ADDRESS_CHAR4": ngrams("sa", 4),
        "ADDRESS_COMPACT_CHAR3": ngrams("ca", 3),
        "ADDRESS_COMPACT_CHAR4": ngrams("ca", 4),
        "ADDRESS_SORTED_CHAR3": anagram("ca"),
        "ADDRESS_DIGIT_CHAR3": ngrams("ma", 3),
    }
    rows = "\n  UNION ALL ".join(f"SELECT entity_id, source, '{t}' AS key_type, unnest(list_distinct({e})) AS key FROM {name}0" for t, e in typed.items())
    return f"\n{name}0 AS MATERIALIZED (SELECT entity_id, source, {', '.join(f'{e} AS {c}' for c, e in cols.items())} FROM {rec}),\n{name} AS MATERIALIZED ({rows})"


def name_tokens(x: str) -> str:
    return f"list_distinct(list_filter({words(unicode_text(x))}, lambda w: length(w) >= 3 AND w NOT IN ({listed(N.LEGAL_SUFFIXES)})))"


def address_tokens(x: str) -> str:
    return f"list_distinct(list_filter({words(unicode_text(x))}, lambda w: length(w) >= 4 AND NOT regexp_full_match(w, '\\p{{Nd}}+')))"


def numbers(x: str) -> str:
    return f"list_distinct(regexp_extract_all({x}, '\\p{{Nd}}+'))"


def component_keys(rec: str, name: str = "k") -> str:
    typed = {"name": name_tokens("business_name"), "address": address_tokens("business_address"), "number": numbers("business_address")}
    rows = "\n  UNION ALL ".join(f"SELECT entity_id, source, '{t}' AS key_type, unnest({e}) AS key FROM {rec}" for t, e in typed.items())
    return f"\n{name} AS MATERIALIZED ({rows})"


def frequency(k: str = "k", f: str = "f", by: str = "") -> str:
    return f"\n{f} AS MATERIALIZED (SELECT {by}key_type, key, count(*) AS cnt FROM {k} GROUP BY ALL)"


def match(left: str, right: str, out: str = "cand") -> str:
    return f"""
{out} AS MATERIALIZED (SELECT a.entity_id AS source1_entity_id, b.entity_id AS candidate_entity_id, b.source AS candidate_source, array_to_string(list_sort(list_distinct(list(key_type))), '|') AS blocking_rules
  FROM (SELECT DISTINCT entity_id, key_type, key FROM {left} WHERE source = 'S1') a JOIN (SELECT DISTINCT entity_id, source, key_type, key FROM {right} WHERE source <> 'S1') b USING (key_type, key) GROUP BY a.entity_id, b.entity_id, b.source)"""


def structural(rec: str, cap: int, out: str = "cand", k: str = "k") -> str:
    rare = f"""
{k}f AS MATERIALIZED (SELECT source, key_type, key FROM {k} GROUP BY ALL HAVING count(*) <= {cap}),
{k}r AS MATERIALIZED (SELECT * FROM {k} WHERE source = 'S1' UNION ALL SELECT k.* FROM {k} k SEMI JOIN {k}f USING (source, key_type, key) WHERE k.source <> 'S1')"""
    return structural_keys(rec, k) + "," + rare + "," + match(f"{k}r", f"{k}r", out)


def approximate(rec: str, cap: int, out: str = "cand", k: str = "ak") -> str:
    rare = f"""
{k}f AS MATERIALIZED (SELECT source, key_type, key FROM {k} GROUP BY ALL HAVING count(*) <= {cap}),
{k}r AS MATERIALIZED (SELECT * FROM {k} WHERE source = 'S1' UNION ALL SELECT k.* FROM {k} k SEMI JOIN {k}f USING (source, key_type, key) WHERE k.source <> 'S1')"""
    return approximate_keys(rec, k) + "," + rare + "," + match(f"{k}r", f"{k}r", out)


def char4(rec: str, name_cap: int, address_cap: int, out: str = "cand") -> str:
    rare = f"""
kf AS MATERIALIZED (SELECT key_type, key FROM k GROUP BY ALL HAVING count(*) <= CASE WHEN key_type = 'NAME_CHAR' THEN {name_cap} ELSE {address_cap} END),
kr AS MATERIALIZED (SELECT k.* FROM k SEMI JOIN kf USING (key_type, key))"""
    return char_keys(rec) + "," + rare + "," + match("kr", "kr", out)


MISSED = """
missed AS MATERIALIZED (SELECT t.* FROM truth t ANTI JOIN cand USING (source1_entity_id, candidate_entity_id))"""
