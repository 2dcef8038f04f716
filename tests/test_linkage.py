import pytest
from pyspark.sql import functions as F

from linkloom.functions import normalize as N
from linkloom.functions import similarity as M
from linkloom.functions import tokens as T
from linkloom.operators import blocking, evaluate, pairs, profile, sampling, simulate
from linkloom.operators import keys as K
from linkloom.sources import tables
from linkloom.streaming import blocking as streaming

RECORD = "entity_id string, business_name string, business_address string, country string, source string"


def value(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column("t").alias("v")).head()[0]


@pytest.mark.parametrize(
    "text, ascii_, unicode_, structural, bare",
    [
        ("Rapid-Bntscin Inc", "rapid bntscin inc", "rapid bntscin inc", "rapid bntscin inc", "rapid bntscin"),
        ("Future Agr0 Private [Limited]", "future agr0 private limited", "future agr0 private limited", "future agr0 pvt", "future agr0"),
        ("Acme Company Private Limited", "acme company private limited", "acme company private limited", "acme co pvt", "acme"),
        ("Limited Company", "limited company", "limited company", "ltd co", ""),
        ("Kinney, Kízzie, Ph.D.", "kinney k zzie ph d", "kinney kízzie ph d", "kinney k zzie ph d", "kinney k zzie ph d"),
        ("ग्रीन एग्रो", "", "ग र न एग र", "", ""),
        ("ＡＣＭＥ ﬁne", "ne", "acme fine", "ne", "ne"),
        ("𝐀cme", "cme", "Acme", "cme", "cme"),
        ("OY_Soft", "oy soft", "oy_soft", "oy soft", "oy soft"),
        ("", "", "", "", ""),
        (None, "", "", "", ""),
    ],
)
def test_normalisers(spark, text, ascii_, unicode_, structural, bare):
    got = [value(spark, f, text) for f in (N.ascii_text, N.unicode_text, N.structural_name, N.name_without_suffix)]
    assert got == [ascii_, unicode_, structural, bare]


def test_numbers(spark):
    assert [value(spark, N.address_number_key, x) for x in ("Plot 9, 10 Rd", "5 Main", "7 Rd 7", "06015 Ogden 2")] == ["10|9", "", "7", "06015|2"]
    assert value(spark, T.first_run, "Plot 9, 10 Rd") == "9" and value(spark, T.least_number, "Plot 9, 10 Rd") == "10"
    assert value(spark, T.first_run, "no") is None and value(spark, T.least_number, None) == ""


def test_grams(spark):
    assert value(spark, T.name_grams, "Banana Co") == ["ban", "ana", "nan", "ana", "nac", "aco"]
    assert value(spark, lambda c: K.singles(T.name_grams(c)), "Banana Co") == ["ban", "nan", "nac", "aco"]
    assert value(spark, N.spaced, "A & B, Co") == "a   b  co"
    assert value(spark, T.sorted_grams, "abcab") == ["abc"]
    assert value(spark, T.masked_grams, "12 A-5") == ["# a", " a#"]
    assert value(spark, T.gram_set, "ab") == ["ab"] and value(spark, T.gram_set, "") == [] and value(spark, T.compact_grams, "abc") == []
    assert value(spark, N.folded, "café ñandú") == "cafe nandu"


def test_unknown_route():
    with pytest.raises(ValueError):
        T.route("NONE")


def records(spark, rows):
    return spark.createDataFrame(rows, RECORD)


def test_approximate_keys(spark):
    r = records(spark, [("S1-1", "Anand Projects Anand Ltd", "139 Melrose Avenue, Needham, MA", "US", "S1"), ("S1-2", "Café", None, None, "S1")])
    got = {}
    for k in K.approximate_keys(r).collect():
        got.setdefault((k.entity_id, k.key_type), []).append(k.key.replace(K.SEP, ","))
    assert sorted(got["S1-1", "NAME_TOKEN"]) == ["anand", "anand", "projects"]
    assert got["S1-1", "NAME_TOKEN_PAIR"] == ["anand,projects", "anand,anand", "projects,anand"]
    assert got["S1-1", "ADDR_NUM_TOKEN"] == ["139,melrose", "139,avenue", "139,needham"]
    assert got["S1-1", "ADDR_TOKEN_PAIR"] == ["melrose,avenue", "melrose,needham", "avenue,needham"]
    assert got["S1-1", "ADDR_NUM_COUNTRY"] == ["139,us"] and ("S1-1", "NAME_FOLD_3GRAM") not in got
    assert sorted(got["S1-2", "NAME_FOLD_3GRAM"]) == ["afe", "caf"]


def test_blockers(spark):
    r = records(
        spark,
        [
            ("S1-1", "Acme Company Private Limited", "12 Main Street 5", "US", "S1"),
            ("S2-1", "ACME company private limited", "elsewhere", "US", "S2"),
            ("S2-2", "Acme", "12 main st 5", "IN", "S2"),
            ("S3-1", "", "", "", "S3"),
            ("S1-2", "", None, "", "S1"),
        ],
    )
    exact = {(p.source1_entity_id, p.candidate_entity_id): p.blocking_rules for p in blocking.exact(r).collect()}
    assert exact == {("S1-1", "S2-1"): "NAME|NAME_COUNTRY"}
    structural = {(p.source1_entity_id, p.candidate_entity_id): p.blocking_rules for p in blocking.structural(r).collect()}
    assert structural == {("S1-1", "S2-1"): "NAME_COMPACT|NAME_NOSUFFIX|NAME_SORTED|NAME_STRUCT", ("S1-1", "S2-2"): "ADDRESS_COMPACT|ADDRESS_NUMBERS|ADDRESS_STRUCT|NAME_COMPACT|NAME_NOSUFFIX|NAME_SORTED"}
    assert not [p for p in blocking.structural(r, 0).collect()]
    char = blocking.char4(r, 3, 3)
    assert {(p.source1_entity_id, p.candidate_entity_id) for p in char.collect()} >= {("S1-1", "S2-1"), ("S1-1", "S2-2")}
    assert not blocking.char4(r, 1, 1).collect()  # S1 counts, too


def test_caps_count_what_they_say(spark):
    r = records(spark, [("S1-1", "alpha alpha", "", "", "S1"), ("S2-1", "alpha alpha", "", "", "S2"), ("S2-2", "alpha", "", "", "S2")])
    keys = K.approximate_keys(r.where("source = 'S2'")).where("key_type = 'NAME_TOKEN'")
    assert blocking.frequency(keys).head().cnt == 3 and blocking.frequency(keys, mode="documents").head().cnt == 2


#: Names, addresses, and for each the ratio, token Jaccard and 3-gram Jaccard to four places.
GOLDEN = (
    ("Rapid Bitcoin Inc", "Rapid-Bntscin Inc", "139 Melrose Avenue, Needham, MA", "", (0.8824, 0.5, 0.4286), (0, 0, 0), 0),
    ("Kinney, Kizzie, Ph.D.", "Kinney, Kízzie, Ph.D.", "6015 Ogden Nash Way, Sacramento, CA", "06015 Ogden Nash Way, Sacramento, California", (0.9444, 0.5, 0.6842), (0.88, 0.5, 0.775), 0),
    ("Beacon Cafe LLC", "BEACON CE LLC", "", "", (0.9286, 0.5, 0.6), (0, 0, 0), 0),
    ("Green Agro Private Limited", "ग्रीन एग्रो प्राइवेट लिमिटेड", "", "", (0, 0, 0), (0, 0, 0), 0),
)


@pytest.mark.parametrize("a, b, x, y, names, addresses, numbers", GOLDEN)
def test_golden_pairs(spark, a, b, x, y, names, addresses, numbers):
    df = spark.createDataFrame([(a, b, x, y)], "a string, b string, x string, y string")
    got = df.select(M.char_ratio("a", "b"), M.token_jaccard("a", "b"), M.gram_jaccard("a", "b"), M.char_ratio("x", "y"), M.token_jaccard("x", "y"), M.gram_jaccard("x", "y"), M.common_numbers("x", "y")).head()
    assert list(got) == pytest.approx([*names, *addresses, numbers], abs=1e-4)


def test_ratio_is_directed_and_follows_autojunk(spark):
    from difflib import SequenceMatcher

    a, b = "tide diet " * 3, "ab " * 90 + "tide"
    df = spark.createDataFrame([(a, b)], "a string, b string").select(M.char_ratio("a", "b"), M.char_ratio("b", "a")).head()
    x, y = a.strip(), b
    assert df[0] == SequenceMatcher(None, x, y).ratio() and df[1] == SequenceMatcher(None, y, x).ratio()


def test_invariants(spark):
    from linkloom.plans import queries as q

    d = "/root/testdata/sf0.001"
    e = evaluate.evaluation(q.truth(spark, d), q.structural(spark, d)).head()
    assert e.retrieved_pairs + e.missed_pairs == e.true_pairs and 0 <= e.pair_recall <= 1 and 0 <= e.s1_coverage <= 1
    for c in (q.token_recovery_curve(spark, d), q.rarity_recovery_curve(spark, d)):
        rows = sorted(c.collect(), key=lambda r: r.cap)
        assert all(r.any_recovered == r.name_recovered + r.address_recovered - r.both_recovered for r in rows)
        assert all(a.any_recovered <= b.any_recovered for a, b in zip(rows, rows[1:]))
    assert all(r.one_recovered >= r.two_recovered >= r.three_recovered for r in q.multi_signature_curve(spark, d).collect())
    swept = q.composite_route_sweep(spark, d).collect()
    assert all(r.recovery_pct == r.sample_coverage for r in swept)
    both = {r.cap: r.both_recovered for r in q.token_recovery_curve(spark, d).collect()}
    assert all(r.recovered == both[r.cap] for r in swept if r.route == "NAME_ADDRESS")


def test_partitioning_changes_nothing(spark):
    r = tables.document_records(spark, "/root/testdata/sf0.001")
    a = {tuple(x) for x in blocking.approximate(r, 10).collect()}
    assert a == {tuple(x) for x in blocking.approximate(r.repartition(7).orderBy(F.rand(1)), 10).collect()} and a


def test_pair_algebra(spark):
    p = lambda *x: spark.createDataFrame(list(x), "source1_entity_id string, candidate_entity_id string")
    a, b = p(("S1-1", "S2-1"), ("S1-1", "S3-1")), p(("S1-1", "S3-1"), ("S1-2", "S2-9"))
    assert pairs.union(a, b).count() == 3
    assert tuple(pairs.overlap(a, b).head()) == (2, 2, 1, 1, 1)
    assert [tuple(r) for r in pairs.missed(a, b).collect()] == [("S1-1", "S2-1")]
    assert evaluate.evaluation(p(), p()).head().pair_recall == 0


def test_ground_truth(spark):
    gt = spark.createDataFrame([("S1-1", "S2-1, S3-2,,S3-3"), ("S1-2", ""), ("S1-3", None)], "source1_entity_id string, matched_entity_ids string")
    assert pairs.truth_pairs(gt).count() == 3
    assert [tuple(r) for r in profile.match_distribution(gt).collect()] == [(0, 2), (3, 1)]
    assert [r.pattern for r in profile.source_patterns(gt).collect()] == ["S2=1, S3=2", "NONE"]


def test_split_and_samples(spark):
    df = spark.range(1003).select(F.col("id").cast("string").alias("k"), (F.col("id") % 3).alias("g"))
    parts = {r.part: r["count"] for r in sampling.split(df, "k").groupBy("part").count().collect()}
    assert parts == {"train": 802, "validation": 201}
    assert {r.k for r in sampling.split(df.repartition(5), "k").where("part = 'train'").collect()} == {r.k for r in sampling.split(df, "k").where("part = 'train'").collect()}
    assert sampling.sample(df, 10, "k").count() == 10
    assert {r["count"] for r in sampling.stratified(df, "g", 4, "k").groupBy("g").count().collect()} == {4}


def test_multiplicity_counts_records_without_candidates(spark):
    c = spark.createDataFrame([("S1-1", "S2-1"), ("S1-1", "S2-2")], "source1_entity_id string, candidate_entity_id string")
    refs = spark.createDataFrame([("S1-1",), ("S1-2",)], "entity_id string")
    assert evaluate.distribution(evaluate.multiplicity(c)).head().mean_candidates == 2
    assert evaluate.distribution(evaluate.multiplicity(c, refs)).head().mean_candidates == 1


def test_best_cap_takes_the_smallest_of_equals(spark):
    s = spark.createDataFrame([("A", 1, 5, 50.0), ("A", 2, 7, 70.0), ("A", 3, 7, 70.0)], "route string, cap long, recovered long, recovery_pct double")
    assert simulate.best_cap(s).head().best_cap == 2


def test_tsv(spark, tmp_path):
    df = spark.createDataFrame([("S1-1", 'A "quoted"\tname', "NA", ""), ("S1-2", "two\nlines", None, "US")], tables.RECORD)
    at = str(tmp_path / "r")
    tables.write_tsv(df, at, ["entity_id"])
    assert tables.exists(spark, at) and not tables.exists(spark, at + "x")
    kept = {r.entity_id: r for r in tables.read_tsv(spark, at, tables.RECORD, lines_in_values=True).collect()}
    assert kept["S1-1"].business_name == 'A "quoted"\tname' and kept["S1-1"].business_address == "NA" and kept["S1-1"].country == "" and kept["S1-2"].business_name == "two\nlines"
    null = {r.entity_id: r for r in tables.read_tsv(spark, at, tables.RECORD, "null", True).collect()}
    assert null["S1-1"].business_address is None and null["S1-1"].country is None
    assert tables.lookup(df, spark.createDataFrame([("S1-2",), ("S1-2",)], "x string"), "x").count() == 1


def test_stream(spark, tmp_path):
    rows = records(spark, [("S2-1", "Acme", "x", "US", "S2"), ("S2-2", "Other", "y", "US", "S2")])
    rows.write.parquet(str(tmp_path / "in"))
    ref = records(spark, [("S1-1", "ACME", "z", "US", "S1")])
    q = streaming.match_stream(spark.readStream.schema(RECORD).parquet(str(tmp_path / "in")), ref, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert [(r.source1_entity_id, r.candidate_entity_id, r.blocking_rules) for r in got.collect()] == [("S1-1", "S2-1", "NAME|NAME_COUNTRY")]


def test_arrivals_by_window(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:10"), ("a", "2024-01-01 00:00:50"), ("b", "2024-01-01 00:05:00")]
    spark.createDataFrame(rows, "k string, at string").selectExpr("k", "cast(at as timestamp) as at").write.parquet(str(tmp_path / "in"))
    stream = streaming.arrivals(spark.readStream.schema("k string, at timestamp").parquet(str(tmp_path / "in")), "at", "1 minute", "10 minutes", "k")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("arrived").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.k, r.n) for r in spark.table("arrived").collect()) == [("a", 2), ("b", 1)]


def test_sorted_files_and_columns(spark, tmp_path):
    df = spark.createDataFrame([(f"S1-{i % 7}", f"S2-{i}", "S2", "X") for i in range(200)], tables.CANDIDATE).repartition(5)
    at = tmp_path / "c"
    tables.write_tsv(blocking.ordered(df), str(at), ["source1_entity_id", "candidate_source", "candidate_entity_id"])
    lines = [line for f in sorted(at.glob("part-*")) for line in f.read_text().splitlines()[1:]]
    assert len(lines) == 200 and lines == sorted(lines)
    assert tables.existing(df, ["candidate_entity_id", "no_such", "source1_entity_id"]).columns == ["candidate_entity_id", "source1_entity_id"]
    assert [r.candidate_entity_id for r in tables.head(df, 2, "candidate_entity_id").collect()] == ["S2-0", "S2-1"]
    assert {r.source for r in tables.with_source({"S1": df, "S2": df.limit(1)}).collect()} == {"S1", "S2"}


def test_exact_blocking_says_when_a_join_is_too_large(spark):
    r = records(spark, [(f"S{1 + i % 2}-{i}", "Acme", f"a {i}", "US", f"S{1 + i % 2}") for i in range(20)])
    assert blocking.exact(r, 100).count() == 100
    with pytest.raises(ValueError, match="NAME 100"):
        blocking.exact(r, 99)


def test_character_similarity_reports_equal_plain_ones(spark):
    """Every pair of the whole sample, by difflib and loops."""
    from difflib import SequenceMatcher

    from linkloom.plans import queries as Q

    d = "/root/testdata/sf0.01"
    own = {r.entity_id: r for r in Q.docs(spark, d).collect()}
    text = lambda s: " ".join("".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in (s or "").lower()).split())
    ratio = lambda a, b: SequenceMatcher(None, text(a), text(b)).ratio() if text(a) and text(b) else 0.0
    want = {}
    for p in Q.truth(spark, d).collect():
        a, b = own[p.source1_entity_id], own[p.candidate_entity_id]
        want[p.source1_entity_id, p.candidate_entity_id] = (ratio(a.business_name, b.business_name), ratio(a.business_address, b.business_address))
    got = {(r[0], r[1]): (r[2], r[3]) for r in Q.pair_sequence_ratio(spark, d).collect()}
    assert got == want and want
    for r in Q.char_threshold_table(spark, d).collect():
        values = [v[r.metric.startswith("address")] for v in want.values()]
        assert (r.pairs, r.total) == (sum(v >= r.threshold for v in values), len(values))
    rates = {r.condition: r.pairs for r in Q.char_condition_rates(spark, d).collect()}
    n, a = (lambda x: [v[x] for v in want.values()])(0), [v[1] for v in want.values()]
    both = list(zip(n, a))
    assert rates["name_ge_80_or_address_ge_50"] == sum(x >= 0.8 or y >= 0.5 for x, y in both)
    assert rates["name_ge_80_and_address_ge_50"] == sum(x >= 0.8 and y >= 0.5 for x, y in both)
    assert rates["name_ge_70_or_address_ge_40"] == sum(x >= 0.7 or y >= 0.4 for x, y in both)
    assert rates["name_ge_85_or_address_ge_85"] == sum(x >= 0.85 or y >= 0.85 for x, y in both)
    assert rates["strong_name_weak_address"] == sum(x >= 0.85 and y < 0.5 for x, y in both)
    assert rates["weak_name_strong_address"] == sum(x < 0.7 and y >= 0.85 for x, y in both)
    assert rates["strong_name_strong_address"] == sum(x >= 0.85 and y >= 0.85 for x, y in both)
    assert rates["weak_name_weak_address"] == sum(x < 0.7 and y < 0.7 for x, y in both)
    by = {(r.candidate_source, r.condition): (r.pairs, r.total) for r in Q.char_source_rates(spark, d).collect()}
    for s in ("S2", "S3"):
        mine = [v for k, v in want.items() if k[1].startswith(s)]
        assert by[s, "name_char_ge_90"] == (sum(x >= 0.9 for x, _ in mine), len(mine))
        assert by[s, "address_char_ge_80"] == (sum(y >= 0.8 for _, y in mine), len(mine))
    high = {(r[0], r[1]) for r in Q.high_similarity_pairs(spark, d).collect()}
    assert high == {k for k, (x, y) in want.items() if x >= 0.85 or y >= 0.85}
    strata = {}
    for r in Q.char_examples(spark, d).collect():
        strata.setdefault(r.diagnostic_group, []).append((r.name_char_similarity, r.address_char_similarity))
    assert len(strata["weak_name_weak_address"]) == min(20, rates["weak_name_weak_address"]) and all(x < 0.7 and y < 0.7 for x, y in strata["weak_name_weak_address"])


def test_command_line(spark, tmp_path, capsys):
    from linkloom.__main__ import main

    tables.write_tsv(spark.createDataFrame([("S1-1", "S2-1"), ("S1-1", "S3-1")], tables.PAIR), str(tmp_path / "c"))
    tables.write_tsv(spark.createDataFrame([("S1-1", "S2-1,S2-2")], tables.GROUND_TRUTH), str(tmp_path / "t"))
    assert main([]) == 1 and main([str(tmp_path / "c"), str(tmp_path / "no")]) == 1
    assert main([str(tmp_path / "c"), str(tmp_path / "t")]) == 0
    assert "pair_recall=0.5" in capsys.readouterr().out


def test_similar_pairs_across_blocks_and_copies(spark, monkeypatch):
    """Copies, near copies and short texts on both sides, in blocks of a few texts, against all pairs by loops."""
    import random

    from linkloom.operators import shingles

    monkeypatch.setattr(shingles, "BLOCK_BYTES", 600)
    rng = random.Random(3)
    base = [[rng.choice("abcdefgh") + str(rng.randrange(30)) for _ in range(rng.choice((3, 12, 40)))] for _ in range(12)]
    rows = []
    for i in range(150):
        w = list(base[i % 12])
        for _ in range(rng.choice((0, 0, 1, 3))):
            w[rng.randrange(len(w))] = "x" + str(rng.randrange(99))
        rows.append((f"S{1 + i // 12 % 3}-{i}", f"S{1 + i // 12 % 3}", " ".join(["head", str(i), *w][: rng.choice((4, 99))])))
    rows.append((None, None, "head 0 a b c"))
    sets = {k: {tuple(w[i : i + 3]) for i in range(len(w) - 2)} for k, _, t in rows if k for w in [t.split()[2:]]}
    for least in (0.5, 0.8):
        want = {(a, b) for a, x in sets.items() for b, y in sets.items() if a[:2] == "S1" != b[:2] and x and len(x & y) >= least * len(x | y)}
        got = [tuple(r) for r in pairs.shingle_truth(spark.createDataFrame(rows, "entity_id string, source string, text string").repartition(3), 2, 3, least).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 20


def _copied_records(spark):
    names = ["Acme Widgets Ltd", "acme widgets", "Zenith, Tools", "", "Acme Widgets Ltd"]
    rows = [(f"S{1 + i % 3}-{i}", names[i % 5], f"{i % 2} Long Street 77", "en", f"S{1 + i % 3}") for i in range(60)]
    return spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string, source string")


def _all_pairs(records):
    a = records.where("source = 'S1'").select(F.col("entity_id").alias("source1_entity_id"))
    return a.crossJoin(records.where("source <> 'S1'").select(F.col("entity_id").alias("candidate_entity_id")))


def test_counted_diagnostics_are_those_of_all_pairs(spark):
    """Reports that count pairs get a row for each two different texts and source, not one for each pair of copies."""
    records = _copied_records(spark)
    every = _all_pairs(records)
    names = ("name_jaccard", "name_char_similarity", "address_char3_jaccard", "address_char_similarity")
    one_by_one = pairs.diagnostics(every, records)
    counted = pairs.counted_diagnostics(every, records, names).cache()
    key = ["candidate_source", *names]
    want = {tuple(r) for r in one_by_one.groupBy(*key).agg(F.count("*")).collect()}
    assert {tuple(r) for r in counted.groupBy(*key).agg(F.sum("pairs")).collect()} == want
    assert counted.count() <= 2 * 8 * 8 < every.count()
    conditions = {"a": "name_char_similarity >= 0.8", "b": "address_char3_jaccard < 0.9"}
    for by in (None, "candidate_source"):
        assert set(evaluate.condition_rates(counted, by, conditions, "pairs").collect()) == set(evaluate.condition_rates(one_by_one, by, conditions).collect())
    assert set(evaluate.threshold_table(counted, names, (0.5, 0.9), "pairs").collect()) == set(evaluate.threshold_table(one_by_one, names, (0.5, 0.9)).collect())
    none = pairs.counted_diagnostics(every.limit(0), records, names)
    assert {tuple(r) for r in evaluate.condition_rates(none, None, conditions, "pairs").collect()} == {("a", 0, 0, 0.0), ("b", 0, 0, 0.0)}


def test_char_reports_write_no_row_for_each_pair(spark, monkeypatch):
    from linkloom.plans import queries

    monkeypatch.setattr(queries, "ratio_measures", None)
    for q in ("char_source_rates", "char_condition_rates", "char_threshold_table"):
        assert queries.QUERIES[q](spark, "/root/testdata/sf0.001").count() > 0


def test_counted_rarity_is_that_of_all_pairs(spark):
    records = _copied_records(spark)
    every = _all_pairs(records)
    kinds = {"NAME_CHAR": "name", "ADDRESS_CHAR": "address"}
    one_by_one = simulate.rarity_by_text(every, records, K.char_keys, kinds)
    counted = simulate.counted_rarity(every, records, K.char_keys, kinds).cache()
    values = [c for c in counted.columns if c != "pairs"]
    assert {tuple(r) for r in counted.groupBy(*values).agg(F.sum("pairs")).collect()} == {tuple(r) for r in one_by_one.groupBy(*values).agg(F.count("*")).collect()}
    assert counted.count() <= 8 * 8 < every.count()
    columns = simulate.combined("name_min_freq", "address_min_freq")
    assert simulate.curve(counted, columns, (3, 20, 60), "pairs").collect() == simulate.curve(one_by_one, columns, (3, 20, 60)).collect()
