import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.llm import exact_dedup, huffman, mixing, ngram_join, packing, personal, quality, repeats, suffix_tree, token_counts, token_files, toxicity, vocab
from linkloom.llm.common import Scratch
from linkloom.llm.components import Forest, components
from tests.llm import brute

SF = "/root/testdata/sf0.001"
CLASHING = ("_id", "_hash", "_digest", "_n", "_source", "_lang", "_topic", "_some", "id", "hash", "digest", "n", "words", "chance", "own", "topic", "grp", "part")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, block long, keep_id long, score double, " + ", ".join(f"{c} string" for c in CLASHING)

LONG = " ".join(f"word{i} and more of it" for i in range(4000))
PASSAGE = "a passage of more than one hundred bytes that stands in several documents, with an end of its own here"
ODD = [
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (4, "one"),
    (5, "one two"),
    (6, "Same Text here, with six words"),
    (7, "same text HERE, with six words"),
    (8, "same text here, with six words"),
    (9, LONG),
    (10, LONG + " end"),
    (11, "x" * 5000),
    (12, "é" * 300 + "日本語 の テキスト ΑΣ İstanbul 😀😀"),
    (13, "text with <|endoftext|> inside and <|startoftext|> too"),
    (14, f"Before {PASSAGE} after."),
    (15, f"Other words {PASSAGE} and others."),
    (16, "nul \0 byte " + "\0" * 150 + " and again " + "\0" * 150),
    (17, "ha " * 200),
    (18, "mail a.b@c.example.org or +1 (974) 555-3436, card 4111 1111 1111 1111 at 10.0.0.255 not 300.1.1.1"),
    (19, "don't DON'T we'll '' 's$'s ... 12345 ١٢٣"),
]


def frame(spark, rows):
    """With nulls in all other columns, and columns of clashing names."""
    return spark.createDataFrame([(i, t, None, None, None, 1, 2, 3, 0.5, *CLASHING) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD).repartition(3).cache()


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(documents):
    return [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]


OPERATORS = {
    "tokens": lambda d: token_counts.token_counts(d),
    "quality": lambda d: quality.quality(d),
    "keep_good": lambda d: quality.keep_good(d),
    "personal": lambda d: personal.personal(d),
    "toxicity": lambda d: toxicity.toxicity(d, d.sparkSession.createDataFrame([], "doc_id long, quality int, toxic int")),
    "mixture": lambda d: mixing.mixture(d, rounds=3),
    "sample": lambda d: mixing.sample(d),
    "repeats": lambda d: repeats.drop_repeats(d),
    "near": lambda d: ngram_join.near_duplicates(d),
    "keep_one": lambda d: ngram_join.keep_one(d),
    "pack": lambda d: packing.digest(packing.pack(d)),
    "exact": lambda d: exact_dedup.exact_groups(d),
    "drop_copies": lambda d: exact_dedup.drop_copies(d),
    "files": lambda d: token_files.round_trip(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](frame(spark, [])).count() == 0


@pytest.mark.parametrize("name", ["tokens", "quality", "personal", "toxicity", "mixture", "repeats", "near", "exact", "files"])
def test_one_row_for_each_row(spark, name):
    twice = frame(spark, [(None, None), (None, "some text"), (5, "a b c d"), (5, "a b c d"), (5, None)])
    out = OPERATORS[name](twice).collect()
    assert len(out) == 5 and sorted(repr(r.doc_id) for r in out) == sorted(["None", "None", "5", "5", "5"])


def test_token_counts(odd, documents, rows):
    for df, own in ((odd, ODD), (documents, rows)):
        got = token_counts.token_counts(df, common=50).collect()
        assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == brute.token_counts(own)
        assert all(r.over_limit == (r.n_tokens > 1024) for r in got)


def test_ids_match_the_library():
    words = vocab.WordIds(limit=100)
    plain = [chr(c) for c in range(1, 0x3000)]
    texts = [f"a{c}b1{c}{c}'s {c} 'S{c}'re {c}" for c in plain] + [t or "" for _, t in ODD]
    for i in range(0, len(texts), 2000):
        part = texts[i : i + 2000]
        ids, n = words.flat(part, 7)
        for t, got, want in zip(part, np.split(ids, np.cumsum(n)[:-1]), words.tok.encode_batch(part, add_special_tokens=False)):
            assert got.tolist() == [*want.ids, 7], t


def test_ids_of_slices_of_a_long_text(monkeypatch):
    monkeypatch.setattr(vocab, "SLICE", 100)
    words = vocab.WordIds()
    texts = [LONG[:5000], "", "x" * 500, "ab " * 3 + "y" * 300 + "\nend. " * 40, "Ωμ " * 90, "z"]
    ids, n = words.flat(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [e.ids for e in words.tok.encode_batch(texts, add_special_tokens=False)]
    assert words.flat([])[0].tolist() == []


def test_token_files_do_not_depend_on_partitions(spark):
    rows = [(5, f"text number {i % 7}") for i in range(40)] + [(None, f"another {i}") for i in range(20)] + [(2, "one"), (9, "two words")]
    want = None
    for parts in (1, 3, 7):
        got = sorted(map(repr, token_files.round_trip(frame(spark, rows).repartition(parts)).collect()))
        assert want in (None, got)
        want = got


def test_pre_tokens_match_the_library():
    pieces = vocab.Pieces()
    for t in [f"a{c}b1{c}{c}'s {c}" for c in map(chr, range(1, 0x600))] + [t or "" for _, t in ODD[:8] + ODD[10:]]:
        pre, special = pieces.split(t)
        assert sum(pieces.count(pre)) + special == len(pieces.tok.encode(t, add_special_tokens=False).ids), t


def test_quality(odd, documents, rows):
    for df, own in ((odd, ODD), (documents, rows)):
        texts = dict(own)
        for r in quality.quality(df).collect():
            want = brute.base_stats(texts[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
            assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
            assert not (r.kept and r.base_failed)


def test_quality_measures():
    assert quality.block_entropy(np.arange(256)) == 1.0
    assert quality.block_entropy(np.zeros(256, int)) == 0.0
    assert quality.script_of("Привет abc") == "cyrillic" and quality.script_of("123") == "none" and quality.script_of("日本語 テキスト") in ("han", "kana")


def test_quality_rejects_what_a_vocabulary_does_not_fit(spark, documents):
    odd_one = "".join(chr(0x0E80 + i % 60) + (" " if i % 3 == 0 else "") for i in range(600))
    extra = spark.createDataFrame([(10**6, odd_one, "en", "s", 0)], documents.schema)
    kept = {r.doc_id: r.kept for r in quality.quality(documents.unionByName(extra)).collect()}
    assert kept[10**6] is False and sum(kept.values()) > 100


def few_words(seed):
    """Passes the base rules, but all of it is twenty words."""
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice("table river seven under green money house light paper stone water glass north plant eight sound field black round chair".split(), 240))


def test_copies_do_not_move_quality_bands(spark, documents):
    junk, schema = few_words(0), documents.schema
    without = {r.doc_id: r.kept for r in quality.quality(documents).collect()}
    for text in (junk, documents.where("lang = 'en' and n_chars > 2000").orderBy("doc_id").head().text):
        copies = spark.createDataFrame([(10**6 + i, text, "en", "s", 0) for i in range(500)], schema)
        got = {r.doc_id: r.kept for r in quality.quality(documents.unionByName(copies)).collect()}
        assert {i: k for i, k in got.items() if i < 10**6} == without
        assert len({k for i, k in got.items() if i >= 10**6}) == 1 and got[10**6] == (text != junk)


def test_quality_has_limits_without_a_band(spark, documents):
    good = [r.text for r in documents.where("lang = 'en' and n_chars > 2000").orderBy("doc_id").limit(3).collect()]
    own = [(i, few_words(i), "xx") for i in range(100)] + [(1000 + i, t, "xx") for i, t in enumerate(good)]  # mostly junk
    own += [(2000, few_words(200), "yy"), *[(3000 + i, t, "yy") for i, t in enumerate(good)]]  # too few for a band
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality.quality(spark.createDataFrame(own, "doc_id long, text string, lang string")).collect()}
    assert all(got[i] == (False, False) for i in [*range(100), 2000])
    assert all(got[1000 + i] == got[3000 + i] == (False, True) for i in range(3))


def test_personal(odd, documents, rows):
    hard = [(i, t) for i, t in enumerate(["a@b.c_d@e.f.g", "1.2.3.4.5.6.7.8", "4111-1111-1111-1111 5", "++1 234 567 890", "1" * 3000, "1 " * 3000, "a." * 3000, "+1" + "-2" * 3000, "a@b..c", "00255.1.1.1"])]
    for df, own in ((odd, ODD), (documents, rows), (odd.sparkSession.createDataFrame(hard, "doc_id long, text string"), hard)):
        texts = dict(own)
        for r in personal.personal(df).collect():
            assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == brute.base_spans(texts[r.doc_id]), texts[r.doc_id]


def test_personal_learns_contexts(spark):
    said = [(i, f"Well, please call me at +1 234 567 8{i:03d} today") for i in range(20)] + [(100, "Well, please call me at 555-12345 today"), (101, "Version 555-12345 came out"), (102, "no number at all")]
    got = {r.doc_id: r.spans for r in personal.personal(spark.createDataFrame(said, "doc_id long, text string")).collect()}
    assert re.fullmatch(r"phone:24:33", got[100]) and got[0].startswith("phone:24:") and got[102] == ""
    assert got[101].startswith("phone:8:17")  # the same instance, known by then


def test_personal_learns_spaced_runs(spark):
    def card(i):
        body = f"4111 1111 1{i:03d} 111"
        return body + next(str(d) for d in range(10) if brute.base_spans(f"{body}{d}")[2])

    said = [(i, f"Well, please call me at +1 234 567 8{i:03d} today") for i in range(20)]
    said += [(100 + i, f"You can pay with card {card(i)} here") for i in range(20)]
    unseen = {200: "(017) 555 7713", 201: "1 (017) 555-7713", 202: "017 555.7714", 203: "555-77131"}
    said += [(i, f"Well, please call me at {x} today") for i, x in unseen.items()]
    said += [(300, "You can pay with card 4111 1111 1111 1112 here"), (301, "There were 017 555 7715 of them"), (302, "Well, please call me at 555-12345 2 today")]
    got = {r.doc_id: r.spans for r in personal.personal(spark.createDataFrame(said, "doc_id long, text string")).collect()}
    for i, x in unseen.items():
        assert got[i] == f"phone:24:{24 + len(x)}"
    assert got[300] == "card:22:41" and got[301] == "" and got[302].startswith("phone:24:")


def plain_may_be(kind, token):
    n = len(re.sub("[^0-9]", "", token))
    return {"email": "@" in token, "ip": re.fullmatch("[0-9a-fA-F]+(?:[.:][0-9a-fA-F]+){3,}", token) is not None, "card": 12 <= n <= 19, "phone": 6 <= n <= 15}[kind]


def plain_graph(tokens, rounds, least_seeds, smoothing):
    """Scores of unseen instances by loops over the pattern - instance graph."""
    instances, seeds, links = {}, {}, set()
    for t in tokens:
        if t.inside and t.kind is None:
            continue
        for pattern in t.patterns:
            name = t.token if t.kind is None else (t.kind, t.same)
            instances.setdefault(pattern, set()).add(name)
            if t.kind is not None:
                seeds.setdefault((pattern, t.kind), set()).add(name)
    useful = {k: len(v) for k, v in seeds.items() if len(v) >= least_seeds}
    for pattern, kind in useful:
        links |= {(pattern, kind, x) for x in instances[pattern] if isinstance(x, str) and plain_may_be(kind, x)}
    scores: dict = {}
    for _ in range(rounds):
        sure = {(p, k): (n + sum(scores.get((x, kk), 0.0) for pp, kk, x in links if (pp, kk) == (p, k))) / (len(instances[p]) + smoothing) for (p, k), n in useful.items()}
        doubt: dict = {}
        for p, k, x in links:
            doubt[x, k] = doubt.get((x, k), 1.0) * max(1 - sure[p, k], 1e-9)
        scores = {x: 1 - d for x, d in doubt.items()}
    return scores


def test_graph_scores_equal_the_plain_ones(spark, documents):
    said = [(i, f"Well, please call me at +1 234 567 8{i:03d} today") for i in range(8)] + [(20 + i, f"Please call me at {555000 + i // 2} now, or at 10.0.0.{i}!") for i in range(8)]
    said += [(40 + i, f"Write to box{i % 5}@mail.example.org soon; write to box{i} instead, or to me at +1 234 567 9{i:03d} today") for i in range(8)]
    rows = spark.createDataFrame(said, "row long, text string").unionByName(documents.select((F.col("doc_id") + 1000).alias("row"), F.coalesce("text", F.lit("")).alias("text")))
    scratch = personal.Scratch(spark, "graph")
    base = scratch.save(personal.base_spans(rows, "row"), "base")
    tokens = scratch.save(personal.context_tokens(rows, base, "row"), "tokens")
    got = {(r.instance, r.kind): r.score for r in personal.score_graph(tokens, scratch, 3, 3, 2.0).collect()}
    want = plain_graph(tokens.collect(), 3, 3, 2.0)
    assert got.keys() == want.keys() and len(want) >= 4
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_contexts_know_numbers_and_marks_alike(spark):
    said = [(i, f"Order {i}, (tel.) no. {i}: +1 234 567 8{i:03d}; thanks") for i in range(12)] + [(50, "Order 77: tel no. 4: 017 555 7713 thanks"), (51, "in 2019 017 555 7713 units")]
    got = {r.doc_id: r.spans for r in personal.personal(spark.createDataFrame(said, "doc_id long, text string")).collect()}
    assert got[50].startswith("phone:21:")


def test_toxicity(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    right = sum(r.predicted == r.toxic for r in got) / len(got)
    assert right > 0.93
    # held-out labels change nothing
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.toxicity(docs, flipped).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-12 for r in got)


def test_toxicity_learns_from_all_different_texts(spark):
    texts = [f"common words that all of them have {i % 50}" for i in range(100)] + ["Some   Text", "some text", None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    chosen = spark.createDataFrame([(i, i % 2) for i in range(len(texts))], "doc_id long, toxic int")
    got = toxicity.training_rows(toxicity.texts(rows), chosen).collect()
    different = {(" ".join((t or "").lower().split()), i % 2) for i, t in enumerate(texts)}
    assert len(got) == len(different) == 54


def plain_label_model(fire, active, weight, start, prior, rounds, tied):
    """The label model by loops over documents and voters."""
    docs, voters = fire.shape
    fires, dependence = [[min(max(x, 1e-4), 1 - 1e-4) for x in c] for c in start], [[0.0] * voters for _ in range(voters)]
    asked = prior

    def posterior(d):
        odds = np.log(prior / (1 - prior))
        for v in range(voters):
            if active[d][v]:
                share = 1 / (1 + sum(max(0.0, dependence[u][v]) for u in range(voters) if active[d][u]))
                p1, p0 = fires[1][v], fires[0][v]
                odds += share * (np.log(p1 / p0) if fire[d][v] else np.log((1 - p1) / (1 - p0)))
        return 1 / (1 + np.exp(-min(40, max(-40, odds))))

    for _ in range(rounds):
        p = [posterior(d) for d in range(docs)]
        own, new = [], [[0.0] * voters for _ in range(voters)]
        for c in (0, 1):
            w = [weight[d] * (p[d] if c else 1 - p[d]) for d in range(docs)]
            mean = [(sum(w[d] * fire[d][v] for d in range(docs) if active[d][v]) + tied * start[c][v]) / (sum(w[d] for d in range(docs) if active[d][v]) + tied) for v in range(voters)]
            own.append([min(max(x, 1e-4), 1 - 1e-4) for x in mean])
            for u in range(voters):
                for v in range(voters):
                    both = [d for d in range(docs) if active[d][u] and active[d][v]]
                    cov = sum(w[d] * (fire[d][u] - mean[u]) * (fire[d][v] - mean[v]) for d in both) / (sum(w[d] for d in both) + tied)
                    dev = np.sqrt(max(mean[u] * (1 - mean[u]), 1e-6)) * np.sqrt(max(mean[v] * (1 - mean[v]), 1e-6))
                    new[u][v] += (prior if c else 1 - prior) * cov / dev if u != v else 0.0
        prior = min(0.5, max(0.005, (sum(weight[d] * p[d] for d in range(docs)) + tied * asked) / (sum(weight) + tied)))
        fires, dependence = own, new
    return prior, fires, [posterior(d) for d in range(docs)]


def test_label_model_equals_the_plain_one():
    rng = np.random.default_rng(3)
    y = rng.random(60) < 0.3
    fire = (rng.random((60, 4)) < np.where(y[:, None], 0.7, 0.1)).astype(float)
    fire[:, 3] = fire[:, 2]
    active = (rng.random((60, 4)) < 0.8).astype(float)
    fire *= active
    weight, start = rng.integers(1, 5, 60), np.array([[0.1] * 4, [0.5] * 4])
    model = toxicity.fit_label_model(fire, active, weight, start, 0.2, rounds=5, tied=10.0)
    prior, fires, posterior = plain_label_model(fire, active, weight, start, 0.2, 5, 10.0)
    assert abs(model.prior - prior) < 1e-9 and np.abs(model.fires - fires).max() < 1e-9
    assert np.abs(model.posterior(fire, active) - posterior).max() < 1e-9


def test_label_model_tells_classes_apart():
    rng = np.random.default_rng(1)
    n = toxicity.VOTERS
    y = rng.random(5000) < 0.2
    fire = (rng.random((5000, n)) < np.where(y[:, None], 0.7, 0.05)).astype(np.int64)
    abstain = (rng.random((5000, n)) < 0.3).astype(np.int64)
    packed = ((fire | abstain << 32) << np.arange(n)).sum(axis=1)
    pattern, counts = np.unique(packed, return_counts=True)
    m = toxicity.fit_label_model(*toxicity.unpack(pattern), counts, np.array([np.full(n, 0.1), np.full(n, 0.5)]), 0.3)
    assert abs(m.prior - 0.2) < 0.03 and np.abs(m.fires[1] - 0.7).max() < 0.1
    assert ((m.posterior(*toxicity.unpack(packed)) > 0.5) == y).mean() > 0.98


def test_voters():
    ids = {"idiot|": 0, "scum": 1, "garbagelike": 2}
    families = toxicity.families_of(ids)

    def fires(text):
        words = text.lower().split()
        found, holders = toxicity.Lexicon(ids).hits(words, set(words))
        fire, active = toxicity.unpack(np.array([x | y << 32 for x, y in [toxicity.vote(text, words, set(words), found, holders, families)]]))
        names = np.array(toxicity.VOTER_NAMES)
        return set(names[(fire[0] > 0) & (active[0] > 0)]), set(names[active[0] == 0])

    got, away = fires("you are an idiot and all of them are scum")
    assert {"list:en", "short stems", "addressed", "different hits", "frequent hits"} <= got and "list:de" in away
    assert "masked" in fires("what a f**k of it")[0] and "exclaimed" in fires("no!! and no")[0]
    assert "shouting" in fires("THIS TEXT SHOUTS AT ALL who read it here now")[0]
    assert "clean" in fires("plain words " * 20)[0] and "clean" in fires("few words")[1]


def test_raking_rounds_shuffle_nothing(documents, monkeypatch):
    """A round that deals its few cells to every partition of a shuffle costs the driver memory for each task."""
    plans, save = {}, Scratch.save

    def kept(self, df, label, *rest):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return save(self, df, label, *rest)

    monkeypatch.setattr(Scratch, "save", kept)
    rates = mixing.mixture_rates(documents, rounds=3).collect()
    rounds = [p for label, p in plans.items() if label.startswith("raked-") and label != "raked-0"]
    assert rates and rounds and not any("Exchange" in p for p in [*rounds, plans["rates"]])


def test_mixing_meets_its_targets(spark, documents):
    out = mixing.mixture(documents, powers=(1.0, 1.0, 1.0), keep=0.5).toPandas()
    expected = (out.tokens * out.p).sum()
    assert abs(expected / out.tokens.sum() - 0.5) < 1e-6 and np.ptp(out.p[out.tokens > 0]) < 1e-6  # shares as they are: one rate
    flat = mixing.mixture(documents, powers=(1.0, 0.0, 1.0), keep=0.05).toPandas()
    by = (flat.tokens * flat.p).groupby(flat.lang).sum()
    assert by.max() / by.min() < 1.02
    import hashlib

    draws = {i: int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:13], 16) / 16**13 for i in flat.doc_id}
    assert all((draws[r.doc_id] < r.p) == r.kept for r in flat.itertuples())
    assert {r.doc_id for r in mixing.sample(documents, keep=0.3).collect()} == {r.doc_id for r in mixing.mixture(documents, keep=0.3).where("kept").collect()}


def test_raking_equals_the_plain_one(spark, documents):
    """All of the method by loops: cells, targets, raking, the rate, against the operator's p."""
    rounds, keep = 4, 0.3
    targets = {"lang": {"en": 3.0, "de": 1.0, "xx": 2.0}}
    out = mixing.mixture(documents, powers=(0.5, 0.7, 0.8), keep=keep, rounds=rounds, targets=targets).collect()
    cells: dict = {}
    for r in out:
        key = (r.source, r.lang, r.topic)
        cells[key] = cells.get(key, 0) + r.tokens
    cells = {k: n for k, n in cells.items() if n}
    total = sum(cells.values())
    want = []
    for d, power in enumerate((0.5, None, 0.8)):
        if power is None:
            want.append({k: w / 6 for k, w in targets["lang"].items()})
            continue
        own: dict = {}
        for k, n in cells.items():
            own[k[d]] = own.get(k[d], 0) + n
        lifted = {k: n**power for k, n in own.items()}
        want.append({k: x / sum(lifted.values()) for k, x in lifted.items()})
    w = {k: n / total for k, n in cells.items()}
    for _ in range(rounds):
        for d in range(3):
            margin: dict = {}
            for k, x in w.items():
                margin[k[d]] = margin.get(k[d], 0) + x
            w = {k: x * want[d].get(k[d], 0) / margin[k[d]] if margin[k[d]] > 0 else 0.0 for k, x in w.items()}
    low, high = 0.0, max(n / w[k] for k, n in cells.items() if w[k] > 0)
    for _ in range(200):
        f = (low + high) / 2
        got = sum(min(1.0, f * w[k] / n) * n for k, n in cells.items())
        low, high = (low, f) if got >= keep * total else (f, high)
    for r in out:
        k = (r.source, r.lang, r.topic)
        p = min(1.0, high * w[k] / cells[k]) if r.tokens and k in cells else 0.0
        assert abs(r.p - p) < 1e-6, k


@pytest.mark.parametrize("more", [{}, {"hot_blocks": 1, "block_bytes": 3000}, {"block_bytes": 20000}])
def test_repeats(odd, documents, rows, more):
    for df, own in ((odd, ODD), (documents, rows)):
        assert sorted(tuple(r) for r in repeats.drop_repeats(df, **more).collect()) == brute.repeats(own)


def test_kept_text(spark):
    own = [(1, f"Before {PASSAGE} after."), (2, f"Other words {PASSAGE} and others.")]
    got = {r.doc_id: bytes(r.kept).decode() for r in repeats.drop_repeats(frame(spark, own), keep_text=True).collect()}
    assert got[1] == own[0][1] and got[2] == "Other wordsnd others."  # " a" follows the passage in both


def test_maximal_repeats():
    text = b"xabcd1yabcd2zabcd1"
    n = len(text)
    right = np.zeros((n, n), np.uint8)
    left = np.zeros((n, n), np.uint8)
    for i in range(n):
        right[i, : n - i] = np.frombuffer(text[i:], np.uint8)
        left[i, :i] = np.frombuffer(text[:i][::-1], np.uint8)
    tree = suffix_tree.RepeatTree(right, n - np.arange(n), left, np.arange(n), 3)
    found = {}
    for before, behind, starts, members in tree.maximal_repeats(4):
        for b, r, m in zip(before, behind, np.split(members, starts[1:])):
            at = m - b
            found.setdefault(text[at[0] : at[0] + b + r], set()).update(at.tolist())
    assert found == {b"abcd": {1, 7, 13}, b"xabcd": set(), b"abcd1": {1, 13}} or found == {b"abcd": {1, 7, 13}, b"abcd1": {1, 13}}


@pytest.mark.parametrize("more", [{}, {"hot_blocks": 1, "block_bytes": 400}])
def test_groups_of_maximal_repeats(spark, more):
    """Each group has all occurrences of its string, which differ on either side or reach a context's end; every repeated window lies in one."""
    size, gram = 20, 10
    rng = np.random.default_rng(5)
    shared = ["".join(rng.choice(list("abcd"), 60)) for _ in range(3)]
    own = []
    for i in range(40):
        s = shared[i % 3]
        a = int(rng.integers(0, 15))
        own.append((i, "".join(rng.choice(list("abcdefgh"), 30)) + s[a : a + int(rng.integers(20, 45))] + "".join(rng.choice(list("efgh"), 20))))
    texts = dict(own)
    groups: dict = {}
    for r in repeats.maximal_repeats(frame(spark, own).repartition(3), size, gram, **more).collect():
        groups.setdefault((r.repeat, r.length), set()).add((r.doc_id, r.start))
    places: dict = {}
    for i, t in own:
        for k in range(len(t) - size + 1):
            places.setdefault(t[k : k + size], []).append((i, k))
    covered = set()
    for (_, n), found in groups.items():
        strings = {texts[i][k : k + n] for i, k in found}
        assert n >= size and len(found) > 1 and len(strings) == 1
        (string,) = strings
        assert found == {(i, k) for i, t in own for k in range(len(t) - n + 1) if t.startswith(string, k)}
        covered |= {(i, k + o) for i, k in found for o in range(n - size + 1)}
    assert {p for at in places.values() if len(at) > 1 for p in at} == covered
    assert sorted(tuple(r) for r in repeats.drop_repeats(frame(spark, own), size, gram, **more).collect()) == brute.repeats(own, size)


@pytest.mark.parametrize("more", [{}, {"frequent": 1, "block_bytes": 3000}, {"frequent": 2, "group": 2, "block_bytes": 20000}, {"frequent": 2, "refined": 20, "unit": 2000}, {"frequent": 2, "most": 20, "block_bytes": 20000}])
def test_near_duplicates(odd, documents, rows, more):
    for df, own in ((odd, ODD), (documents, rows)):
        got = sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in ngram_join.near_duplicates(df, **more).collect())
        assert got == brute.near(own)


def test_near_duplicates_of_five_words(documents, rows):
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in ngram_join.near_duplicates(documents, 5, 4, 5).collect())
    assert got == brute.near(rows, 5, 4, 5)


@pytest.mark.parametrize("num, den", [(9, 10), (4, 5), (1, 2)])
def test_long_sets_are_parted_without_loss(num, den):
    """Every pair that is similar enough has a key in common, whatever the sizes are."""
    rng = np.random.default_rng(num)
    near = 0
    for trial in range(400):
        n = int(rng.integers(1, 120))
        a = rng.choice(1 << 40, n, replace=False).astype(np.uint64)
        gone = int(rng.integers(0, 1 + n * (den - num) // den))
        more = rng.choice(1 << 41, int(rng.integers(0, 2 + n * (den - num) // num)), replace=False).astype(np.uint64) + np.uint64(1 << 50)
        b = np.concatenate([rng.permutation(a)[gone:], more])
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        if den * both < num * (len(a) + len(b) - both) or not both:
            continue
        near += 1
        share = rng.choice([0.0, 0.3, 1.0])
        many = lambda x: (x * np.uint64(2654435761) >> np.uint64(7)) % np.uint64(1000) < np.uint64(1000 * share)
        kinds = lambda x: np.where(np.isin(x, np.intersect1d(a, b)) | many(x), 1 + many(x).astype(int), 0)
        keys = [np.concatenate(ngram_join.set_keys(x, kinds(x), num, den, 16)) for x in (a, b)]
        assert len(np.intersect1d(*keys)), (len(a), len(b), share)
    assert near > 100


def test_copies_and_boilerplate_in_many_blocks(spark):
    common = " ".join(f"c{i}" for i in range(40))
    own = [(i, "the very same text of nine words stands here") for i in range(30)]
    own += [(100 + i, f"{common} {i}") for i in range(30)] + [(200 + i, f"own{i} words{i} of {i} " + common[: 20 + 3 * i]) for i in range(30)]
    own += [(300, None), (301, ""), (302, "two words"), (303, "Two Words")]
    for more in ({"frequent": 2, "block_bytes": 500, "unit": 10}, {"frequent": 2, "block_bytes": 500, "unit": 10, "refined": 4, "group": 16}):
        got = sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in ngram_join.near_duplicates(frame(spark, own), **more).collect())
        assert got == brute.near(own)


@pytest.mark.parametrize("parts", [1, 5])
def test_components(spark, parts):
    rng = random.Random(parts)
    graphs = [
        [(i, i + 1) for i in range(90)],
        [(rng.randrange(200), rng.randrange(200)) for _ in range(130)],
        [(-(2**63), 5), (5, 7), (7, 7), (9, 8), (9, 8)],
        [],
    ]
    for edges in graphs:
        forest = Forest()
        for a, b in edges:
            forest.union(a, b)
        nodes = {x for a, b in edges if a != b for x in (a, b)}
        rng.shuffle(edges)
        table = spark.createDataFrame(edges, "a long, b long").repartition(parts)
        got = components(table, Scratch(spark, "graph"), "links").collect()
        assert sorted((r.node, r.component) for r in got) == sorted((x, forest.find(x)) for x in nodes)


def test_large_group_of_near_copies(spark):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(60)]
    own = []
    for i in range(60):
        w = list(base)
        for k in rng.integers(0, 60, 1 + i % 2):
            w[k] = f"v{i}"
        own.append((i, " ".join(w)))
    df = frame(spark, own)
    for more in ({}, {"frequent": 5, "group": 10, "block_bytes": 1500}):
        got = sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in ngram_join.near_duplicates(df, **more).collect())
        assert got == brute.near(own)


def check_packing(pieces, own):
    want = {i: brute.ids(t) for i, t in own}
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(want)
    for i, ps in by_doc.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(want[i])
            assert p.ids_crc32 == brute.crc(want[i][at : at + p.length])
            at += p.length
        assert at == len(want[i])
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048 and at & (at - 1) == 0  # no sequence needs padding


def test_packing(odd, documents, rows):
    for df, own in ((odd, ODD), (documents, rows)):
        check_packing(packing.digest(packing.pack(df, block=3000)).collect(), own)


def test_step_groups_are_even():
    steps = packing.step_groups([2048] * 10 + [256] * 40, 8192)
    load = np.bincount(steps, [2048] * 10 + [256] * 40)
    assert load.max() - load.min() <= 2048


def test_exact(odd, documents, rows):
    for df, own in ((odd, ODD), (documents, rows)):
        for live in (200_000, 3):
            got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(df, live).collect())
            assert got == brute.exact(own)


def test_drop_copies_keeps_one_of_repeated_rows(spark):
    got = exact_dedup.drop_copies(frame(spark, [(1, "A"), (2, "a"), (2, "a"), (3, "b"), (None, None), (None, "")])).select("doc_id", "text").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == [(0, ""), (2, "a"), (3, "b")]


def test_digest_index_verifies_hits_in_buckets():
    import hashlib

    index = exact_dedup.DigestIndex(buckets=2)
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for turn in range(2):
        for i, k in enumerate(keys):
            index.add(k, 10, (i, turn))
    index.add(keys[0], 11, (7, 7))  # equal digest, another length
    assert len(index) == 3001 and len(index.buckets) > 512 and sorted(index.stored()) == sorted([*keys, keys[0]])
    assert index.remove(keys[5], 10) == [keys[5], 10, (5, 1), 2] and index.remove(keys[5], 10) is None
    assert index.remove(keys[0], 11) == [keys[0], 11, (7, 7), 1] and index.remove(keys[0], 10)[3] == 2
    clash = keys[9][:2] + bytes(2) + keys[9][4:12] + bytes(20)  # the filter cannot tell it from keys[9]
    assert clash in index.filter and index.remove(clash, 10) is None
    index.add(clash, 10, (1, 1))
    assert index.false_hits > 0 and index.remove(clash, 10)[3] == 1


def test_most_frequent_is_a_cut(spark):
    rows = [(f"p{i}", 1 + i * i % 5000) for i in range(3000)]
    counted = spark.createDataFrame(rows, "pre_token string, n long")
    for most in (0, 10, 500, 5000):
        got = sorted(r.n for r in token_counts.most_frequent(counted, most).collect())
        ranked = sorted(n for _, n in rows)
        assert len(got) <= most and got == ranked[len(ranked) - len(got) :]
        assert most < 500 or len(got) > most * 0.8 or len(got) == 3000


def test_cuckoo_filter():
    import hashlib

    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    stored = {}
    f = exact_dedup.CuckooFilter(lambda: stored, buckets=4, kicks=20)
    for k in keys:
        f.add(k)
        stored[k] = 1
    assert f.resizes > 3 and all(k in f for k in keys)
    others = [hashlib.sha256(f"x{i}".encode()).digest() for i in range(5000)]
    assert sum(k in f for k in others) < 25
    for k in keys[:2500]:
        assert f.discard(k)
        del stored[k]
    assert all(k in f for k in keys[2500:]) and sum(k in f for k in keys[:2500]) < 25


def test_token_files(odd, documents, rows):
    for df, own in ((odd, ODD), (documents, rows)):
        at, want = 0, []
        for i, t in sorted(own):
            ids = brute.ids(t)
            want.append((i, at, len(ids), brute.crc(ids)))
            at += len(ids)
        assert sorted(tuple(r) for r in token_files.round_trip(df).collect()) == want


def test_many_token_files(spark, documents, rows, tmp_path):
    files = token_files.write_token_files(documents, str(tmp_path / "t"), per_file=5000)
    assert files.count() > 3
    back = token_files.read_token_files(spark, f"file://{tmp_path}/t", files).collect()
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in back} == {i: brute.ids(t) for i, t in rows}


@pytest.mark.parametrize("n, size", [(0, 5), (1, 5), (255, 3), (256, 3), (257, 40_000), (70_000, 49_408)])
def test_huffman_round_trip(n, size):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.2, n) - 1, size - 1).astype(np.uint16)
    lengths = huffman.code_lengths(np.bincount(ids, minlength=size))
    assert lengths.max(initial=0) <= huffman.LIMIT and sum(2.0 ** -int(x) for x in lengths if x) <= 1
    back = huffman.read_file(huffman.write_file(np.array([7, 8]), np.array([n // 2, n - n // 2]), ids, lengths, huffman.canonical_codes(lengths)))
    assert back[0].tolist() == [7, 8] and (back[2] == ids).all()


def test_code_lengths_are_limited_and_optimal():
    assert huffman.code_lengths(np.array([2**i for i in range(30)])).max() == 16
    assert sorted(huffman.code_lengths(np.array([1, 1, 2, 4])).tolist()) == [1, 2, 3, 3]
