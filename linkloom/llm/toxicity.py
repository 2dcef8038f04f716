"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

Voters are of several kinds: a public list of insults for each of four
languages, word stems mined from labelled rows by length, masked words,
shouting, an insult near a word of address, exclamations, and how many,
how different and how frequent the hits are; one votes for clean. Each abstains
where it has nothing to go by. A label model learns from the votes on all
documents how often each voter fires on either class, and which voters depend on
each other; its posteriors are the labels on which a linear classifier over the
single words and stems and the voters' signals is trained.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import Scratch, partitions, prepare, texts

#: Insults of four languages, as public word lists have them.
INSULTS = {
    "en": "idiot moron imbecile stupid dumb fool clown loser pathetic worthless useless disgusting filthy scum trash garbage vermin pig freak jerk".split(),
    "fr": "imbécile crétin abruti débile ordure minable raté dégoûtant connard salaud".split(),
    "de": "dummkopf trottel depp abschaum müll erbärmlich wertlos ekelhaft arschloch schwachkopf".split(),
    "es": "imbécil estúpido basura escoria patético inútil asqueroso payaso perdedor cabrón".split(),
}

#: Frequent words by which a text shows that a language's list applies to it.
FUNCTION_WORDS = {
    "en": frozenset("the and of to is are was you that with for not have this".split()),
    "fr": frozenset("le la les et des est une que vous dans pour pas avec sont".split()),
    "de": frozenset("der die das und ist nicht ein eine mit sie den von auch sind".split()),
    "es": frozenset("el la los y que es una por con para no las del está".split()),
}

#: Words of address in these languages.
ADDRESS = frozenset("you your u ya tu toi vous ton ta du dich dir ihr sie euch tú ti usted ustedes vos eres".split())

MASKED = re.compile(r"(?<![\w*$#])[^\W\d_]+[*$#]+[^\W\d_]+(?![\w*$#])")
SHOUTED = re.compile(r"(?<![^\W_])[A-ZÀ-ÖØ-Þ]{3,}(?![^\W_])")

LETTERS = re.compile(r"[^\W\d_]+")

#: Lengths of mined stems; a word of its own length counts as a stem too.
STEMS = (4, 5, 6, 7, 8)


def stems(word: str) -> list[str]:
    """"word|" is the whole word, "word" all words that begin so."""
    return [word[:k] for k in STEMS if k <= len(word)] + [f"{word}|"]


def _mine(cells: int = 400_000):
    """Documents of either class in which a stem occurs once, or more often."""

    def rows(seen: dict) -> pa.RecordBatch:
        n = np.array(list(seen.values()), np.int64).reshape(-1, 4)
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *[pa.array(n[:, i]) for i in range(4)]], names=["stem", "c1", "t1", "c2", "t2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}
        for b in batches:
            for t, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = Counter()
                for w, k in Counter(LETTERS.findall(t.lower())).items():
                    if len(w) <= 40:
                        for s in stems(w):
                            found[s] += k
                for s, k in found.items():
                    x = seen.setdefault(s, [0, 0, 0, 0])
                    x[toxic] += 1
                    if k > 1:
                        x[2 + toxic] += 1
                if len(seen) > cells:
                    yield rows(seen)
                    seen = {}
        yield rows(seen)

    return run


VOTER_NAMES = (*[f"list:{x}" for x in INSULTS], "short stems", "long stems", "mined words", "masked", "shouting", "addressed", "exclaimed", "many hits", "different hits", "frequent hits", "clean")
VOTERS = len(VOTER_NAMES)
V = {name: i for i, name in enumerate(VOTER_NAMES)}


def families_of(entries: dict[str, int]) -> np.ndarray:
    """The voters to which an entry belongs, as bits."""
    out = np.zeros(len(entries), np.int64)
    listed: dict[str, int] = {}
    for lang, words in INSULTS.items():
        for w in words:
            listed[f"{w}|"] = listed.get(f"{w}|", 0) | 1 << V[f"list:{lang}"]
    for e, i in entries.items():
        out[i] = listed.get(e) or 1 << V["mined words" if e.endswith("|") else "short stems" if len(e) <= 5 else "long stems"]
    return out


@dataclass
class Lexicon:
    """Scored words and stems; a word belongs to its longest stem here."""

    ids: dict[str, int]
    dull: set = field(default_factory=set)
    older: set = field(default_factory=set)
    known: dict = field(default_factory=dict)

    def _of(self, chunk: str) -> tuple[int, ...]:
        out = []
        for w in LETTERS.findall(chunk):
            for s in (f"{w}|", *[w[:k] for k in reversed(STEMS)]):
                if (i := self.ids.get(s)) is not None:
                    out.append(i)
                    break
        return tuple(out)

    def hits(self, words: list[str], different: set[str]) -> tuple[dict[int, int], set[str]]:
        """Occurrences of each entry in lower-cased words, and the words that hold one."""
        found: dict[int, int] = {}
        holders = set()
        for c in different - self.dull:
            if (own := self.known.get(c)) is None:
                own = () if c in self.older else self._of(c)
                if own:
                    self.known[c] = own
                    if len(self.known) > 100_000:
                        self.known.clear()
                else:
                    self.dull.add(c)
                    continue
            holders.add(c)
            n = words.count(c)
            for i in own:
                found[i] = found.get(i, 0) + n
        if len(self.dull) > 250_000:
            self.older, self.dull = self.dull, set()
        return found, holders


def near_address(words: list[str], holders: set[str], reach: int = 3) -> bool:
    """Whether a word of address stands within ``reach`` words of a hit."""
    last_hit = last_address = -(10**9)
    for i, w in enumerate(words):
        if w in holders:
            last_hit = i
        if w.strip(".,!?;:'\"") in ADDRESS:
            last_address = i
        if abs(last_hit - last_address) <= reach:
            return True
    return False


def vote(text: str, words: list[str], different: set[str], found: dict[int, int], holders: set[str], families: np.ndarray) -> tuple[int, int]:
    """Bits of the voters that fire, and of those that abstain."""
    fires = 0
    for i in found:
        fires |= int(families[i])
    abstain = 0
    for lang, function in FUNCTION_WORDS.items():
        if not fires >> V[f"list:{lang}"] & 1 and function.isdisjoint(different):
            abstain |= 1 << V[f"list:{lang}"]
    total = sum(found.values())
    fires |= (MASKED.search(text) is not None) << V["masked"]
    if len(words) < 10:
        abstain |= 1 << V["shouting"]
    else:
        fires |= (10 * len(SHOUTED.findall(text)) >= 3 * len(words)) << V["shouting"]
    if ADDRESS.isdisjoint(different):
        abstain |= 1 << V["addressed"]
    elif total:
        fires |= near_address(words, holders) << V["addressed"]
    if "!" in text:
        fires |= ("!!" in text or "!?" in text or "?!" in text) << V["exclaimed"]
    else:
        abstain |= 1 << V["exclaimed"]
    if total:
        fires |= (total >= 3) << V["many hits"]
        fires |= (len(found) >= 2) << V["different hits"]
        fires |= (100 * total >= len(words)) << V["frequent hits"]
    else:
        abstain |= 1 << V["many hits"] | 1 << V["different hits"] | 1 << V["frequent hits"]
    if len(words) < 20:
        abstain |= 1 << V["clean"]
    else:
        fires |= (not total) << V["clean"]
    return fires, abstain


FEATURES = "row long, doc_id long, n_words long, ids binary, counts binary, votes long"


def _features(ids: dict[str, int], families: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(ids)
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                n, keys, counts, votes = [], [], [], []
                for t in part.column(2).to_pylist():
                    words = t.lower().split()
                    different = set(words)
                    found, holders = lexicon.hits(words, different)
                    k = np.array(sorted(found), np.int32)
                    c = np.array([found[i] for i in k.tolist()], np.int32)
                    fires, abstain = vote(t, words, different, found, holders, families)
                    n.append(len(words))
                    keys.append(k.astype("<i4").tobytes())
                    counts.append(c.astype("<i4").tobytes())
                    votes.append(fires | abstain << 32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary()), pa.array(votes, pa.int64())],
                    names=["row", "doc_id", "n_words", "ids", "counts", "votes"],
                )

    return run


def unpack(votes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each document and voter: does it fire, does it take part."""
    votes = np.asarray(votes, np.int64)
    bits = np.arange(VOTERS)
    return ((votes[:, None] >> bits) & 1).astype(float), 1.0 - ((votes[:, None] >> (32 + bits)) & 1)


@dataclass
class LabelModel:
    """P(class), P(voter fires | class, it takes part), and how far voters depend on each other within classes."""

    prior: float
    fires: np.ndarray  # class, voter
    dependence: np.ndarray  # voter, voter

    def posterior(self, fire: np.ndarray, active: np.ndarray) -> np.ndarray:
        """P(toxic) of documents. A voter's evidence is shared with those that take part and depend on it; who abstains says nothing."""
        share = 1 / (1 + active @ np.clip(self.dependence, 0, None))
        p1, p0 = self.fires[1], self.fires[0]
        said = np.where(fire > 0, np.log(p1 / p0), np.log((1 - p1) / (1 - p0)))
        odds = np.log(self.prior / (1 - self.prior)) + (said * active * share).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


def fit_label_model(fire: np.ndarray, active: np.ndarray, counts: np.ndarray, start: np.ndarray, prior: float, rounds: int = 60, tied: float = 100.0) -> LabelModel:
    """Expectation and maximisation over the counts of vote patterns of all documents.

    start: P(fires | class) from labelled rows, one row for each class; it also
    weighs as ``tied`` documents throughout, which ties the classes to their names.
    """
    weight = counts.astype(float)
    voters = fire.shape[1]
    model = LabelModel(prior, np.clip(start, 1e-4, 1 - 1e-4), np.zeros((voters, voters)))
    for _ in range(rounds):
        p = model.posterior(fire, active)
        fires, dependence = [], np.zeros((voters, voters))
        for c, q in enumerate((1 - p, p)):
            w = (weight * q)[:, None] * active
            mean = ((w * fire).sum(axis=0) + tied * start[c]) / (w.sum(axis=0) + tied)
            fires.append(np.clip(mean, 1e-4, 1 - 1e-4))
            x = (fire - mean) * active
            cov = (x * (weight * q)[:, None]).T @ x / (w.T @ active + tied)
            dev = np.sqrt(np.clip(mean * (1 - mean), 1e-6, None))
            share = model.prior if c else 1 - model.prior
            dependence += share * cov / np.outer(dev, dev)
        np.fill_diagonal(dependence, 0)
        now = float(np.clip((weight @ p + tied * prior) / (weight.sum() + tied), 0.005, 0.5))
        done = abs(now - model.prior) < 1e-6 and np.abs(fires - model.fires).max() < 1e-6
        model = LabelModel(now, np.array(fires), dependence)
        if done:
            break
    return model


#: Signals of voters that see more than the hits.
SIGNALS = ("masked", "shouting", "addressed", "exclaimed")
GENERAL = 5 + len(SIGNALS)


def design(rows: list[tuple[int, np.ndarray, np.ndarray, int]], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse features of documents (row, column, value): general ones first, then one for each entry."""
    r, k, v = [], [], []
    for i, (words, ids, counts, votes) in enumerate(rows):
        total = int(counts.sum())
        general = (1.0, np.log1p(total), np.log1p(len(ids)), min(1.0, 20 * total / max(1, words)), float(total >= 2), *[float(votes >> V[x] & 1) for x in SIGNALS])
        r.append(np.full(GENERAL + len(ids), i))
        k.append(np.concatenate([np.arange(GENERAL), GENERAL + ids]))
        v.append(np.concatenate([general, np.minimum(counts, 3) / 3]))
    if not rows:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    return np.concatenate(r), np.concatenate(k), np.concatenate(v)


def fit_linear(sparse, n: int, size: int, target: np.ndarray, penalty: float = 1e-3, rounds: int = 400, rate: float = 0.5) -> np.ndarray:
    """Logistic regression on soft labels by full gradients with momentum."""
    r, k, v = sparse
    w, speed = np.zeros(GENERAL + size), np.zeros(GENERAL + size)
    shrink = np.full(len(w), penalty)
    shrink[0] = 0
    for _ in range(rounds):
        z = np.bincount(r, v * w[k], minlength=n)
        g = np.bincount(k, v * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - target)[r], minlength=len(w)) / max(1, n) + shrink * w
        speed = 0.9 * speed - rate * g
        w = w + speed
    return w


def scores(sparse, n: int, w: np.ndarray) -> np.ndarray:
    r, k, v = sparse
    return 1 / (1 + np.exp(-np.clip(np.bincount(r, v * w[k], minlength=n), -40, 40)))


def best_shift(score: np.ndarray, label: np.ndarray) -> float:
    """What to add to the log-odds so that 0.5 parts labelled rows best (by F1)."""
    if not label.any():
        return 0.0
    odds = np.log(np.clip(score, 1e-15, 1 - 1e-15) / np.clip(1 - score, 1e-15, 1))
    order = np.argsort(-odds, kind="stable")
    hit = np.cumsum(label[order])
    f1 = 2 * hit / (np.arange(1, len(hit) + 1) + label.sum())
    end = np.append(odds[order][1:] < odds[order][:-1], True)
    k = int(np.argmax(np.where(end, f1, -1)))
    low = odds[order][k + 1] if k + 1 < len(order) else odds[order][k] - 1
    return -float((odds[order][k] + low) / 2)


def _score(w: np.ndarray, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = decode(b)
            s = scores(design(rows, size), len(rows), w)
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(s, pa.float64())], names=["doc_id", "score"])

    return run


def decode(b) -> list[tuple[int, np.ndarray, np.ndarray, int]]:
    return [(n, np.frombuffer(i, "<i4"), np.frombuffer(c, "<i4"), v) for n, i, c, v in zip(*(b.column(x).to_pylist() for x in ("n_words", "ids", "counts", "votes")))]


def evidence(c: float, t: float, clean: int, toxic: int) -> float:
    """How unlikely t of t + c documents are toxic by chance: the log of the Chernoff bound, 0 if they are few."""
    n, share = t + c, toxic / (toxic + clean)
    p = t / n if n else 0
    if p <= share:
        return 0.0
    return n * (p * np.log(p / share) + ((1 - p) * np.log((1 - p) / (1 - share)) if p < 1 else 0.0))


def choose(found: dict[str, list], clean: int, toxic: int, most: int, least: float = 16.0) -> list[str]:
    """Stems that chance does not explain; a longer one only where it says more than the shorter ones it begins with.

    exp(-16) is about one in ten million, against hundreds of thousands of stems.
    """
    scored = {}
    for i, s in enumerate(found["stem"]):
        best = max(evidence(found["c1"][i], found["t1"][i], clean, toxic), evidence(found["c2"][i], found["t2"][i], clean, toxic))
        if best >= least:
            scored[s] = best
    out = []
    for s in sorted(scored, key=lambda s: (-scored[s], s)):
        shorter = [s[:k] for k in STEMS if k < len(s.rstrip("|"))] + ([s[:-1]] if s.endswith("|") else [])
        if not any(scored.get(x, 0) >= scored[s] for x in shorter):
            out.append(s)
    return out[:most]


def training_rows(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """text and toxic of the chosen rows; of texts that are equal but for case and white space, one for each label."""
    labelled = rows.join(F.broadcast(chosen), "doc_id")
    same = F.sha2(F.regexp_replace(F.lower("text"), r"\s+", " "), 256)
    return labelled.groupBy(same.alias("same"), "toxic").agg(F.min("text").alias("text")).select("text", "toxic")


def toxicity(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, most_stems: int = 2_000) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs``.

    Only labels of rows whose crc32 of doc_id (as text; null: empty) is not
    divisible by 5 are used: of those, at most ``most_rows`` with the smallest
    hashes, a sample for mining stems and fitting the classifier; all different
    texts of that sample are mined. Votes are counted over all documents. score
    depends on the text alone; empty texts get the score of a text without hits,
    and texts of any length are read whole (a task holds one's words). Labels
    that repeat count as toxic if one of them is, null ones and those without
    doc_id are none; without labels, the public lists vote alone.
    """
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "toxicity")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    rows = texts(docs)
    marked = labels.where("toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    marked = marked.where("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(fold != 0)
    chosen = scratch.save(marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows), "chosen")
    train = scratch.save(training_rows(rows, chosen), "train")
    schema = "stem string, c1 long, t1 long, c2 long, t2 long"
    mined = train.select("text", "toxic").mapInArrow(_mine(), schema).groupBy("stem").agg(*[F.sum(c).alias(c) for c in ("c1", "t1", "c2", "t2")])
    classes = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    clean, toxic = classes.get(0, 0), classes.get(1, 0)
    many = F.col("t1") * clean > 2 * toxic * F.col("c1")
    many2 = F.col("t2") * clean > 2 * toxic * F.col("c2")
    mined = mined.where(F.col("t1") >= 5).where(many | many2).orderBy(F.desc("t1"), "stem").limit(20 * most_stems)
    entries = choose(mined.toArrow().to_pydict(), clean, toxic, most_stems) if toxic else []
    ids = {s: i for i, s in enumerate(dict.fromkeys([*[f"{w}|" for own in INSULTS.values() for w in own], *entries]))}

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    features = scratch.save(numbered.mapInArrow(_features(ids, families_of(ids)), FEATURES), "features")
    patterns = features.groupBy("votes").count().toArrow()
    fit = features.join(F.broadcast(chosen), "doc_id").select("n_words", "ids", "counts", "votes", "toxic").toArrow()
    label = fit["toxic"].to_numpy().astype(int)
    fire, active = unpack(fit["votes"].to_numpy())
    default = np.full((2, VOTERS), 0.02)
    default[1] = 0.4
    default[:, V["clean"]] = 0.9, 0.1
    start = np.array([((fire * active)[label == c].sum(axis=0) + 10 * default[c]) / (active[label == c].sum(axis=0) + 10) for c in (0, 1)])
    prior = float(np.clip(label.mean(), 0.01, 0.5)) if len(label) else 0.1
    model = fit_label_model(*unpack(patterns["votes"].to_numpy()), patterns["count"].to_numpy(), start, prior)
    data = decode(fit)
    sparse = design(data, len(ids))
    if data:
        w = fit_linear(sparse, len(data), len(ids), model.posterior(fire, active))
        w[0] += best_shift(scores(sparse, len(data), w), label)
    else:
        w = np.zeros(GENERAL + len(ids))
        w[:5] = (-3, 2, 1, 1, 1)
    scored = features.mapInArrow(_score(w, len(ids)), "doc_id long, score double")
    return scored.select("doc_id", (fold == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
