"""Personal data: fixed patterns, and identifiers that their contexts give away.

All of it is DataFrame expressions. A regular expression's matches come from
regexp_extract_all and the text between them from split; lengths give places.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.common import Scratch, prepare, texts

KINDS = ("email", "ip", "card", "phone")

#: What each kind looks like. A match begins where the last one
#: ended (\\G) or where its first characters' run begins, and never gives back
#: what it has taken: the same matches as without these marks, in linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

BYTE = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"

SPACE = r"\x20\x09-\x0D"

#: Words that may be identifiers: with a digit or an at sign.
TOKEN = rf"(?:\G|(?<![^{SPACE}]))[^{SPACE}0-9@]*+[0-9@][^{SPACE}]*+"

#: Runs of digit groups, bare or in brackets, joined by single spaces, hyphens or dots.
RUN = r"(?<![\p{L}0-9+])\+?(?:\([0-9]++\)|[0-9]++)(?:[\x20.-]?(?:\([0-9]++\)|[0-9]++))++"

#: Characters on either side in which context words are looked for.
REACH = 80


def places(rows: DataFrame, pattern: Column | str, key: str, extra: list[Column] | None = None) -> DataFrame:
    """(key, i, found, gap, after, start) for each match of a pattern in ``text``: what precedes and follows it, and where it begins."""
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    found = F.regexp_extract_all("text", p, F.lit(0))
    gaps = F.split("text", p, -1)
    arrays = rows.select(key, *(extra or []), found.alias("found"), gaps.alias("gaps")).where(F.size("found") > 0)
    zipped = F.arrays_zip("found", F.slice("gaps", F.lit(1), F.size("found")).alias("gap"), F.slice("gaps", F.lit(2), F.size("found")).alias("after"))
    names = [c for c in arrays.columns if c not in ("found", "gaps")]
    out = arrays.select(*names, F.posexplode(zipped).alias("i", "z")).select(*names, "i", F.col("z.found").alias("found"), F.col("z.gap").alias("gap"), F.col("z.after").alias("after"))
    w = Window.partitionBy(*names).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum(F.length("gap") + F.length("found")).over(w)
    return out.withColumn("start", (upto - F.length("found")).cast("long"))


def digits(c: str | Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes: every second digit from the right counts twice, less nine where above nine."""
    back = F.reverse(number)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int") * (1 + F.pmod(i - 1, F.lit(2)))
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.pmod(F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add), F.lit(10)) == 0


def valid(kind: str) -> Column:
    x = F.col("found")
    if kind == "ip":
        return x.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits(x)).between(13, 19), luhn(digits(x))).otherwise(False)
    if kind == "phone":
        return F.length(digits(x)).between(9, 15)
    return F.lit(True)


def base_spans(rows: DataFrame, key: str) -> DataFrame:
    """(key, kind, start, end) of all valid matches of the fixed patterns; ``same`` is a hash of the text."""
    may = {"email": F.contains("text", F.lit("@")), "ip": F.col("text").rlike(r"[0-9]\.[0-9]"), "card": F.col("text").rlike("[0-9][ -]?[0-9]"), "phone": F.contains("text", F.lit("+"))}
    each = []
    for kind in KINDS:
        found = places(rows.where(may[kind]), PATTERNS[kind], key).where(valid(kind))
        each.append(found.select(key, F.lit(kind).alias("kind"), "start", (F.col("start") + F.length("found")).alias("end"), F.xxhash64("found").alias("same")))
    return reduce(DataFrame.unionByName, each)


def context_words(c: Column) -> Column:
    """Lower-case words without the marks around them, digits as one 0."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(c), "[0-9]+", "0"), rf"(?<![^{SPACE}])[^\p{{L}}0-9@{SPACE}]++|[^\p{{L}}0-9@{SPACE}]++(?![^{SPACE}])", "")
    return F.filter(F.split(bare, rf"[{SPACE}]+"), lambda x: x != "")


def context_tokens(rows: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Words and spaced runs that may be identifiers, with their contexts; ``kind`` where a base span begins in one, ``inside`` where one overlaps it.

    Punctuation around a word is not part of it. A run (``run``) has spaces and as
    many digits as a phone or card; a base span is its kind where both begin.
    Contexts are lower-case words within 80 characters, without marks and with
    all numbers alike: the two before ("a b _"), and one on either side
    ("b _ c"), outside the whole run. Of an unseen run's own
    words, those that look like no kind are left out, as the run stands for them.
    """
    spaced = places(rows.where(F.col("text").rlike(r"[0-9]\)?[\x20]\(?[0-9]")), RUN, key)
    spaced = spaced.where(F.contains("found", F.lit(" ")) & (may_be("phone", F.col("found")) | may_be("card", F.col("found"))))
    t = places(rows, TOKEN, key).withColumn("run", F.lit(False)).unionByName(spaced.withColumn("run", F.lit(True)))
    core = F.when(F.col("run"), F.col("found")).otherwise(F.regexp_extract("found", r"[\p{L}0-9@+](?:.*[\p{L}0-9])?", 0))
    lead = F.when(F.col("run"), 0).otherwise(F.length(F.regexp_extract("found", r"^[^\p{L}0-9@+]*", 0)))
    before, behind = context_words(F.substring("gap", -REACH, REACH)), context_words(F.substring("after", 1, REACH))
    t = t.select(key, "run", (F.col("start") + lead).alias("start"), core.alias("token"), before.alias("before"), behind.alias("behind")).where("token <> ''")
    one, two = F.try_element_at("before", F.lit(-1)), F.try_element_at("before", F.lit(-2))
    patterns = F.filter(
        F.array(F.when(two.isNotNull(), F.concat(two, F.lit(" "), one, F.lit(" _"))), F.when(one.isNotNull(), F.concat(one, F.lit(" _ "), F.coalesce(F.try_element_at("behind", F.lit(1)), F.lit("$"))))),
        lambda x: x.isNotNull(),
    )
    t = t.select(key, "run", "start", (F.col("start") + F.length("token")).alias("end"), "token", patterns.alias("patterns"))
    both = t.withColumns({"kind": F.lit(None).cast("string"), "same": F.lit(None).cast("long")}).unionByName(spans.select(key, F.lit(False).alias("run"), "start", "end", "kind", "same", F.lit(None).cast("string").alias("token"), F.lit(None).cast("array<string>").alias("patterns")))
    order = Window.partitionBy(key).orderBy("start", F.col("token").isNotNull(), ~F.col("run"))
    is_span = F.col("token").isNull()
    reached = F.max(F.when(is_span, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    nearest = F.max(F.when(is_span, F.struct("start", "kind", "same"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    following = F.first(F.when(is_span, F.struct("start", "kind", "same")), ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    covered = F.max(F.when(F.col("run"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    out = both.select(key, "run", "start", "end", "token", "patterns", covered.alias("covered"), reached.alias("reached"), nearest.alias("nearest"), following.alias("following")).where("token is not null")
    inside = F.coalesce(F.col("reached") > F.col("start"), F.lit(False)) | F.coalesce(F.col("following.start") < F.col("end"), F.lit(False))
    begins = F.when(~F.col("run") & F.col("following.start").between(F.col("start"), F.col("end") - 1), F.col("following")).when((F.col("nearest.start") == F.col("start")) & (F.col("reached") > F.col("start")), F.col("nearest"))
    out = out.select(key, "run", "start", "end", "token", "patterns", "covered", inside.alias("inside"), begins.alias("seed"))
    part = ~F.col("run") & ~F.col("inside") & F.coalesce(F.col("covered") > F.col("start"), F.lit(False)) & ~reduce(lambda a, k: a | may_be(k, F.col("token")), KINDS, F.lit(False))
    return out.where(~part).select(key, "run", "start", "end", "token", "patterns", "inside", F.col("seed.kind").alias("kind"), F.col("seed.same").alias("same"))


def may_be(kind: str, token: Column) -> Column:
    """The least that an identifier of a kind must look like."""
    n = F.length(digits(token))
    return {"email": F.contains(token, F.lit("@")), "ip": token.rlike("^[0-9a-fA-F]+(?:[.:][0-9a-fA-F]+){3,}$"), "card": n.between(12, 19), "phone": n.between(6, 15)}[kind]


def score_graph(tokens: DataFrame, scratch: Scratch, rounds: int = 3, least_seeds: int = 3, smoothing: float = 2.0) -> DataFrame:
    """(instance, kind, score) of unseen instances after ``rounds`` over the pattern - instance graph.

    A pattern's confidence in a kind is the share of its instances' scores, with
    ``smoothing`` doubtful instances added; only patterns with at least
    ``least_seeds`` different seeds of the kind count. An unseen instance's score
    is that at least one of its patterns is right. Seeds keep 1. The graph holds
    each pair of pattern and instance once, with its count.
    """
    seen = tokens.where("not inside or kind is not null").select(F.explode("patterns").alias("pattern"), F.coalesce(F.concat(F.lit("="), "kind", F.lit(":"), F.col("same").cast("string")), "token").alias("instance"), "kind", "token")
    edges = scratch.save(seen.groupBy("pattern", "instance").agg(F.first("kind").alias("seed"), F.first("token").alias("token"), F.count("*").alias("n")), "edges")
    size = edges.groupBy("pattern").agg(F.count("*").alias("size"))
    seeds = edges.where("seed is not null").groupBy("pattern", F.col("seed").alias("kind")).agg(F.count("*").alias("seeds")).where(F.col("seeds") >= least_seeds)
    useful = scratch.save(seeds.join(size, "pattern"), "patterns")
    fits = reduce(lambda a, k: a | ((F.col("kind") == k) & may_be(k, F.col("token"))), KINDS, F.lit(False))
    links = scratch.save(edges.where("seed is null").join(useful.select("pattern", "kind"), "pattern").where(fits).select("pattern", "kind", "instance"), "links")
    scores = None
    for k in range(rounds):
        known = useful
        if scores is None:
            known = known.withColumn("found", F.lit(0.0))
        else:
            gained = links.join(scores, ["instance", "kind"]).groupBy("pattern", "kind").agg(F.sum("score").alias("found"))
            known = known.join(gained, ["pattern", "kind"], "left").withColumn("found", F.coalesce("found", F.lit(0.0)))
        sure = known.select("pattern", "kind", ((F.col("seeds") + F.col("found")) / (F.col("size") + smoothing)).alias("confidence"))
        doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))
        scores = scratch.save(links.join(sure, ["pattern", "kind"]).groupBy("instance", "kind").agg((1 - doubt).alias("score")), f"scores-{k}")
    return scores


def apart(found: DataFrame, key: str) -> DataFrame:
    """Of a found run and found words in it, the run, unless a word scores higher."""
    turn = F.sum(F.col("run").cast("int")).over(Window.partitionBy(key).orderBy("start", ~F.col("run")).rowsBetween(Window.unboundedPreceding, 0))
    of = Window.partitionBy(key, "turn")
    found = found.withColumn("turn", turn).withColumns({"run_end": F.max(F.when(F.col("run"), F.col("end"))).over(of), "run_score": F.max(F.when(F.col("run"), F.col("score"))).over(of)})
    part = ~F.col("run") & F.coalesce(F.col("run_end") > F.col("start"), F.lit(False))
    found = found.withColumn("part", part).withColumn("run_stays", F.coalesce(F.col("run_score") >= F.max(F.when(F.col("part"), F.col("score"))).over(of), F.lit(True)))
    return found.where((~F.col("part") & ~F.col("run")) | (F.col("run") == F.col("run_stays")))


def personal(docs: DataFrame, rounds: int = 3, least: float = 0.6) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256 and spans for each row of ``docs``.

    Base spans are the valid matches of the fixed patterns. They are the seeds:
    their contexts induce patterns, patterns and the words (and spaced runs of
    digits) seen in them score each other over ``rounds``, and those of score ``least`` or more that look
    like the kind and lie outside all base spans are spans too (of the kind that
    scores highest; ties: the first by name). Only texts with a digit or an at
    sign can hold spans; the others leave after one look.
    """
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "personal")
    numbered = texts(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    # written once: a row's number need not be the same in a second scan
    numbered = scratch.save(numbered.withColumn("text", F.when(F.col("text").rlike("[0-9@]"), F.col("text"))), "rows")
    rows = numbered.where("text is not null").select("row", "text")
    base = scratch.save(base_spans(rows, "row"), "base")
    tokens = scratch.save(context_tokens(rows, base, "row"), "tokens")
    scores = score_graph(tokens, scratch, rounds).where(F.col("score") >= least)
    best = scores.groupBy("instance").agg(F.min_by("kind", F.struct(-F.col("score"), F.col("kind"))).alias("kind"), F.max("score").alias("score"))
    new = tokens.where("not inside and kind is null").drop("kind", "same").join(best, F.col("token") == F.col("instance"))
    new = apart(new.select("row", "run", "kind", "start", "end", "score"), "row").select("row", "kind", "start", "end")
    spans = base.drop("same").withColumn("base", F.lit(True)).unionByName(new.withColumn("base", F.lit(False)))
    rank = reduce(lambda a, k: a.when(F.col("kind") == k[1], k[0]), enumerate(KINDS), F.when(F.lit(False), 0))
    each = F.struct(rank.alias("rank"), "start", "end", F.concat_ws(":", "kind", "start", "end").alias("s"))
    mine = F.collect_list(F.when(F.col("base"), each))
    found = spans.groupBy("row").agg(
        *[F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{k}") for k in KINDS],
        F.array_join(F.array_sort(mine)["s"], ",").alias("base"),
        F.array_join(F.array_sort(F.collect_list(each))["s"], ",").alias("spans"),
    )
    out = numbered.select("row", "doc_id").join(found, "row", "left")
    return out.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))
