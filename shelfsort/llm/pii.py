"""Personal data by bootstrapped contextual extraction, in SQL expressions only.

Base patterns give the seeds: e-mail addresses, IP addresses, card numbers
(Luhn) and international phone numbers.  The words around a seed are lexical
patterns: the word before it, the two words before it, the word after it.
Looser shapes (an address with any letters or without a top-level domain, a
number of phone or card length without its prefix) are candidates.

Patterns and instances form a graph, an edge for every instance met in a
pattern.  Scores go round it, seeds staying at 1:

* a pattern's score is the share of all places where its words stand in the
  corpus that are filled by instances, each counting its own score; it needs
  ``SUPPORT`` different instances that score ``ACCEPT`` or more;
* an instance's score joins those of its patterns as independent evidence.

Words that stand anywhere ("the") score next to nothing, since the count of all
their places divides; "phone:" scores high.  Accepted instances are spans
wherever they stand, and carry their other patterns into the next round.

Texts are read twice: once for matches, gaps between matches and the few words
around (no text is kept), once to count the places of the patterns' words.  A
position is the sum of the gaps and matches before it, one window over the
matches of one row.  Runs of name characters start only at their beginning, and
possessive groups never go back, so a match takes time linear in its text.

Defined cases: rows are told apart by a number of their own, so null and
repeated ids keep a result each; null texts are empty and have no spans; texts
of any length are read whole; a context word is cut at 40 characters before it
becomes a pattern; added spans never overlap base spans, and of candidates that
overlap the better score stays, then the longer, then the earlier kind; an
empty table gives no rows; other columns of the table play no part.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfsort.llm.common import LOWER, UPPER, materialise, store

KINDS = ("email", "ip", "card", "phone")
NAME = r"A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{NAME}]))[{NAME}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser shapes: candidates for the kinds that ``loose_kinds`` finds fitting.
LOOSE = {
    "address": r"[^\x00-\x20\x7F()<>\[\],;:\"@]++@[^\x00-\x20\x7F()<>\[\],;:\"@]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]",
    "number": r"(?<![A-Za-z0-9])\(?[0-9][\x20()./0-9-]*[0-9](?![A-Za-z0-9])",
}
#: A text without this can't match.
NEEDS = {"email": "@", "phone": "+", "address": "@"}
ROUNDS, SUPPORT, ACCEPT = 8, 3, 0.6
WORD = 40
#: Between the words of patterns: white space, digits and what opens a value, so "tel:+1 ..." has the word "tel:".
BETWEEN = r"[\x20\x09-\x0D0-9+()@\"'<>]+"
BROADCAST_PATTERNS, BROADCAST_BYTES = 200_000, 16 << 20


# ---- expressions ------------------------------------------------------------------

def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """The digits pass the Luhn check."""
    def worth(c: Column, i: Column) -> Column:
        n = c.cast("int")
        return F.when(i % 2 == 0, n).otherwise(n * 2 - F.when(n > 4, 9).otherwise(0))
    parts = F.filter(F.split(F.reverse(number), ""), lambda c: c != "")
    return F.aggregate(F.transform(parts, worth), F.lit(0), lambda a, b: a + b) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """The condition beyond the pattern (a failing match is dropped)."""
    number = digits(value)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) <= F.when(
            F.lpad(F.ltrim(p, F.lit("0")), 3, "0") <= "255", 3).otherwise(2))
    if kind == "card":
        return F.length(number).between(13, 19) & luhn(F.substring(number, 1, 19))
    if kind == "phone":
        return F.length(number).between(9, 15)
    return F.lit(True)


def loose_kinds(shape: str, value: Column) -> Column:
    """The kinds a loose match may be an instance of."""
    if shape == "address":
        return F.array(F.lit("email"))
    n, number = F.length(digits(value)), digits(value)
    return F.filter(F.array(F.when(n.between(13, 19) & luhn(F.substring(number, 1, 19)), F.lit("card")),
                            F.when(n.between(7, 15), F.lit("phone"))), lambda k: k.isNotNull())


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, UPPER, LOWER), BETWEEN), lambda w: w != "")


def found(text: Column, shape: str, pattern: str) -> Column:
    """Every match of a text in order, as (gap, size, kinds, value, before, after).

    ``gap`` is the length of the text between the last match and this one; the
    words next to the match are taken from the gaps on both sides.  ``value`` is
    kept for valid matches only.  The last element is the rest of the text.
    """
    cut = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), 0).alias("m"), F.split(text, pattern).alias("p"))

    def row(x: Column) -> Column:
        value, gap = x["m"], x["p"]
        kinds = loose_kinds(shape, value) if shape in LOOSE else F.when(valid(shape, value), F.array(F.lit(shape))).otherwise(F.array())
        kinds = F.when(value.isNotNull(), kinds.cast("array<string>")).otherwise(F.array().cast("array<string>"))
        return F.struct(F.length(gap).alias("gap"), F.coalesce(F.length(value), F.lit(0)).alias("size"), kinds.alias("kinds"),
                        F.when(F.size(kinds) > 0, F.translate(value, UPPER, LOWER)).alias("value"),
                        F.substring(gap, -2 * WORD - 2, 2 * WORD + 2).alias("before"), F.substring(gap, 1, WORD + 1).alias("after"))

    # a number needs two characters that end in digits; anything else needs its own mark
    may = text.contains(NEEDS[shape]) if shape in NEEDS else text.rlike("[0-9]")
    rows = F.transform(F.when(may, cut), row)
    # without a match (one gap) nothing is kept
    return F.when(F.size(rows) > 1, rows)


# ---- matches ----------------------------------------------------------------------------

def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row, doc_id and the matches of every shape, without the texts; stored."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    shapes = BASE | LOOSE
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"),
                       *[found(t, s, p).alias(s) for s, p in shapes.items()])
    return store(rows, "pii-matches")


def mentions(matches: DataFrame) -> DataFrame:
    """row, shape, kind, start, end, value, left1, left2, right1: valid matches
    with their place in code points and the words around them."""
    shapes = [*BASE, *LOOSE]
    each = matches.select("row", F.explode(F.filter(F.array(*[
        F.struct(F.lit(s).alias("shape"), F.col(s).alias("list")) for s in shapes]), lambda x: x["list"].isNotNull())).alias("x"))
    flat = each.select("row", "x.shape", F.posexplode("x.list").alias("at", "m")).select("row", "shape", "at", "m.*")
    w = Window.partitionBy("row", "shape").orderBy("at")
    start = F.sum(F.col("gap") + F.col("size")).over(w) - F.col("size")
    placed = flat.select("row", "shape", "kinds", "value", start.alias("start"), (start + F.col("size")).alias("end"), "before",
                         F.lead("after").over(w).alias("after")).where(F.size("kinds") > 0)
    left = words(F.col("before"))
    right = words(F.col("after"))
    return placed.select(
        "row", "shape", F.explode("kinds").alias("kind"), "start", "end", "value",
        F.substring(F.get(left, F.size(left) - 1), 1, WORD).alias("left1"),
        F.substring(F.get(left, F.size(left) - 2), 1, WORD).alias("left2"), F.substring(F.get(right, F.lit(0)), 1, WORD).alias("right1"))


def candidates(found_: DataFrame) -> DataFrame:
    """Loose mentions that no base span overlaps."""
    base = found_.where(F.col("shape").isin(*BASE)).select("row", F.col("start").alias("s"), F.col("end").alias("e"))
    return (found_.where(F.col("shape").isin(*LOOSE))
            .join(base, (found_["row"] == base["row"]) & (F.col("start") < F.col("e")) & (F.col("s") < F.col("end")), "left_anti"))


# ---- patterns and scores ---------------------------------------------------------------------

def patterns(found_: DataFrame) -> DataFrame:
    """kind, value, side, first, second of every mention: up to three patterns.

    ``second`` is the word next to the mention; ``first`` the one before it, for
    patterns of two words.
    """
    one = F.struct(F.lit("left").alias("side"), F.lit(None).cast("string").alias("first"), F.col("left1").alias("second"))
    two = F.struct(F.lit("pair").alias("side"), F.col("left2").alias("first"), F.col("left1").alias("second"))
    after = F.struct(F.lit("right").alias("side"), F.lit(None).cast("string").alias("first"), F.col("right1").alias("second"))
    kept = F.filter(F.array(one, two, after), lambda p: p["second"].isNotNull() & ((p["side"] != "pair") | p["first"].isNotNull()))
    return found_.select("kind", "value", F.explode(kept).alias("p")).select("kind", "value", "p.*")


PATTERN = ["side", "first", "second"]


def same_pattern(a: DataFrame, b: DataFrame, *more: str) -> Column:
    on = (a["side"] == b["side"]) & a["first"].eqNullSafe(b["first"]) & (a["second"] == b["second"])
    for c in more:
        on = on & (a[c] == b[c])
    return on


def counted(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` with the number of ``rows`` equal to each, over all columns of
    ``wanted``.  A short list goes to the scan, so only its own rows are counted;
    beyond that bound rows are counted first.  Either way a frequent row is
    summed in the scan's tasks before it moves."""
    keys = wanted.columns
    listed = wanted.distinct()
    if len(listed.limit(BROADCAST_PATTERNS + 1).select(F.lit(1)).collect()) <= BROADCAST_PATTERNS and (
            listed.agg(F.sum(sum((F.octet_length(k) + 16 for k in keys), F.lit(0)))).first()[0] or 0) <= BROADCAST_BYTES:
        rows = rows.join(F.broadcast(listed), keys, "left_semi")
    return listed.join(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("places")), keys)


def places(docs: DataFrame, wanted: DataFrame, text: str = "text") -> DataFrame:
    """side, first, second, places: how often the words of each wanted pattern
    stand in the corpus."""
    line = words(F.coalesce(F.col(text).cast("string"), F.lit("")))
    single = docs.select(F.explode(line).alias("second")).select(F.substring("second", 1, WORD).alias("second"))
    pair = docs.select(F.explode(F.arrays_zip(line.alias("a"), F.slice(line, 2, F.greatest(F.size(line), F.lit(1))).alias("b"))).alias("p"))
    pair = (pair.select(F.substring("p.a", 1, WORD).alias("first"), F.substring("p.b", 1, WORD).alias("second"))
            .where(F.col("second").isNotNull()))
    ones, twos = wanted.where("side <> 'pair'"), wanted.where("side = 'pair'")
    return (ones.join(counted(single, ones.select("second")), "second").select(*PATTERN, "places")
            .unionByName(twos.join(counted(pair, twos.select("first", "second")), ["first", "second"]).select(*PATTERN, "places")))


def scores(docs: DataFrame, seeds: DataFrame, loose: DataFrame, text: str = "text", rounds: int = ROUNDS,
           support: int = SUPPORT, accept: float = ACCEPT) -> DataFrame:
    """kind, value, score of the candidate instances, after ``rounds`` rounds.

    Only patterns that meet a candidate can change a score, so the others are
    left out before the corpus is counted.
    """
    own = patterns(loose).groupBy("kind", "value", *PATTERN).agg(F.count(F.lit(1)).alias("n"))
    own = materialise(own)
    wanted = own.select(*PATTERN).distinct()
    total = materialise(places(docs, wanted, text))
    # seeds don't change: their part of every pattern is summed once
    met = patterns(seeds).groupBy("kind", "value", *PATTERN).agg(F.count(F.lit(1)).alias("n"))
    sure = (met.groupBy("kind", *PATTERN).agg(F.sum("n").alias("sure"), F.count(F.lit(1)).alias("seeds")))
    by_kind = own.select("kind", *PATTERN).distinct()
    known = by_kind.join(total, same_pattern(by_kind, total)).select(by_kind["kind"], *[by_kind[c] for c in PATTERN], "places")
    fixed = materialise(known.join(sure, same_pattern(known, sure, "kind"), "left").select(
        known["kind"], *[known[c] for c in PATTERN], "places", F.coalesce("sure", F.lit(0)).alias("sure"),
        F.coalesce("seeds", F.lit(0)).alias("seeds")))
    edges = materialise(own.join(fixed, same_pattern(own, fixed, "kind")).select(
        own["kind"], own["value"], F.xxhash64(own["side"], F.coalesce(own["first"], F.lit("\x00")), own["second"]).alias("pattern"),
        "n", "places", "sure", "seeds"))
    score = own.select("kind", "value").distinct().withColumn("score", F.lit(0.0))
    for _ in range(rounds):
        heard = edges.join(score, ["kind", "value"])
        trust = heard.groupBy("kind", "pattern").agg(
            ((F.max("sure") + F.sum(F.col("n") * F.col("score"))) / (F.max("places") + 1)).alias("p"),
            (F.max("seeds") + F.sum((F.col("score") >= accept).cast("int"))).alias("backing"))
        trust = trust.where(F.col("backing") >= support).select("kind", "pattern", F.least(F.col("p"), F.lit(0.999)).alias("p"))
        score = materialise(edges.select("kind", "value", "pattern").join(trust, ["kind", "pattern"], "left")
                            .groupBy("kind", "value")
                            .agg((1.0 - F.exp(F.sum(F.log(1.0 - F.coalesce("p", F.lit(0.0)))))).alias("score")))
    return score


def discover(docs: DataFrame, seeds: DataFrame, loose: DataFrame, text: str = "text", accept: float = ACCEPT, **how) -> DataFrame:
    """row, kind, start, end of the accepted candidates, none overlapping another.

    Of overlapping ones the best stays (score, length, kind); candidates of one
    shape never overlap, so a chain joins at most the two shapes of one place.
    """
    good = scores(docs, seeds, loose, text, accept=accept, **how).where(F.col("score") >= accept)
    rank = F.struct(-F.round("score", 9), F.col("start") - F.col("end"),
                    F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")), "start")
    hit = materialise(loose.join(good, ["kind", "value"]).select("row", "kind", "start", "end", rank.alias("rank")))
    a, b = hit.alias("a"), hit.alias("b")
    return a.join(b, (F.col("a.row") == F.col("b.row")) & (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end"))
                  & (F.col("b.rank") < F.col("a.rank")), "left_anti").select("row", "kind", "start", "end")


# ---- the operator -----------------------------------------------------------------------------------

def spelled(spans: Column) -> Column:
    """kind:start:end of spans (place of the kind, start, end), comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """doc_id, base, spans: for every row of ``docs`` the base spans and all
    spans, as sorted lists of (kind, start, end); ``kind`` counts from 0 in
    ``KINDS``."""
    matches = scan(docs, doc_id, text)
    all_ = materialise(mentions(matches))
    seeds = all_.where(F.col("shape").isin(*BASE))
    added = discover(docs, seeds, candidates(all_), text, **how)
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int") - 1
    span = F.struct(place.alias("kind"), "start", "end")
    every = (seeds.select("row", span.alias("span"), F.lit(True).alias("base"))
             .unionByName(added.select("row", span.alias("span"), F.lit(False).alias("base"))))
    per = every.groupBy("row").agg(F.collect_list(F.when(F.col("base"), F.col("span"))).alias("base"), F.collect_list("span").alias("spans"))
    none = F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")
    return matches.select("row", "doc_id").join(per, "row", "left").select(
        "doc_id", F.array_sort(F.coalesce("base", none)).alias("base"), F.array_sort(F.coalesce("spans", none)).alias("spans"))


def report(found_: DataFrame) -> DataFrame:
    """Counts of base spans by kind, a digest of the base spans, all spans."""
    counts = [F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found_.select("doc_id", *counts, F.sha2(spelled(F.col("base")), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"))
