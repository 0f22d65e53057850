"""TF-IDF operators on character 2–4-grams.

Vectors are never materialised as arrays: a vector is a set of rows
``(id, gram, w)`` and a cosine is a join on ``gram`` followed by a sum, so
Catalyst plans every step as ordinary shuffles/aggregates with codegen.

Weights follow the usual sublinear TF-IDF: ``tf = 1 + ln(count)``,
``idf = ln((1 + N) / (1 + df)) + 1``, rows L2-normalised.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grams import steps
from ..functions.text import split_ws
from ..session import bounded_broadcast, cut_lineage, dense_positions, spread

# Margin for the prefix-filter bound so floating-point rounding can never
# drop a pair whose exact score sits on the threshold.
_EPS = 1e-9


def _rank_key(col: str):
    """Cosine used for ranking: identical vectors must tie exactly (then the
    lower index wins), whatever order the partial sums were added in."""
    return F.round(F.col(col), 12)


def doc_grams(docs: DataFrame, id_cols: list, text_col: str) -> DataFrame:
    """Count char_wb grams per document: ``(*id_cols, gram, cnt)``.

    Flat generators instead of nested arrays: words, then gram lengths, then
    start offsets, then one ``substring`` — a very long text never builds one
    giant array, and counting is a partial (map-side) aggregate.
    """
    p = F.concat(F.lit(" "), F.col("_w"), F.lit(" "))
    words = (spread(docs).select(*id_cols, F.explode(split_ws(F.lower(F.col(text_col)))).alias("_w"))
             .select(*id_cols, p.alias("_p")))
    wn = words.select(*id_cols, "_p", F.explode(
        F.sequence(F.lit(2), F.least(F.lit(4), F.length("_p")))).alias("_n"))
    wi = wn.select(*id_cols, "_p", "_n", F.explode(
        F.sequence(F.lit(1), F.length("_p") - F.col("_n") + 1)).alias("_i"))
    grams = wi.select(*id_cols, F.expr("substring(_p, _i, _n)").alias("gram"))
    return grams.groupBy(*id_cols, "gram").agg(F.count(F.lit(1)).alias("cnt"))


def gram_texts(docs: DataFrame, id_cols: list, text_col: str, payload: list | None = None, tasks: int | None = None) -> DataFrame:
    """``(*id_cols, *payload, _words)``: the lower-cased words of each text, rows
    of one id side by side.  From here on grams are counted inside a task: a text
    moves once, its grams never do."""
    words = F.array_join(split_ws(F.lower(F.col(text_col))), " ").alias("_words")
    return (docs.select(*id_cols, *(payload or []), words)
            .repartition(*([tasks] if tasks else []), *id_cols).sortWithinPartitions(*id_cols))


def gram_stats(texts: DataFrame, id_cols: list, by: str | None = None) -> DataFrame:
    """``([by,] gram, tf, df)`` of ``gram_texts``: corpus count and number of ids
    of each gram, per value of the whole-number column ``by`` if given (one that
    belongs to the id).  A task sends a row a gram for some thousand texts."""
    ids = [*id_cols, *([by] if by else [])]
    names = [*([by] if by else []), "gram", "tf", "df"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, g in steps(batches, len(ids)):
            groups = np.array([own[0][-1] for own in rows], np.int64) if by else np.zeros(len(rows), np.int64)
            for group in np.unique(groups):
                here = groups[g.owner] == group
                tf = np.bincount(g.gram[here], g.cnt[here], len(g.names)).astype(np.int64)
                df = np.bincount(g.gram[here], minlength=len(g.names))
                seen = np.flatnonzero(df)
                columns = [pa.array([g.names[i] for i in seen.tolist()], pa.string()), pa.array(tf[seen]), pa.array(df[seen])]
                yield pa.RecordBatch.from_arrays([*([pa.array(np.full(len(seen), group))] if by else []), *columns], names=names)

    part = texts.select(*ids, "_words").mapInArrow(run, (f"`{by}` long, " if by else "") + "gram string, tf long, df long")
    return part.groupBy(*names[:-2]).agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


_DIGIT = 16   # bits of a count that one pass of the rank search settles


def _value_at_rank(rows: DataFrame, col: str, rank: int) -> tuple[int, int, int]:
    """The ``rank``-th largest of the non-negative whole numbers in ``col``, how
    many rows lie above it and how many rows hold it (1 <= rank <= rows).

    A radix search from the leading digit down: each pass counts the rows of one
    prefix by their next 16 bits, so the driver gets at most 65,536 counts a
    pass, whatever the table, and the rows stay where they are.
    """
    largest = rows.agg(F.max(col)).first()[0]
    shift = max(largest.bit_length() - 1, 0) // _DIGIT * _DIGIT
    prefix, above, here = 0, 0, rows
    while True:
        digit = F.shiftright(F.col(col).cast("bigint"), shift).bitwiseAND((1 << _DIGIT) - 1)
        for d, n in sorted(here.groupBy(digit.alias("d")).count().collect(), reverse=True):
            if above + n >= rank:
                break
            above += n
        prefix = prefix << _DIGIT | d
        if shift == 0:
            return prefix, above, n
        low = prefix << shift
        here = rows.where(F.col(col).between(low, low + (1 << shift) - 1))
        shift -= _DIGIT


def vocabulary(counts: DataFrame, max_features: int | None) -> DataFrame:
    """``(gram, tf, df)``; when capped, the ``max_features`` grams with the
    largest corpus count (ties: gram order).

    The count at the cap's rank comes from histograms (``_value_at_rank``);
    grams above it are taken where they lie.  Only grams that tie at the cut are
    sorted, by ranges, so no task merges the candidates of all others.
    """
    return most_frequent(counts.groupBy("gram").agg(F.sum("cnt").alias("tf"), F.count(F.lit(1)).alias("df")), max_features)


def most_frequent(stats: DataFrame, max_features: int | None) -> DataFrame:
    """The cap of ``vocabulary`` on gram statistics that are already there."""
    if not max_features:
        return stats
    stats = cut_lineage(stats)
    if stats.count() <= max_features:
        return stats
    cut, above, ties = _value_at_rank(stats, "tf", max_features)
    open_places = max_features - above
    if ties == open_places:
        return stats.where(F.col("tf") >= cut)
    tied = dense_positions(stats.where(F.col("tf") == cut), ["gram"], "_pos")
    return (stats.where(F.col("tf") > cut)
            .unionByName(tied.where(F.col("_pos") < open_places).drop("_pos")))


@dataclass
class TfidfIndex:
    """A fitted index: vocabulary with idf, and normalised postings.

    ``postings``: ``(doc_id, gram, w, rem2)`` where ``rem2`` is the squared
    norm of the document's grams at or after ``gram`` in the global rare-first
    order ``(df, gram)`` — the prefix-filter bound.
    """
    vocab: DataFrame      # gram, df, idf
    postings: DataFrame   # doc_id, gram, w, rem2
    meta: DataFrame       # doc_id, doc_ord, + payload columns
    n_docs: int


def _normalise(weights: DataFrame, id_cols: list) -> DataFrame:
    w = Window.partitionBy(*id_cols)
    return (weights.withColumn("_n2", F.sum(F.col("w") * F.col("w")).over(w))
            .where(F.col("_n2") > 0)
            .withColumn("w", F.col("w") / F.sqrt("_n2")).drop("_n2"))


def _with_rem2(vec: DataFrame, id_cols: list) -> DataFrame:
    """Suffix squared norm in rare-first order (inclusive of the row)."""
    w = (Window.partitionBy(*id_cols)
         .orderBy(F.desc("df"), F.desc("gram"))
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return vec.withColumn("rem2", F.sum(F.col("w") * F.col("w")).over(w))


def fit_index(docs: DataFrame, text_col: str, max_features: int | None,
              broadcast_max_rows: int = 1_000_000) -> TfidfIndex:
    """Fit TF-IDF on ``docs`` (``doc_id``, ``doc_ord``, text, payload...).

    The index is an artifact: gram counts, vocabulary and postings are each
    materialised once (reliable checkpoint), so every later query reads them
    instead of re-exploding the corpus."""
    docs = cut_lineage(docs)      # ids and texts of one evaluation for all parts
    n_docs = docs.count()
    counts = cut_lineage(doc_grams(docs, ["doc_id"], text_col))
    vocab = vocabulary(counts, max_features)
    vocab = cut_lineage(vocab.select(
        "gram", "df", (F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0).alias("idf")))
    if max_features and max_features <= broadcast_max_rows:
        vocab_j = F.broadcast(vocab)          # bounded by the cap
    else:
        vocab_j = bounded_broadcast(vocab, broadcast_max_rows)
    weights = counts.join(vocab_j, "gram").select(
        "doc_id", "gram", "df", ((1.0 + F.log("cnt")) * F.col("idf")).alias("w"))
    postings = cut_lineage(_with_rem2(_normalise(weights, ["doc_id"]), ["doc_id"]).select(
        "doc_id", "gram", "df", "w", "rem2"))
    meta = docs.withColumnRenamed(text_col, "product_name")
    return TfidfIndex(vocab=vocab, postings=postings, meta=meta, n_docs=n_docs)


def query_vectors(queries: DataFrame, text_col: str, index: TfidfIndex,
                  broadcast_max_rows: int = 1_000_000) -> DataFrame:
    """Transform query texts with the index vocabulary (unseen grams dropped):
    ``(qid, gram, df, w, rem2)``."""
    counts = doc_grams(queries, ["qid"], text_col)
    vocab_j = bounded_broadcast(index.vocab, broadcast_max_rows)
    weights = counts.join(vocab_j, "gram").select(
        "qid", "gram", "df", ((1.0 + F.log("cnt")) * F.col("idf")).alias("w"))
    return _with_rem2(_normalise(weights, ["qid"]), ["qid"])


def _exact_scores(pairs: DataFrame, qvec: DataFrame, postings: DataFrame) -> DataFrame:
    """Exact cosine for candidate ``(qid, doc_id)`` pairs."""
    q = pairs.join(qvec.select("qid", "gram", F.col("w").alias("wq")), "qid")
    d = postings.select("doc_id", "gram", F.col("w").alias("wd"))
    return (q.join(d, ["doc_id", "gram"])
            .groupBy("qid", "doc_id").agg(F.sum(F.col("wq") * F.col("wd")).alias("score")))


def vector_match(queries: DataFrame, text_col: str, index: TfidfIndex, threshold: float,
                 broadcast_max_rows: int = 1_000_000) -> DataFrame:
    """Best index row per query with cosine ≥ ``threshold`` (ties: lower
    ``doc_ord``).  Returns ``(qid, doc_id, score)`` for hits only.

    Exact prefix filtering: with grams in one global rare-first order, a pair
    with cosine ≥ t shares a gram that lies in both prefixes, where a prefix
    keeps the grams whose inclusive suffix norm is ≥ t.  Only prefix grams
    are joined — mostly rare ones, so hot grams rarely enter the join.
    """
    qvec = cut_lineage(query_vectors(queries, text_col, index, broadcast_max_rows))
    t2 = (threshold - _EPS) ** 2
    qp = qvec.where(F.col("rem2") >= t2).select("qid", "gram")
    dp = index.postings.where(F.col("rem2") >= t2).select("doc_id", "gram")
    pairs = qp.join(dp, "gram").select("qid", "doc_id").distinct()
    scored = _exact_scores(pairs, qvec, index.postings).where(F.col("score") >= threshold)
    scored = scored.join(index.meta.select("doc_id", "doc_ord"), "doc_id")
    best = scored.groupBy("qid").agg(
        F.min_by(F.struct("doc_id", "score"), F.struct(-_rank_key("score"), F.col("doc_ord"))).alias("b"))
    return best.select("qid", "b.doc_id", "b.score")


def impact_lists(postings: DataFrame, size: int, salts: int = 8) -> DataFrame:
    """About the ``size`` heaviest postings of every gram: the heaviest
    ``size / salts`` of each of ``salts`` parts, so the long list of a frequent
    gram is cut by several tasks."""
    each = -(-size // salts)
    w = Window.partitionBy("gram", "_salt").orderBy(F.desc("w"), "doc_id")
    salted = postings.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    return salted.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= each).select("gram", "doc_id", "w")


def topk_floor(qvec: DataFrame, postings: DataFrame, k: int, probe: int) -> DataFrame:
    """``(qid, floor)``: the k-th best exact cosine among a query's likeliest
    rows, hence a lower bound of its k-th best of all; 0 with fewer than k.

    Likely rows come from the heaviest postings of the query's rarest grams."""
    before = Window.partitionBy("qid").orderBy("df", "gram").rowsBetween(Window.unboundedPreceding, -1)
    rare = qvec.withColumn("_b", F.coalesce(F.sum("df").over(before), F.lit(0))).where(F.col("_b") < probe * k)
    part = (rare.select("qid", "gram", F.col("w").alias("wq")).join(impact_lists(postings, probe * k).withColumnRenamed("w", "wd"), "gram")
            .groupBy("qid", "doc_id").agg(F.sum(F.col("wq") * F.col("wd")).alias("s")))
    likely = Window.partitionBy("qid").orderBy(F.desc("s"), "doc_id")
    top = part.withColumn("_r", F.row_number().over(likely)).where(F.col("_r") <= 4 * k).select("qid", "doc_id")
    best = _exact_scores(top, qvec, postings).groupBy("qid").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s"))
    return (qvec.select("qid").distinct().join(best, "qid", "left")
            .select("qid", F.coalesce(F.get("s", F.lit(k - 1)), F.lit(0.0)).alias("floor")))


def topk_pairs(qvec: DataFrame, postings: DataFrame, floor: DataFrame) -> DataFrame:
    """Pairs (qid, doc_id) that may reach their query's floor, and all that do.

    With grams in the global rare-first order, a pair with cosine >= f shares a
    gram where both suffix norms are >= f; only those meet.  The part of the
    cosine behind the last such gram is at most the product of the suffix norms
    there: pairs whose sum so far plus that bound is under f are dropped before
    they are scored."""
    low = F.greatest(F.col("floor") - _EPS, F.lit(0.0))
    q = (qvec.join(floor, "qid").where(F.col("rem2") >= low * low)
         .select("qid", "gram", "df", "floor", F.col("w").alias("wq"), F.greatest(F.col("rem2") - F.col("w") * F.col("w"), F.lit(0.0)).alias("rq")))
    d = postings.select("doc_id", "gram", F.col("w").alias("wd"), F.col("rem2").alias("rd"))
    met = q.join(d, "gram").where(F.col("rd") >= low * low)
    behind = F.sqrt(F.col("rq") * F.greatest(F.col("rd") - F.col("wd") * F.col("wd"), F.lit(0.0)))
    sums = met.groupBy("qid", "doc_id").agg(F.sum(F.col("wq") * F.col("wd")).alias("s"), F.max("floor").alias("floor"),
                                            F.max_by(behind, F.struct("df", "gram")).alias("rest"))
    return sums.where(F.col("s") + F.col("rest") >= low).select("qid", "doc_id")


def vector_topk(queries: DataFrame, text_col: str, index: TfidfIndex, k: int, broadcast_max_rows: int = 1_000_000,
                probe: int = 64, far: float = 0.35, stats: dict | None = None) -> DataFrame:
    """The ``k`` best index rows per query by (score desc, doc_ord asc),
    no threshold; only rows sharing a gram (score > 0) are returned.

    Exact: a first look at the rarest grams gives each query a floor under its
    k-th best cosine, then only pairs that can reach the floor are joined and
    scored.  A query whose floor is under ``far`` is like nothing in the index;
    hardly a pair falls under such a floor, so its pairs are summed at once.
    ``stats``, when given, receives the number of pairs scored and of queries
    that are far."""
    qvec = cut_lineage(query_vectors(queries, text_col, index, broadcast_max_rows))
    floor = cut_lineage(topk_floor(qvec, index.postings, k, probe))
    pairs = cut_lineage(topk_pairs(qvec, index.postings, floor.where(F.col("floor") >= far)))
    away = qvec.join(floor.where(F.col("floor") < far).select("qid"), "qid", "left_semi").select("qid", "gram", F.col("w").alias("wq"))
    if stats is not None:
        stats["pairs"], stats["far"] = pairs.count(), floor.where(F.col("floor") < far).count()
    direct = (away.join(index.postings.select("doc_id", "gram", F.col("w").alias("wd")), "gram")
              .groupBy("qid", "doc_id").agg(F.sum(F.col("wq") * F.col("wd")).alias("score")))
    scores = _exact_scores(pairs, qvec, index.postings).unionByName(direct).join(index.meta.select("doc_id", "doc_ord"), "doc_id")
    w = Window.partitionBy("qid").orderBy(F.desc(_rank_key("score")), "doc_ord")
    return (scores.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
            .select("qid", "doc_id", "score", "rank"))


def in_corpus_best(queries: DataFrame, corpus: DataFrame, min_docs: int = 1) -> DataFrame:
    """Per query, the corpus row of its group with the highest cosine
    when TF-IDF is fitted on the group's corpus *plus the query itself*.

    ``queries``: ``(qid, grp, text)``; ``corpus``: ``(grp, doc_id, doc_ord,
    text)``.  Returns ``(qid, doc_id, score)``; groups with fewer than
    ``min_docs`` rows give no row.  Refitting per query is replaced by the
    exact closed form (N corpus rows, df over the corpus):
    ``idf1 = ln((N+2)/(df+2))+1`` for grams in the query, ``idf0 =
    ln((N+2)/(df+1))+1`` otherwise; ``|c|² = Σ tf_c²·idf0² + Σ_shared
    tf_c²·(idf1²−idf0²)``.  Queries sharing no gram get the group's first row
    with score 0 (argmax over all-zero scores).
    """
    n = corpus.groupBy("grp").agg(F.count(F.lit(1)).alias("N"),
                                  F.min_by("doc_id", "doc_ord").alias("first_doc"))
    if min_docs > 1:
        n = n.where(F.col("N") >= min_docs)
    cc = doc_grams(corpus, ["grp", "doc_id"], "text").withColumn("tf", 1.0 + F.log("cnt"))
    dfs = cc.groupBy("grp", "gram").agg(F.count(F.lit(1)).alias("df"))
    idf0 = F.log((F.col("N") + 2.0) / (F.col("df") + 1.0)) + 1.0
    idf1 = F.log((F.col("N") + 2.0) / (F.coalesce(F.col("df"), F.lit(0)) + 2.0)) + 1.0
    cw = (cc.join(dfs, ["grp", "gram"]).join(n, "grp")
          .withColumn("i0", idf0).withColumn("i1", idf1))
    base = cw.groupBy("grp", "doc_id").agg(F.sum((F.col("tf") * F.col("i0")) ** 2).alias("base"))

    qc = doc_grams(queries, ["qid", "grp"], "text").withColumn("tfq", 1.0 + F.log("cnt"))
    qw = (qc.join(n, "grp").join(dfs, ["grp", "gram"], "left").withColumn("i1", idf1))
    qn = qw.groupBy("qid").agg(F.sqrt(F.sum((F.col("tfq") * F.col("i1")) ** 2)).alias("qn"))
    shared = (qw.select("qid", "grp", "gram", "tfq", "i1")
              .join(cw.select("grp", "doc_id", "gram", "tf", "i0"), ["grp", "gram"]))
    agg = shared.groupBy("qid", "doc_id").agg(
        F.sum(F.col("tfq") * F.col("tf") * F.col("i1") ** 2).alias("dot"),
        F.sum(F.col("tf") ** 2 * (F.col("i1") ** 2 - F.col("i0") ** 2)).alias("adj"))
    scored = (agg.join(base.select("doc_id", "base"), "doc_id").join(qn, "qid")
              .withColumn("score", F.col("dot") / (F.col("qn") * F.sqrt(F.col("base") + F.col("adj")))))
    ords = corpus.select("doc_id", "doc_ord")
    best = (scored.join(ords, "doc_id").groupBy("qid").agg(
        F.min_by(F.struct("doc_id", "score"), F.struct(-_rank_key("score"), F.col("doc_ord"))).alias("b"))
        .select("qid", "b.doc_id", "b.score"))
    q = queries.select("qid", "grp").join(n, "grp")
    return (q.join(best, "qid", "left")
            .select("qid", F.coalesce("doc_id", "first_doc").alias("doc_id"),
                    F.coalesce("score", F.lit(0.0)).alias("score")))
