"""Category classifier (M1–M8).

Features are the same sublinear char_wb TF-IDF as the index, capped at
``model_max_features`` grams, L2-normalised.  Two classifiers (M3):

* ``linear``: multinomial logistic regression of Spark ML, with the L2 penalty
  of ``C`` mapped to ``regParam = 1 / (C · n)`` and no standardisation;
* ``boosted``: gradient-boosted trees (``boosting.py``).
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.util import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.grams import Grams, steps
from ..session import cut_lineage, dense_positions
from . import boosting
from .boosting import BoostParams
from .tfidf import gram_stats, gram_texts, most_frequent

# A multinomial model holds one weight vector per class on every executor.
MAX_CLASSES = 10_000


@dataclass
class CategoryModel:
    vocab: DataFrame            # gram, idx, idf
    n_features: int
    classes: list               # sorted class labels (scalar list, one per class)
    lr: LogisticRegressionModel | None
    forest: list | None = None              # rounds of trees, one tree a class (kind "boosted")
    edges: DataFrame | None = None          # idx, lo, span: bins of the features
    boost: BoostParams = BoostParams()

    @property
    def kind(self) -> str:
        return "linear" if self.forest is None else "boosted"


def _fit_vocab(stats: DataFrame, n_docs: int, max_features: int) -> tuple[DataFrame, int]:
    vocab = most_frequent(stats, max_features)
    vocab = vocab.select(
        "gram", (F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    vocab = dense_positions(vocab, ["gram"], "idx")
    n_features = vocab.count()
    return vocab, n_features


def _texts(df: DataFrame, *payload: str) -> DataFrame:
    """``(rid, *payload, _words)``, rows of one rid side by side."""
    return gram_texts(df, ["rid"], "text", list(payload))


WAVE_BYTES = 64 << 20     # most text a task of an iteration gets
PASS_BYTES = 256 << 10    # least text worth a task of its own in a pass of the linear optimiser


FITS_BYTES = 512 << 20    # most memory of the driver for the optimisers of fits side by side
CORRECTIONS = 10          # pairs of earlier steps and gradients that an optimiser keeps


def _cores(df: DataFrame) -> int:
    return max(1, df.sparkSession.sparkContext.defaultParallelism)


def _waves(train: DataFrame) -> int:
    """Full waves of the cluster that a pass over the texts takes."""
    size = train.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return max(1, -(-size // (_cores(train) * WAVE_BYTES)))


def _even(train: DataFrame, *payload: str) -> tuple[DataFrame, int]:
    """``_texts`` of a training table, written once and dealt out in full waves of
    the cluster (every iteration is a job over these partitions, so a task more
    than there are cores would double its time), and the number of waves."""
    train = cut_lineage(train.select("rid", "text", *payload))
    waves = _waves(train)
    return cut_lineage(gram_texts(train, ["rid"], "text", list(payload), _cores(train) * waves)), waves


def _at_once(fits: int, waves: int, classes: int, max_features: int, kind: str) -> int:
    """How many of ``fits`` are trained side by side.  Small ones leave most of the
    cluster waiting between iterations; of large ones only one is held in blocks, and
    the linear optimiser's vectors (features * classes) must fit the driver."""
    if waves > 1:
        return 1
    one = classes * max_features * 8 * (2 * CORRECTIONS + 2) if kind == "linear" else 1
    return max(1, min(fits, FITS_BYTES // max(1, one)))


def _weights(vocab: DataFrame):
    """A function from a step's rows and grams to ``(owner, idx, w)``: sublinear,
    L2-normalised TF-IDF weights of known grams, by owner and idx.  The vocabulary
    (bounded by its cap) goes to the tasks."""
    known = {r["gram"]: (r["idx"], r["idf"]) for r in vocab.collect()}
    none = (-1, 0.0)

    def weigh(rows: list, g: Grams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = [known.get(name, none) for name in g.names]
        idx, idf = np.array([x for x, _ in found], np.int64), np.array([x for _, x in found], np.float64)
        if not len(idx):
            return np.empty(0, np.int64), idx.astype(np.int64), idf
        # a row without an id belongs to no text
        named = np.array([own[0][0] is not None for own in rows])
        keep = (idx[g.gram] >= 0) & named[g.owner]
        owner, at = g.owner[keep], idx[g.gram[keep]]
        w = (1.0 + np.log(g.cnt[keep])) * idf[g.gram[keep]]
        # counted grams lie by owner and gram, and idx follows the grams' order, so rows are mostly in place
        if np.any((owner[1:] < owner[:-1]) | ((owner[1:] == owner[:-1]) & (at[1:] < at[:-1]))):
            order = np.lexsort((at, owner))
            owner, at, w = owner[order], at[order], w[order]
        return owner, at, w / np.sqrt(np.bincount(owner, w * w, len(rows)))[owner]
    return weigh


def _by_row(texts: DataFrame, pack, column: T.DataType) -> DataFrame:
    """The rows of ``texts`` without their words, with a column that ``pack`` makes
    for each rid of a step: one Arrow value for every entry of ``rows``."""
    fields = [f for f in texts.schema.fields if f.name != "_words"]
    schema = T.StructType([*fields, T.StructField("features", column)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        types = [first.schema.field(f.name).type for f in fields]
        for rows, g in steps(chain([first], batches), 1):
            packed = pack(rows, g)
            flat = list(zip(*[row for own in rows for row in own]))
            each = np.repeat(np.arange(len(rows)), [len(own) for own in rows])
            for at in range(0, len(each), 1000):
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(c[at:at + 1000], t) for c, t in zip(flat, types)], packed.take(pa.array(each[at:at + 1000]))],
                    names=schema.names)
    return texts.select(*[f.name for f in fields], "_words").mapInArrow(run, schema)


def _lists(owner: np.ndarray, n: int, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), values)


def _vectors(texts: DataFrame, vocab: DataFrame, n_features: int) -> DataFrame:
    """``texts`` (``_texts``) with ``features``: sparse L2-normalised TF-IDF
    vectors; texts without known grams get an all-zero vector.

    A sparse vector is stored as (type, size, indices, values)."""
    weigh = _weights(vocab)

    def pack(rows: list, g: Grams) -> pa.Array:
        owner, idx, w = weigh(rows, g)
        n = len(rows)
        return pa.StructArray.from_arrays(
            [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, n_features, np.int32)),
             _lists(owner, n, pa.array(idx.astype(np.int32))), _lists(owner, n, pa.array(w))],
            names=["type", "size", "indices", "values"])
    return _by_row(texts, pack, VectorUDT())


def _edges(texts: DataFrame, vocab: DataFrame) -> DataFrame:
    """Bins of the features (``boosting.bin_edges``) of the weights of ``texts``;
    a task sends a row a feature for some thousand texts."""
    weigh = _weights(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, g in steps(batches, 1):
            _, idx, w = weigh(rows, g)
            order = np.lexsort((w, idx))
            idx, w = idx[order], w[order]
            seen, first = np.unique(idx, return_index=True)
            last = np.append(first[1:], len(idx))[:len(seen)] - 1
            for at in (first, last):
                yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(w[at])], names=["idx", "w"])
    return boosting.bin_edges(texts.select("rid", "_words").mapInArrow(run, "idx long, w double"))


def _bins(texts: DataFrame, vocab: DataFrame, edges: DataFrame, bins: int) -> DataFrame:
    """``texts`` with ``kv``, the binned features (even steps of the logarithm); features
    without edges are unknown to the model and left out."""
    weigh = _weights(vocab)
    span = {r["idx"]: (r["lo"], r["span"]) for r in edges.collect()}       # at most a row a feature
    size = max(span, default=-1) + 1
    lo, width = np.zeros(size), np.full(size, -1.0)
    for i, (a, b) in span.items():
        lo[i], width[i] = a, b

    def pack(rows: list, g: Grams) -> pa.Array:
        owner, idx, w = weigh(rows, g)
        inside = idx < size
        owner, idx, w = owner[inside], idx[inside], w[inside]
        there = width[idx] >= 0
        owner, idx, w = owner[there], idx[there], w[there]
        wide = width[idx] > 0
        step = np.zeros(len(idx))
        step[wide] = np.floor((np.log(w[wide]) - lo[idx[wide]]) / width[idx[wide]] * bins)
        cell = np.clip(step, 0, bins - 1).astype(np.int32)
        return _lists(owner, len(rows), pa.StructArray.from_arrays([pa.array(idx.astype(np.int32)), pa.array(cell)], names=["idx", "bin"]))
    kv = T.ArrayType(T.StructType([T.StructField("idx", T.IntegerType()), T.StructField("bin", T.IntegerType())]))
    return _by_row(texts, pack, kv).withColumnRenamed("features", "kv")


def class_counts(train: DataFrame) -> DataFrame:
    """Rows per label."""
    return train.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def fit(train: DataFrame, c: float = 5.0, max_iter: int = 1000,
        max_features: int = 10_000, kind: str = "linear", boost: BoostParams = BoostParams()) -> CategoryModel | None:
    """M1–M3: ``train`` has ``(rid, text, label)``; returns None for < 2 classes."""
    texts, _ = _even(train, "label")
    return _fit_texts(texts, gram_stats(texts, ["rid"]), c, max_iter, max_features, kind, boost)


def _fit_texts(texts: DataFrame, stats: DataFrame, c: float, max_iter: int,
               max_features: int, kind: str = "linear", boost: BoostParams = BoostParams()) -> CategoryModel | None:
    """``fit`` on prepared texts (rid, label, _words) and their gram statistics."""
    if kind not in ("linear", "boosted"):
        raise ValueError(f"unknown classifier {kind!r}")
    spark = texts.sparkSession
    per_class = (texts.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("_words")), F.lit(0)).alias("size"))
                 .orderBy("label").limit(MAX_CLASSES + 1).collect())
    if len(per_class) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes: one model cannot hold a weight vector for each")
    classes = [r["label"] for r in per_class]
    if len(classes) < 2:
        return None
    n = sum(r["n"] for r in per_class)
    vocab, n_features = _fit_vocab(stats, n, max_features)
    idx = spark.createDataFrame(list(enumerate(classes)), "y int, label string")
    if kind == "boosted":
        edges = cut_lineage(_edges(texts, vocab))
        data = _bins(texts, vocab, edges, boost.bins).join(F.broadcast(idx), "label").select("rid", "y", "kv")
        forest = boosting.train(data, len(classes), boost)
        return CategoryModel(vocab=vocab, n_features=n_features, classes=classes, lr=None, forest=forest, edges=edges, boost=boost)
    # the optimiser reads the rows twice and keeps blocks of its own; in each of its
    # passes (hundreds) a task sends sums of features * classes numbers, however few
    # texts it has: a small table is put into as many tasks as its size is worth
    parts = texts.rdd.getNumPartitions()
    together = max(1, parts * PASS_BYTES // max(1, sum(r["size"] for r in per_class)))
    few = texts.coalesce(-(-parts // together))
    data = _vectors(few, vocab, n_features).join(F.broadcast(idx), "label").select("rid", "y", "features")
    lr = LogisticRegression(featuresCol="features", labelCol="y", family="multinomial",
                            maxIter=max_iter, regParam=1.0 / (c * n), elasticNetParam=0.0,
                            standardization=False, tol=1e-6)
    return CategoryModel(vocab=vocab, n_features=n_features, classes=classes, lr=lr.fit(data))


def predict(model: CategoryModel, df: DataFrame) -> DataFrame:
    """M4 + M7: ``(rid, ml_category, ml_confidence)`` — best class, first on ties."""
    return _score(model, _texts(df))


def _score(model: CategoryModel, texts: DataFrame) -> DataFrame:
    """Best class of prepared texts (rid, _words)."""
    if model.kind == "boosted":
        kv = _bins(texts, model.vocab, model.edges, model.boost.bins)
        scored = boosting.margins(model.forest, kv, len(model.classes))
    else:
        feats = _vectors(texts, model.vocab, model.n_features)
        scored = model.lr.transform(feats).select("rid", vector_to_array("probability").alias("p"))
    best = F.array_position("p", F.array_max("p"))
    names = F.array(*[F.lit(x) for x in model.classes])
    return scored.select("rid", F.element_at(names, best.cast("int")).alias("ml_category"),
                         F.array_max("p").alias("ml_confidence"))


def stratified_folds(train: DataFrame, k: int) -> DataFrame:
    """Fold ids equal to an unshuffled stratified k-fold: rows ordered by class
    (classes in first-appearance order, rows in input order ``ord``); position
    p mod k sets per-class fold sizes; each class fills folds with contiguous
    blocks.  Positions come from a distributed sort, never one task."""
    cls = (train.groupBy("label").agg(F.min("ord").alias("first"), F.count(F.lit(1)).alias("n")))
    cls = dense_positions(cls, ["first"], "crank")
    # class start = rows of earlier classes (one row per class)
    from pyspark.sql import Window
    prev = Window.orderBy("crank").rowsBetween(Window.unboundedPreceding, -1)
    st = cls.select("label", "crank", "n",
                    F.coalesce(F.sum("n").over(prev), F.lit(0)).alias("s"))
    pos = dense_positions(train.join(st, "label"), ["crank", "ord"], "p")
    r = F.col("p") - F.col("s")

    def cnt(x, f):
        return F.greatest(F.floor((x - f + k - 1) / k), F.lit(0))

    cum = F.lit(0)
    fold = F.lit(0)
    for f in range(k):
        cum = cum + (cnt(F.col("s") + F.col("n"), f) - cnt(F.col("s"), f))
        fold = fold + F.when(cum <= r, 1).otherwise(0)
    return pos.withColumn("fold", fold.cast("int")).drop("s", "n", "crank", "p")


def cross_validate(train: DataFrame, c: float = 5.0, max_iter: int = 1000, max_features: int = 10_000,
                   kind: str = "linear", boost: BoostParams = BoostParams()) -> float | None:
    """M6 + A9: mean accuracy over min(5, smallest class) folds, or None."""
    counts = class_counts(train).agg(F.min("n").alias("m"), F.count(F.lit(1)).alias("k")).first()
    if counts["k"] is None or counts["k"] < 2:
        return None
    k = min(5, int(counts["m"]))
    if k < 2:
        return None
    texts, waves = _even(stratified_folds(train, k), "fold", "label")
    stats = cut_lineage(gram_stats(texts, ["rid"], "fold"))   # one pass for all folds

    def accuracy(f: int) -> float:
        others = stats.where(F.col("fold") != f).groupBy("gram").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
        m = _fit_texts(texts.where(F.col("fold") != f).drop("fold"), others, c, max_iter, max_features, kind, boost)
        if m is None:
            return 0.0
        test = texts.where(F.col("fold") == f)
        pred = _score(m, test.select("rid", "_words")).join(test.select("rid", "label"), "rid")
        return pred.agg(F.avg((F.col("ml_category") == F.col("label")).cast("double"))).first()[0]

    with ThreadPool(_at_once(k, waves, counts["k"], max_features, kind)) as pool:
        accs = pool.map(inheritable_thread_target(train.sparkSession)(accuracy), range(k))
    return float(sum(accs) / len(accs))


METRICS_SCHEMA = "status string, samples long, classes array<string>, cv_accuracy double, reason string"


def train_metrics(spark, train: DataFrame, c: float = 5.0, max_iter: int = 1000, max_features: int = 10_000,
                  with_cv: bool = True, kind: str = "linear", boost: BoostParams = BoostParams()):
    """M8: fit and return ``(model, metrics DataFrame)``.  The model is trained
    beside the folds if it and five of them may be trained side by side."""
    train = cut_lineage(train)      # read by the fit, the folds and the count
    how = (c, max_iter, max_features, kind, boost)
    beside = with_cv and _at_once(6, _waves(train), class_counts(train).count(), max_features, kind) == 6
    with ThreadPool(1) as pool:
        made = pool.apply_async(inheritable_thread_target(spark)(fit), (train, *how))
        if not beside:
            made.wait()
        cv = cross_validate(train, *how) if beside else None
        model = made.get()
    if model is None:
        return None, spark.createDataFrame([("skipped", None, None, None, "insufficient_classes")], METRICS_SCHEMA)
    if with_cv and not beside:
        cv = cross_validate(train, *how)
    return model, spark.createDataFrame([("trained", train.count(), model.classes, cv, None)], METRICS_SCHEMA)
