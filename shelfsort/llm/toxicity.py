"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled text: one on ordinary words,
one on the same ordinary words plus words of toxic text.  A text is cut into
windows of 16 words; each window is compressed with both, and the difference of
the two lengths is how much better the toxic dictionary explains it.

A toxic document is mostly ordinary words, so a dictionary trained on all of
its text hardly differs from the ordinary one.  Training therefore keeps the
words and beginnings of words that toxic documents use more often than chance
allows (counted once per document and per preceding word, so that copies of a
document count once); beginnings serve compounds that training never saw.

The thresholds are calibrated on labelled rows not used for the dictionaries:
every length difference gets its log odds, a document's sum of log odds goes
through a logistic curve fitted to the labels.

Training uses at most ``fit_rows`` labelled rows of each class for each step,
taken in order of a hash of the id (a documented, bounded sample; the curve's
constant is put right for the classes' true sizes); scoring reads every text
whole.  Only labelled rows with crc32(doc_id) mod 3 <> 1 are used.  The driver
receives two word lists of bounded length and a histogram for each calibration
row.

Defined cases: null and empty texts have no windows and get the curve's value
at zero; rows without a label or with a null label do not train; repeated
labels of an id count as toxic if any is; without both classes to train on,
every score is the share of toxic rows (0 without any); repeated rows are
scored each; an empty table gives no rows.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsort.llm.common import crc_mod, fresh, materialise

WINDOW = 16
FIT_ROWS = 4_000  # of each class and step
STEMS = (4, 5, 6)
MIN_Z = 5.0
ORDINARY_BYTES, TOXIC_BYTES = 32_768, 16_384
LOW, HIGH = -8, 40  # length differences beyond these count as these
THRESHOLD = 0.7
CLIP = 8.0
_PUNCTUATION = bytes.maketrans(b".,;:!?\"()[]{}<>|*#$%&/\\\t\n\v\f\r", b" " * 28)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_PUNCTUATION).split()


def windows_of(words: list[bytes], width: int = WINDOW) -> list[bytes]:
    return [b" " + b" ".join(words[i:i + width]) + b" " for i in range(0, len(words), width)]


def units_of(word: bytes) -> list[bytes]:
    """A word and its beginnings: stems show in fewer documents than whole compounds."""
    return [word, *(word[:n] for n in STEMS if len(word) > n)]


class Lengths:
    """Compressed lengths of windows under one dictionary (raw content, so a
    length counts the bytes that the dictionary does not explain)."""

    def __init__(self, content: bytes):
        params = zstandard.ZstdCompressionParameters.from_level(
            3, min_match=5, strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
        # zstandard wants some content; a byte that words never have explains nothing
        content = content if len(content) >= 8 else b"\x00" * 8 + content
        self.z = zstandard.ZstdCompressor(compression_params=params, dict_data=zstandard.ZstdCompressionDict(
            content, dict_type=zstandard.DICT_TYPE_RAWCONTENT))

    def __call__(self, windows: list[bytes]) -> np.ndarray:
        if not windows:
            return np.zeros(0, np.int64)
        got = self.z.multi_compress_to_buffer(windows, threads=1)
        return np.fromiter((len(got[i]) for i in range(len(got))), np.int64, len(windows))


@dataclass(frozen=True)
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    log_odds: tuple[float, ...]  # by length difference from LOW to HIGH
    curve: tuple[float, float, float]  # constant, sum of log odds, log(1 + windows)
    width: int = WINDOW

    def histograms(self, texts: list[str | None]) -> np.ndarray:
        """Of each text, the number of windows by length difference."""
        parts = [windows_of(words_of(t), self.width) for t in texts]
        flat = [w for p in parts for w in p]
        if not hasattr(self, "_lengths"):
            object.__setattr__(self, "_lengths", (Lengths(self.ordinary), Lengths(self.toxic)))
        base, tox = self._lengths
        step = np.clip(base(flat) - tox(flat), LOW, HIGH) - LOW
        n = HIGH - LOW + 1
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        return np.bincount(owner * n + step, minlength=len(parts) * n).reshape(len(parts), n)

    def features(self, histograms: np.ndarray) -> np.ndarray:
        # Beyond +-CLIP the sum says no more; unbounded, a few odd rows would flatten the curve.
        odds = np.clip(histograms @ np.array(self.log_odds), -CLIP, CLIP)
        return np.stack([np.ones(len(histograms)), odds, np.log1p(histograms.sum(1))], 1)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = self.features(self.histograms(texts)) @ np.array(self.curve)
        return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_lengths"}

    def __setstate__(self, state):
        for k, v in state.items():
            object.__setattr__(self, k, v)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Newton's method on standardised columns (the first is the constant)."""
    mean, sd = x.mean(0), x.std(0)
    mean[0], sd = 0.0, np.where(sd > 0, sd, 1.0)
    sd[0] = 1.0
    z = (x - mean) / sd
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(z @ w, -500, 500)))
        g = z.T @ (p - y) + ridge * len(y) * w * (np.arange(len(w)) > 0)
        h = (z * (p * (1 - p))[:, None]).T @ z + np.eye(len(w)) * ridge * len(y)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    w = w / sd
    w[0] -= (w[1:] * mean[1:]).sum()
    return w


def labelled(labels: DataFrame, label_id: str, label: str) -> DataFrame:
    """doc, toxic: one row per labelled id outside the held-out third."""
    return (labels.select(F.col(label_id).cast("bigint").alias("doc"), (F.col(label) > 0).cast("int").alias("toxic"))
            .where("doc is not null and toxic is not null").where(crc_mod(F.col("doc"), 3) != 1)
            .groupBy("doc").agg(F.max("toxic").alias("toxic")))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label_id: str = "doc_id",
          label: str = "toxic", fit_rows: int = FIT_ROWS, width: int = WINDOW) -> ToxicityModel:
    known = labelled(labels, label_id, label).withColumn("place", F.xxhash64(F.lit("toxicity"), "doc"))
    sizes = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    # Bounded: at most 2 * fit_rows ids of a class, the first in hash order.
    known = known.where("toxic > 0").orderBy("place", "doc").limit(2 * fit_rows).unionByName(
        known.where("toxic <= 0").orderBy("place", "doc").limit(2 * fit_rows))
    known = materialise(known)
    sample = (docs.select(F.col(doc_id).cast("bigint").alias("doc"), F.col(text).cast("string").alias("text"))
              .join(F.broadcast(known), "doc"))
    # a text counts once; labels that differ make it toxic, whichever row is read first
    sample = materialise(sample.groupBy("text").agg(F.max("toxic").alias("toxic"), F.pmod(F.min("place"), F.lit(2)).alias("step")))

    def uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            toxic, word, before, first, total = [], [], [], [], []
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = words_of(t)
                once = set()
                for pair in {(a, u) for a, x in set(zip([b"", *w], w)) for u in units_of(x)}:
                    toxic.append(y)
                    word.append(pair[1])
                    before.append(pair[0])
                    first.append(int(pair[1] not in once))
                    once.add(pair[1])
                toxic.append(y)
                word.append(None)
                before.append(None)
                first.append(len(w))
            yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(word, pa.binary()), pa.array(before, pa.binary()),
                                              pa.array(first, pa.int64())], names=["toxic", "word", "before", "first"])

    used = materialise(sample.where("step = 0").select("toxic", "text")
                       .mapInArrow(uses, "toxic int, word binary, before binary, first bigint")
                       .groupBy("word", "toxic", "before").agg(F.sum("first").alias("first"))
                       .groupBy("word", "toxic").agg(F.count(F.lit(1)).alias("contexts"), F.sum("first").alias("docs"))
                       .groupBy("word").agg(
                           *(F.max(F.when(F.col("toxic") == y, F.least("contexts", "docs"))).alias(f"n{y}") for y in (0, 1)),
                           *(F.max(F.when(F.col("toxic") == y, F.col("docs"))).alias(f"d{y}") for y in (0, 1))))
    tokens = used.where("word is null").select("d0", "d1").first()  # words of ordinary and of toxic rows
    if not tokens or not tokens.d0 or not tokens.d1:
        share = sizes.get(1, 0) / max(1, sum(sizes.values()))
        flat = math.log(share / (1 - share)) if 0 < share < 1 else (500.0 if share else -500.0)
        return ToxicityModel(b"", b"", (0.0,) * (HIGH - LOW + 1), (flat, 0.0, 0.0), width)
    share = tokens.d1 / (tokens.d0 + tokens.d1)
    due = (F.coalesce("n0", F.lit(0)) + F.col("n1")) * F.lit(share)
    z = (F.col("n1") - due) / F.sqrt(due + 0.5)
    # Bounded lists: a word and its space take two bytes at least.
    toxic = [bytes(r.word) for r in used.where("word is not null and n1 >= 3").withColumn("z", z).where(F.col("z") >= MIN_Z)
             .orderBy(F.desc("z"), "word").limit(TOXIC_BYTES // 2).select("word").collect()]
    plain = [bytes(r.word) for r in used.where("word is not null and d0 is not null").orderBy(F.desc("d0"), "word")
             .limit(ORDINARY_BYTES // 2).select("word").collect()]
    known_toxic = set(toxic)
    ordinary = _content([w for w in plain if w not in known_toxic], ORDINARY_BYTES)
    start = ToxicityModel(ordinary, _content(toxic, TOXIC_BYTES) + ordinary, (0.0,) * (HIGH - LOW + 1), (0.0, 0.0, 0.0), width)

    def measure(batches):
        for b in batches:
            h = start.histograms(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(h.tolist(), pa.list_(pa.int64()))], names=["toxic", "h"])

    got = sample.where("step = 1").select("toxic", "text").mapInArrow(measure, "toxic int, h array<bigint>").collect()
    got.sort(key=lambda r: (r.toxic, r.h))          # sums of one order give one model
    y = np.array([int(r.toxic > 0) for r in got], np.float64)
    h = np.array([r.h for r in got], np.float64).reshape(len(y), HIGH - LOW + 1)
    if not len(y) or y.min() == y.max():
        y, h = np.array([0.0, 1.0]), np.zeros((2, HIGH - LOW + 1))
    one, zero = h[y == 1].sum(0) + 0.5, h[y == 0].sum(0) + 0.5
    odds = np.log(one / one.sum()) - np.log(zero / zero.sum())
    found = ToxicityModel(start.ordinary, start.toxic, tuple(odds.tolist()), (0.0, 0.0, 0.0), width)
    curve = logistic(found.features(h), y)
    if sizes.get(0) and sizes.get(1):  # the sample is not drawn in proportion
        curve[0] += math.log(sizes[1] / sizes[0]) - math.log(y.sum() / (len(y) - y.sum()))
    return ToxicityModel(start.ordinary, start.toxic, found.log_odds, tuple(curve.tolist()), width)


def _content(words: list[bytes], size: int) -> bytes:
    """Words separated by spaces, at most ``size`` bytes, the first ones last (nearest)."""
    out, n = [], 1
    for w in words:
        if n + len(w) + 1 > size:
            continue
        out.append(w)
        n += len(w) + 1
    return b" " + b" ".join(reversed(out)) + b" "


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", column: str = "score") -> DataFrame:
    """``docs`` with a column ``score`` (0 to 1)."""
    column = fresh(docs, column)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.concatenate([model.scores(b.column(at).slice(i, 500).to_pylist()) for i in range(0, b.num_rows, 500)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=[*b.schema.names, column])

    from pyspark.sql.types import DoubleType, StructField, StructType
    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(column, DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label_id: str = "doc_id",
             label: str = "toxic", threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of ``docs``."""
    model = train(docs, labels, doc_id, text, label_id, label, fit_rows)
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return score(src, model).select(
        "doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))
