"""Language-model scoring by deleted interpolation.

P(w | g,h) = a(b) c(g,h,w)/c(g,h) + d(b) c(h,w)/c(h) + e(b) c(w)/N + f(b) / (V+1),
where b is the bucket (power of two) of the context's frequency c(g,h).  The
weights of each bucket are learned by expectation-maximisation on held-out counts:
a tenth of the training documents is left out of the counts while the weights are
learned, then counted too.  ``order`` sets the longest n-gram: 2 ends at c(h,w)/c(h).

How the corpus is counted.  A task turns its documents into blocks of about half a
million tokens: word hashes (64 bits) with per-block dictionaries, frequent words
first, stored in the shared folder.  A block asks for the counts of its distinct n-grams: sorted
keys, dealt by hash range, with their counts inside the block (the map-side
combine).  The task of a range adds the counts up and answers every block in
the order of its question.  So frequent n-grams cost one entry for each block,
no n-gram table ever meets one task or the driver, and texts are read once.
Words are told apart by 64 bits, so the counts of the base score are exact.  Longer
n-grams are told apart by 20 bits more than the corpus' token count has: at any
size, an n-gram shares its counts with another one by a chance of at most one in a million (2^-20).

The driver gets N, V and the held-out histogram.  That has at most
buckets x 122^order cells, of which some hundred thousand occur: log probabilities
are rounded to a grid of 0.1, only for learning weights.  Its size has a bound
that does not depend on the corpus.

Defined cases: null and empty texts have one token, the end; ties do not
matter; without training documents every count is 0 and weights are equal;
repeated rows count each time and are scored each time; null doc_ids hash as
'null'; an empty table gives no rows.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsort.llm.common import crc_mod, partitions, store
from shelfsort.llm.hashing import U64, combine, mix64, words

END, START = (U64(x) for x in mix64([0xE0D, 0x57A97]))
BLOCK_TOKENS = 500_000
RANGE_TOKENS = 1_000_000
SPARE_BITS = 20
BUCKETS = 64
GRID, FLOOR = 0.1, -12.0
CELLS = 2 + round(-FLOOR / GRID)  # of a probability: none, then FLOOR to 0 by GRID


def pack(a: np.ndarray) -> bytes:
    """Integers by byte planes (sorted keys and small counts leave most planes flat), zstd."""
    a = np.ascontiguousarray(a)
    planes = a.astype(a.dtype.newbyteorder(">")).view(np.uint8).reshape(len(a), a.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(b: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(raw.T).view(np.dtype(dtype).newbyteorder(">")).ravel().astype(dtype)


def pack_keys(a: np.ndarray) -> bytes:
    """Sorted 64-bit keys by their steps (runs of sorted keys pack nearly as well)."""
    return pack(np.diff(a, prepend=U64(0)))


def unpack_keys(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b, np.uint64), dtype=np.uint64)


BLOCK = "held int, docs binary, sizes binary, vocab binary, tokens binary, n bigint"


def blocks(docs: DataFrame, doc_id: str, text: str, folds: int, block_tokens: int) -> DataFrame:
    """Tokens of the documents in blocks: held 1 (not for training), 2 (counted
    after the weights are learned) or 0."""
    src = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"),
                      crc_mod(F.col(doc_id), folds).alias("fold"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list] = {0: [], 1: [], 2: []}
        total = {0: 0, 1: 0, 2: 0}

        def out(held: int) -> pa.RecordBatch:
            ids, null, sizes, toks = (np.concatenate(x) for x in zip(*kept[held]))
            vocab, index, n = np.unique(toks, return_inverse=True, return_counts=True)
            first = np.argsort(-np.log2(n).astype(np.int64), kind="stable")  # frequent words get small numbers
            rank = np.empty(len(vocab), np.uint32)
            rank[first] = np.arange(len(vocab), dtype=np.uint32)
            kept[held], total[held] = [], 0
            return pa.RecordBatch.from_arrays(
                [pa.array([held], pa.int32())] + [pa.array([x], pa.binary()) for x in (
                    pack(np.stack([ids, null], 1).ravel()), pack(sizes), pack_keys(vocab[first]), pack(rank[index]))]
                + [pa.array([len(toks)], pa.int64())], names=["held", "docs", "sizes", "vocab", "tokens", "n"])

        for big in batches:
            for at in range(0, big.num_rows, 500):
                b = big.slice(at, 500)
                w, count = words(b.column(1))
                toks = np.insert(w, np.cumsum(count), END)
                owner = np.repeat(np.arange(len(count)), count + 1)
                fold = b.column(2).to_numpy()
                ids = b.column(0)
                null = np.array(ids.is_null()).astype(np.int64)
                ids = ids.fill_null(0).to_numpy()
                held = np.where(fold == 0, 1, np.where(fold == 1, 2, 0))
                for h in (0, 1, 2):
                    pick = held == h
                    if pick.any():
                        kept[h].append((ids[pick], null[pick], (count[pick] + 1).astype(np.uint32), toks[pick[owner]]))
                        total[h] += int((count[pick] + 1).sum())
                        if total[h] >= block_tokens:
                            yield out(h)
        for h in (0, 1, 2):
            if kept[h]:
                yield out(h)

    return src.mapInArrow(run, BLOCK).withColumn("block", F.monotonically_increasing_id())


class Block:
    """A block's n-grams: ``keys[k]`` sorted distinct (k+1)-grams, ``at[k]`` the place of each token's."""

    def __init__(self, sizes: bytes, vocab: bytes, tokens: bytes, order: int, bits: int):
        self.sizes = unpack(sizes, np.uint32).astype(np.int64)
        v, i = unpack_keys(vocab), unpack(tokens, np.uint32)
        toks = v[i]
        first = np.zeros(len(toks), bool)
        first[np.concatenate([[0], np.cumsum(self.sizes)[:-1]])] = True
        self.first = first
        place = np.empty(len(v), np.int64)
        by_key = np.argsort(v)
        place[by_key] = np.arange(len(v))
        self.keys, self.at = [v[by_key]], [place[i]]
        before = [toks]
        for k in range(1, order):
            prev = np.empty_like(toks)
            prev[1:] = before[-1][:-1]
            prev[0] = START
            prev[first] = START
            before.append(prev)  # the token k places back
            keys, at = np.unique(combine(before[::-1]) >> U64(64 - bits), return_inverse=True)
            self.keys.append(keys)
            self.at.append(at)

    def counts(self, k: int) -> np.ndarray:
        return np.bincount(self.at[k], minlength=len(self.keys[k]))


def key_bits(n_tokens: int) -> int:
    """Width of the keys of n-grams of two and more words."""
    return min(64, n_tokens.bit_length() + SPARE_BITS)


def ask(stored: DataFrame, order: int, ranges: int, bits: int) -> DataFrame:
    """part, block, level, held, keys, counts: each block's distinct n-grams by hash range."""
    def edges(width: int) -> np.ndarray:
        step = (1 << width) // ranges + 1
        return np.array([step * i for i in range(1, ranges)], dtype=np.uint64)

    words_at, longer_at = edges(64), edges(bits)

    def run(batches):
        for b in batches:
            for block, held, sizes, vocab, tokens in zip(*(b.column(i).to_pylist() for i in range(5))):
                x = Block(sizes, vocab, tokens, order, bits)
                for level in range(order):
                    keys = x.keys[level]
                    n = x.counts(level).astype(np.uint32)
                    edge = [0, *np.searchsorted(keys, longer_at if level else words_at).tolist(), len(keys)]
                    got = [(r, s, e) for r, (s, e) in enumerate(zip(edge[:-1], edge[1:])) if e > s]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r for r, _, _ in got], pa.int32()), pa.array([block] * len(got), pa.int64()),
                         pa.array([level] * len(got), pa.int32()), pa.array([held] * len(got), pa.int32()),
                         pa.array([pack_keys(keys[s:e]) for _, s, e in got], pa.binary()),
                         pa.array([pack(n[s:e]) for _, s, e in got], pa.binary())],
                        names=["part", "block", "level", "held", "keys", "counts"])

    return stored.select("block", "held", "sizes", "vocab", "tokens").mapInArrow(
        run, "part int, block bigint, level int, held int, keys binary, counts binary")


ANSWER = "block bigint, level int, part int, core binary, late binary, distinct bigint"


def answer(questions: DataFrame) -> DataFrame:
    """Sums over all blocks: ``core`` of held 0, ``late`` of held 2, in the order of each question."""

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for level, f in frame.groupby("level", sort=True):
            keys = [unpack_keys(x) for x in f["keys"]]
            size = np.array([len(x) for x in keys])
            every, at = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.concatenate([unpack(x, np.uint32) for x in f["counts"]]).astype(np.float64)
            held = np.repeat(f["held"].to_numpy(), size)
            core = np.bincount(at, weights=n * (held == 0), minlength=len(every)).astype(np.uint64)
            late = np.bincount(at, weights=n * (held == 2), minlength=len(every)).astype(np.uint64)
            seen = int(((core + late) > 0).sum()) if level == 0 else 0
            edge = np.concatenate([[0], np.cumsum(size)])
            for i, block in enumerate(f["block"].tolist()):
                a = at[edge[i]:edge[i + 1]]
                out.append((block, int(level), int(frame["part"].iloc[0]), pack(core[a]), pack(late[a]), seen if i == 0 else 0))
        return pd.DataFrame(out, columns=["block", "level", "part", "core", "late", "distinct"])

    return questions.groupBy("part").applyInPandas(run, ANSWER)


def _looked_up(left: pd.DataFrame, right: pd.DataFrame, order: int, bits: int):
    """The block and, by level, (core, late) counts at each token."""
    r = left.iloc[0]
    x = Block(r["sizes"], r["vocab"], r["tokens"], order, bits)
    got = []
    for level in range(order):
        f = right[right["level"] == level].sort_values("part")
        core, late = (np.concatenate([unpack(y, np.uint64) for y in f[c]]).astype(np.float64)[x.at[level]] for c in ("core", "late"))
        got.append((core, late))
    return x, got


def _parts(x: Block, c: list[np.ndarray], n_tokens: float, n_docs: float, distinct: int):
    """Estimates by level, highest last, and the bucket of each token's longest context."""
    p = [np.full(len(c[0]), 1.0 / (distinct + 1)), c[0] / n_tokens if n_tokens else np.zeros(len(c[0]))]
    context = None
    for level in range(1, len(c)):
        context = np.empty(len(c[0]))
        context[1:] = c[level - 1][:-1]
        context[x.first] = n_docs  # a document begins in a context that each document has once
        p.append(np.divide(c[level], context, out=np.zeros_like(context), where=context > 0))
    bucket = np.zeros(len(c[0]), np.int64)
    seen = context > 0
    bucket[seen] = 1 + np.minimum(np.log2(context[seen]).astype(np.int64), BUCKETS - 2)
    return p, bucket


def unfold(cell: np.ndarray, n: np.ndarray, lowest: float, levels: int) -> np.ndarray:
    """Rows (bucket, cell of each level ..., count) of the folded histogram; a cell of -1: estimate 0."""
    out = [n]
    for _ in range(levels - 1):
        cell, at = np.divmod(cell, CELLS)
        out.append(at - 1)
    out.append(np.full(len(cell), round((np.log10(lowest) - FLOOR) / GRID)))
    return np.stack([cell, *out[::-1]], 1)


def learn_weights(cells: Sequence, levels: int, rounds: int = 60) -> np.ndarray:
    """EM over (bucket, cell of each level ..., count): weights by bucket, lowest level first."""
    w = np.full((BUCKETS, levels), 1.0 / levels)
    if not len(cells):
        return w
    a = np.array(cells, np.float64)
    bucket, n = a[:, 0].astype(int), a[:, -1]
    p = np.where(a[:, 1:-1] < 0, 0.0, 10.0 ** (a[:, 1:-1] * GRID + FLOOR))
    total = np.bincount(bucket, weights=n, minlength=BUCKETS)
    for _ in range(rounds):
        mixed = w[bucket] * p
        share = mixed / np.maximum(mixed.sum(1, keepdims=True), 1e-300) * n[:, None]
        for k in range(levels):
            # One pseudo-count on each part: no weight is ever 0, so no text has probability 0.
            w[:, k] = (np.bincount(bucket, weights=share[:, k], minlength=BUCKETS) + 1.0 / levels) / (total + 1.0)
    return w


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = 10, order: int = 3,
          block_tokens: int = BLOCK_TOKENS, range_tokens: int = RANGE_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of ``docs``."""
    spark = docs.sparkSession
    stored = store(blocks(docs, doc_id, text, folds, block_tokens), "lm-blocks")
    by = {r.held: r.n for r in stored.groupBy("held").agg(F.sum("n").alias("n")).collect()}  # three numbers
    total = sum(by.values())
    ranges, bits = max(1, -(-total * order // range_tokens)), key_bits(total)
    answers = store(answer(ask(stored, order, ranges, bits)), "lm-answers")
    distinct = answers.agg(F.sum("distinct")).first()[0] or 0
    n_core, n_all = by.get(0, 0), by.get(0, 0) + by.get(2, 0)
    # Documents are as many as end tokens.
    ends = stored.select("held", "sizes").mapInArrow(_count_docs, "held int, docs bigint").groupBy("held").agg(F.sum("docs").alias("n"))
    by_docs = {r.held: r.n for r in ends.collect()}
    d_core, d_all = by_docs.get(0, 0), by_docs.get(0, 0) + by_docs.get(2, 0)

    def histogram(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        x, c = _looked_up(left, right, order, bits)
        p, bucket = _parts(x, [core for core, _ in c], n_core, d_core, distinct)
        cell = bucket
        for q in p[1:]:
            at = np.where(q > 0, 1 + np.maximum(0, np.round((np.log10(np.maximum(q, 1e-300)) - FLOOR) / GRID)), 0)
            cell = cell * CELLS + at.astype(np.int64)
        rows, n = np.unique(cell, return_counts=True)
        return pd.DataFrame({"cell": rows, "n": n})

    late = stored.where("held = 2")
    cells = (late.select("block", "sizes", "vocab", "tokens").groupBy("block")
             .cogroup(answers.join(late.select("block"), "block", "left_semi").groupBy("block"))
             .applyInPandas(histogram, "cell bigint, n bigint")
             .groupBy("cell").agg(F.sum("n").alias("n")).sort("cell").toArrow())
    weights = learn_weights(unfold(cells["cell"].to_numpy(), cells["n"].to_numpy(), 1.0 / (distinct + 1), order + 1), order + 1)

    def finish(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        x, c = _looked_up(left, right, order, bits)
        r = left.iloc[0]
        counts = [core + late for core, late in c]
        p, bucket = _parts(x, counts, n_all, d_all, distinct)
        w = weights[bucket]
        prob = np.maximum(sum(w[:, k] * p[k] for k in range(len(p))), 1e-300)
        base = np.log10((counts[0] + 0.1) / (n_all + 0.1 * (distinct + 1)))
        start = np.concatenate([[0], np.cumsum(x.sizes)[:-1]])
        ids = unpack(r["docs"], np.int64).reshape(-1, 2)
        return pd.DataFrame({
            "doc_id": pd.array(ids[:, 0], "Int64").copy() if not ids[:, 1].any() else pd.array(
                [None if z else i for i, z in ids.tolist()], "Int64"),
            "held_out": int(r["held"]) == 1, "n_tokens": x.sizes,
            "n_known": np.add.reduceat((counts[0] > 0).astype(np.int64), start),
            "train_tokens": n_all, "base_score": np.add.reduceat(base, start),
            "score": np.add.reduceat(np.log10(prob), start)})

    n = max(partitions(spark), ranges)
    return (stored.select("block", "held", "docs", "sizes", "vocab", "tokens").repartition(n, "block").groupBy("block")
            .cogroup(answers.select("block", "level", "part", "core", "late").repartition(n, "block").groupBy("block"))
            .applyInPandas(finish, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
                                   "base_score double, score double"))


def _count_docs(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([len(unpack(x, np.uint32)) for x in b.column(1).to_pylist()], pa.int64())], names=["held", "docs"])
