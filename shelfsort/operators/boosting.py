"""Gradient-boosted trees for many classes on sparse features (M3).

Every round grows one regression tree per class on the softmax gradients, level
by level.  Rows lie in blocks sorted by feature; a task adds up the gradients
and hessians of its blocks per (class, node, feature, bin), Spark sums them with
partial aggregation, each feature's best split is read off its summed bins, and
the best feature per node is the only thing that comes to the driver: at most
``classes * 2^depth`` rows a level, whatever the number of rows.

* A feature that a row does not have is *missing*, not zero: each split learns
  the side missing rows go to.
* Present values are cut into ``bins`` steps, even in the logarithm between the
  feature's smallest and largest value; trees are blind to the scale otherwise.
* Gradients and hessians are rounded to multiples of 2^-26 and summed as
  integers, so a model does not depend on partitioning or task order.
* Margins travel with the blocks: a round's trees are applied once, to cached
  blocks, and every ``CHECKPOINT`` rounds a reliable checkpoint cuts the lineage.
* A table of few enough rows is dealt by feature instead (``COLUMN_BYTES`` a task,
  ``ROW_CELLS`` rows * classes): a task holds the entries of its features and has
  their sums to itself, so no histogram is sent.  A level is a job of one stage,
  which returns each task's best split a node and which rows it sends left; the
  driver keeps the rows' nodes and margins.  Sums are whole numbers, so the trees
  are the same.
* Gradients and hessians are rounded to multiples of 2^-26 and summed as
  integers, so a model does not depend on partitioning or task order.
* Margins travel with the blocks: a round's trees are applied once, to cached
  blocks, and every ``CHECKPOINT`` rounds a reliable checkpoint cuts the lineage.
* A table whose columns fit the tasks of one wave (``COLUMN_BYTES`` each) is dealt
  by feature instead: one barrier job grows all rounds, a task holds the entries
  of its features and the margins of all rows, and tasks tell each other only
  their best splits and which rows go left.  A node's sums are its parent's less
  its sibling's.  Sums are whole numbers, so the trees are the same.

Ties between splits go to the lower feature, then the lower bin, then missing
rows to the right.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

SCALE = float(1 << 26)
BLOCK_ROWS, BLOCK_ENTRIES = 4096, 1 << 20
CHECKPOINT = 10
LEAST_GAIN = 1e-6


@dataclass(frozen=True)
class BoostParams:
    """Shape of the forest; the first three are the original tool's."""
    rounds: int = 200
    depth: int = 6
    rate: float = 0.1
    bins: int = 16
    l2: float = 1.0
    min_hessian: float = 1.0


@dataclass
class Tree:
    """Nodes in order of creation; a leaf has feature -1."""
    feature: list = field(default_factory=lambda: [-1])
    bin: list = field(default_factory=lambda: [0])
    missing_left: list = field(default_factory=lambda: [False])
    left: list = field(default_factory=lambda: [-1])
    right: list = field(default_factory=lambda: [-1])
    value: list = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, bin_: int, missing_left: bool) -> tuple[int, int]:
        a, b = len(self.feature), len(self.feature) + 1
        self.feature[node], self.bin[node], self.missing_left[node] = feature, bin_, missing_left
        self.left[node], self.right[node] = a, b
        for _ in range(2):
            for column, empty in ((self.feature, -1), (self.bin, 0), (self.missing_left, False), (self.left, -1), (self.right, -1), (self.value, 0.0)):
                column.append(empty)
        return a, b


# ---- blocks ---------------------------------------------------------------------------

BLOCK = "rids binary, y binary, feat binary, row binary, bin binary, margin binary"
_NAMES = [c.split()[0] for c in BLOCK.split(", ")]


def _arrays(block: dict, classes: int) -> tuple:
    y = np.frombuffer(block["y"], np.int32)
    return (y, np.frombuffer(block["feat"], np.int32), np.frombuffer(block["row"], np.int32),
            np.frombuffer(block["bin"], np.int16), np.frombuffer(block["margin"], np.float64).reshape(len(y), classes))


def pack_blocks(rows: DataFrame, classes: int) -> DataFrame:
    """``rows``: rid, y, kv array<struct<idx int, bin int>> -> blocks with zero margins."""
    import pickle

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rids, ys, feats, at, bins, n = [], [], [], [], [], 0

        def block() -> pa.RecordBatch:
            f = np.concatenate(feats) if feats else np.empty(0, np.int32)
            r = np.concatenate(at) if at else np.empty(0, np.int32)
            b = np.concatenate(bins) if bins else np.empty(0, np.int16)
            order = np.lexsort((r, f))
            y = np.array(ys, np.int32)
            cells = [pickle.dumps(rids), y.tobytes(), f[order].tobytes(), r[order].tobytes(), b[order].tobytes(),
                     np.zeros((len(y), classes)).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cells], names=_NAMES)

        for batch in batches:
            kv = batch.column("kv")
            lengths = kv.value_lengths().to_numpy(zero_copy_only=False)
            flat = kv.flatten()
            idx = flat.field("idx").to_numpy(zero_copy_only=False).astype(np.int32)
            bin_ = flat.field("bin").to_numpy(zero_copy_only=False).astype(np.int16)
            start = 0
            for rid, y, size in zip(batch.column("rid").to_pylist(), batch.column("y").to_pylist(), lengths.tolist()):
                if rids and (len(rids) >= BLOCK_ROWS or n + size > BLOCK_ENTRIES):
                    yield block()
                    rids, ys, feats, at, bins, n = [], [], [], [], [], 0
                feats.append(idx[start:start + size])
                bins.append(bin_[start:start + size])
                at.append(np.full(size, len(rids), np.int32))
                rids.append(rid)
                ys.append(-1 if y is None else y)
                start, n = start + size, n + size
        if rids:
            yield block()

    return rows.select("rid", "y", "kv").mapInArrow(run, BLOCK)


def walk(tree: Tree, n: int, feat: np.ndarray, row: np.ndarray, bin_: np.ndarray) -> np.ndarray:
    """The node each of a block's ``n`` rows ends in."""
    at = np.zeros(n, np.int32)
    for node, f in enumerate(tree.feature):              # children come after their parent
        if f < 0:
            continue
        here = at == node
        if not here.any():
            continue
        lo, hi = np.searchsorted(feat, (f, f + 1))
        left = np.full(n, tree.missing_left[node])
        left[row[lo:hi]] = bin_[lo:hi] <= tree.bin[node]
        at[here & left] = tree.left[node]
        at[here & ~left] = tree.right[node]
    return at


def softmax(margin: np.ndarray) -> np.ndarray:
    e = np.exp(margin - margin.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradients(margin: np.ndarray, y: np.ndarray, c: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and hessian of class ``c``, as integers."""
    return _rounded(softmax(margin)[:, c], y == c)


def _rounded(p: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    g, h = p - own, np.maximum(2.0 * p * (1.0 - p), 1e-16)
    return np.rint(g * SCALE), np.rint(h * SCALE)


def root_sums(classes: int):
    """Per block: cls, g, h, integer sums over all rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = np.zeros((classes, 2), np.int64)
            for block in batch.to_pylist():
                y, _, _, _, margin = _arrays(block, classes)
                for c in range(classes):
                    sums[c] += [int(x.sum()) for x in gradients(margin, y, c)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(classes, dtype=np.int32)), pa.array(sums[:, 0]), pa.array(sums[:, 1])],
                                             names=["cls", "g", "h"])
    return run


def histograms(trees: list[Tree], open_nodes: list[list[int]], bins: int):
    """Per block: cls, node, feature, g0..g{bins-1}, h0..h{bins-1}, integer sums
    over the rows of each open node."""
    classes = len(trees)
    names = ["cls", "node", "feature", *[f"g{b}" for b in range(bins)], *[f"h{b}" for b in range(bins)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                y, feat, row, bin_, margin = _arrays(block, classes)
                if not len(y):
                    continue
                seen, place = np.unique(feat, return_inverse=True)
                for c, tree in enumerate(trees):
                    if not open_nodes[c]:
                        continue
                    slot_of = np.full(len(tree.feature), -1, np.int64)
                    slot_of[open_nodes[c]] = np.arange(len(open_nodes[c]))
                    slot = slot_of[walk(tree, len(y), feat, row, bin_)]
                    g, h = gradients(margin, y, c)
                    of = slot[row]
                    keep = of >= 0
                    k, width = len(open_nodes[c]), len(seen) * bins
                    key = of[keep] * width + place[keep] * bins + bin_[keep]
                    sg = np.bincount(key, g[row[keep]], k * width).reshape(-1, bins)
                    sh = np.bincount(key, h[row[keep]], k * width).reshape(-1, bins)
                    use = np.nonzero(sh.any(axis=1))[0]
                    node, feature = np.array(open_nodes[c])[use // max(1, len(seen))], seen[use % max(1, len(seen))]
                    sg, sh = sg[use], sh[use]
                    if len(node):
                        columns = [pa.array(np.full(len(node), c, np.int32)), pa.array(node.astype(np.int32)), pa.array(feature.astype(np.int32))]
                        columns += [pa.array(m[:, b].astype(np.int64)) for m in (sg, sh) for b in range(bins)]
                        yield pa.RecordBatch.from_arrays(columns, names=names)
    return run


def best_of(g: np.ndarray, h: np.ndarray, total_g: np.ndarray, total_h: np.ndarray, params: BoostParams) -> tuple:
    """Best split of each row of summed bins: gain, bin, missing_left, left sums.

    Sums are integers; ``total_*`` are the node's."""
    tg, th = total_g[:, None], total_h[:, None]
    cg, ch = np.cumsum(g, axis=1), np.cumsum(h, axis=1)
    miss_g, miss_h = tg - cg[:, -1:], th - ch[:, -1:]

    def gain(lg, lh):
        rg, rh = tg - lg, th - lh
        least, l2 = params.min_hessian * SCALE, params.l2 * SCALE
        with np.errstate(divide="ignore", invalid="ignore"):
            value = (lg * 1.0 * lg / (lh + l2) + rg * 1.0 * rg / (rh + l2) - tg * 1.0 * tg / (th + l2)) / SCALE
        return np.where((lh >= least) & (rh >= least), value, -np.inf)

    # bin by bin, missing to the right first: the order in which ties are decided
    both = np.stack([gain(cg, ch), gain(cg + miss_g, ch + miss_h)], axis=2).reshape(len(g), -1)
    at = both.argmax(axis=1)
    rows = np.arange(len(g))
    bin_, left = at // 2, at % 2 == 1
    lg = cg[rows, bin_] + np.where(left, miss_g[:, 0], 0)
    lh = ch[rows, bin_] + np.where(left, miss_h[:, 0], 0)
    return both[rows, at], bin_, left, lg, lh


SPLIT = "cls int, node int, feature int, gain double, bin int, missing_left boolean, lg long, lh long"


def splits(totals: dict, params: BoostParams):
    """Summed bins -> the best split each batch has for each open node."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cls, node, feature = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cls", "node", "feature"))
            g, h = (np.stack([batch.column(f"{s}{b}").to_numpy(zero_copy_only=False) for b in range(params.bins)], axis=1) for s in "gh")
            own = np.array([totals[c, k] for c, k in zip(cls.tolist(), node.tolist())], dtype=np.int64)
            gain, bin_, left, lg, lh = best_of(g, h, own[:, 0], own[:, 1], params)
            good = gain > LEAST_GAIN
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[good].astype(t)) for x, t in ((cls, np.int32), (node, np.int32), (feature, np.int32), (gain, np.float64),
                                                          (bin_, np.int32), (left, bool), (lg, np.int64), (lh, np.int64))],
                names=[c.split()[0] for c in SPLIT.split(", ")])
    return run


def apply_trees(trees: list[Tree]):
    """Adds one round's leaf values to the margins of the blocks."""
    classes = len(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for block in batch.to_pylist():
                y, feat, row, bin_, margin = _arrays(block, classes)
                margin = margin.copy()
                for c, tree in enumerate(trees):
                    margin[:, c] += np.array(tree.value)[walk(tree, len(y), feat, row, bin_)]
                out.append(margin.tobytes())
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in _NAMES[:-1]], pa.array(out, pa.binary())], names=_NAMES)
    return run


# ---- training ----------------------------------------------------------------------------

class Grower:
    """Grows the trees of a round; what the jobs of all rounds share is built once."""

    def __init__(self, classes: int, params: BoostParams):
        self.classes, self.params = classes, params
        cells = [f"{s}{b}" for s in "gh" for b in range(params.bins)]
        self.schema = "cls int, node int, feature int, " + ", ".join(f"{c} long" for c in cells)
        self.sums = [F.sum(c).alias(c) for c in cells]
        self.best = F.min_by(F.struct("feature", "bin", "missing_left", "lg", "lh"), F.struct(-F.col("gain"), "feature")).alias("s")

    def grow(self, blocks: DataFrame) -> list[Tree]:
        params = self.params
        trees = [Tree() for _ in range(self.classes)]
        # a row a class comes to the driver here, a row an open node below
        totals = {(r["cls"], 0): (r["g"], r["h"]) for r in blocks.mapInArrow(root_sums(self.classes), "cls int, g long, h long")
                  .groupBy("cls").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()}
        open_nodes = [[0] if (c, 0) in totals else [] for c in range(self.classes)]
        for _ in range(params.depth):
            summed = (blocks.mapInArrow(histograms(trees, open_nodes, params.bins), self.schema)
                      .groupBy("cls", "node", "feature").agg(*self.sums))
            best = summed.mapInArrow(splits(dict(totals), params), SPLIT).groupBy("cls", "node").agg(self.best).select("cls", "node", "s.*").collect()
            open_nodes = [[] for _ in range(self.classes)]
            for r in sorted(best, key=lambda x: (x["cls"], x["node"])):
                at = r["cls"], r["node"]
                a, b = trees[r["cls"]].split(r["node"], r["feature"], r["bin"], r["missing_left"])
                (g, h), left = totals[at], (r["lg"], r["lh"])
                totals[r["cls"], a], totals[r["cls"], b] = left, (g - left[0], h - left[1])
                # a node too light to be cut in two is a leaf at once
                open_nodes[r["cls"]] += [k for k in (a, b) if totals[r["cls"], k][1] >= 2 * params.min_hessian * SCALE]
            if not any(open_nodes):
                break
        for (c, node), (g, h) in totals.items():
            if trees[c].feature[node] < 0:
                trees[c].value[node] = -params.rate * g / (h + params.l2 * SCALE)
        return trees


# ---- training by columns -----------------------------------------------------------------

COLUMN_BYTES = 256 << 20  # most entries of a task that holds its features' columns
COLUMN_ENTRIES = 100_000  # least entries worth a task
STEP_ENTRIES = 1 << 16    # entries summed at once
ROW_CELLS = 2_000_000     # most rows * classes (40 bytes each) the driver keeps
PIECE = "part int, pid int, seq int, n int, y binary, feat binary, row binary, bin binary"


def _column_tasks(blocks: DataFrame, classes: int) -> int:
    """Tasks to train in by columns, or 0 if these or the driver would not hold the table."""
    n, entries = blocks.agg(*[F.coalesce(F.sum(F.octet_length(c) / 4), F.lit(0)).cast("bigint") for c in ("y", "feat")]).first()
    tasks = max(1, min(blocks.sparkSession.sparkContext.defaultParallelism, entries // COLUMN_ENTRIES))
    return tasks if n and n * classes <= ROW_CELLS and entries // tasks * 10 <= COLUMN_BYTES else 0


def deal_columns(tasks: int):
    """Blocks -> pieces of one task's features each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        pid, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            for block in batch.to_pylist():
                feat, row, bin_ = (np.frombuffer(block[c], t) for c, t in (("feat", np.int32), ("row", np.int32), ("bin", np.int16)))
                for k in range(tasks):
                    own = feat % tasks == k
                    cells = [k, pid, seq, len(block["y"]) // 4, block["y"], *(x[own].tobytes() for x in (feat, row, bin_))]
                    types = [pa.int32()] * 4 + [pa.binary()] * 4
                    yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, types)], names=[c.split()[0] for c in PIECE.split(", ")])
                seq += 1
    return run


class Columns:
    """The entries of a task's features by row and by feature, and the labels of all rows."""

    def __init__(self, pieces: list[dict], bins: int):
        pieces = sorted(pieces, key=lambda x: (x["pid"], x["seq"]))
        start = np.cumsum([0, *(x["n"] for x in pieces)])
        self.n, self.bins = int(start[-1]), bins
        self.y = np.concatenate([np.frombuffer(x["y"], np.int32) for x in pieces] or [np.empty(0, np.int32)])
        feat = np.concatenate([np.frombuffer(x["feat"], np.int32) for x in pieces] or [np.empty(0, np.int32)])
        row = np.concatenate([np.frombuffer(x["row"], np.int32) + np.int32(at) for x, at in zip(pieces, start)] or [np.empty(0, np.int32)])
        bin_ = np.concatenate([np.frombuffer(x["bin"], np.int16) for x in pieces] or [np.empty(0, np.int16)])
        self.features, place = np.unique(feat, return_inverse=True)
        cell = (place * bins + bin_).astype(np.int32)
        self.cell = cell[np.argsort(row, kind="stable")]             # by row
        self.length = np.bincount(row, minlength=self.n).astype(np.int32)
        order = np.argsort(cell, kind="stable")                      # by feature and bin
        self.rows_of, cell = row[order], cell[order]
        self.found, self.first = (x.astype(np.int32) for x in np.unique(cell, return_index=True))

    def sums(self, rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """(2, features, bins): sums of ``g`` and ``h`` (of all rows) over ``rows``."""
        out = np.zeros((2, len(self.features) * self.bins))
        if len(rows) == self.n:
            if len(self.first):
                for o, x in zip(out, (g, h)):
                    o[self.found] = np.add.reduceat(x[self.rows_of], self.first)
            return out.reshape(2, -1, self.bins)
        length = self.length[rows]
        if not hasattr(self, "own"):
            self.own = np.split(self.cell, np.cumsum(self.length)[:-1])
        # steps that stay in the processor's cache
        cut = np.flatnonzero(np.diff(np.cumsum(length, dtype=np.int64) // STEP_ENTRIES)) + 1
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(rows)]):
            cell = np.concatenate([self.own[r] for r in rows[lo:hi].tolist()]).astype(np.intp) if hi > lo else np.empty(0, np.intp)
            for o, x in zip(out, (g, h)):
                o += np.bincount(cell, np.repeat(x[rows[lo:hi]], length[lo:hi]), out.shape[1])
        return out.reshape(2, -1, self.bins)

    def best(self, sums: np.ndarray, total: tuple, params: BoostParams) -> tuple | None:
        """gain, feature, bin, missing_left, lg, lh of the best split among the task's features."""
        here = np.flatnonzero(sums[1].any(axis=1))
        if not len(here):
            return None
        tg, th = (np.full(len(here), float(x)) for x in total)
        gain, bin_, left, lg, lh = best_of(sums[0][here], sums[1][here], tg, th, params)
        at = int(np.argmax(np.where(gain > LEAST_GAIN, gain, -np.inf)))
        if not gain[at] > LEAST_GAIN:
            return None
        return float(gain[at]), int(self.features[here[at]]), int(bin_[at]), bool(left[at]), int(lg[at]), int(lh[at])

    def goes_left(self, rows: np.ndarray, feature: int, bin_: int, missing_left: bool) -> np.ndarray:
        at = int(np.searchsorted(self.features, feature)) * self.bins
        lo, mid, hi = np.append(self.first, len(self.rows_of))[np.searchsorted(self.found, (at, at + bin_ + 1, at + self.bins))]
        left = np.full(self.n, missing_left)
        left[self.rows_of[lo:mid]] = True
        left[self.rows_of[mid:hi]] = False
        return left[rows]

    def splits(self, nodes: np.ndarray, grads: list, totals: dict, params: BoostParams) -> list[tuple]:
        """((class, node), best split, packed sides of the node's rows) for every open
        node of ``totals``; ``nodes`` has each row's node, by class."""
        out = []
        for c, (g, h) in enumerate(grads):
            order = np.argsort(nodes[c], kind="stable")
            here = nodes[c][order]
            for at in sorted(x for x in totals if x[0] == c):
                lo, hi = np.searchsorted(here, (at[1], at[1] + 1))
                rows = order[lo:hi]
                if split := self.best(self.sums(rows, g, h), totals[at], params):
                    out.append((at, split, np.packbits(self.goes_left(rows, *split[1:4])).tobytes()))
        return out


def grow_by_columns(columns, margin: np.ndarray, y: np.ndarray, params: BoostParams) -> list[Tree]:
    """The trees of one round; ``margin`` moves by them."""
    n, classes = margin.shape
    trees, p = [Tree() for _ in range(classes)], softmax(margin)
    grads = [_rounded(p[:, c], y == c) for c in range(classes)]
    totals = {(c, 0): tuple(int(x.sum()) for x in grads[c]) for c in range(classes)}
    nodes, opened = np.zeros((classes, n), np.int32), dict(totals)
    sent = columns.context.broadcast(grads)
    for _ in range(params.depth):
        asked = opened

        def run(parts: Iterator[Columns], nodes=nodes, asked=asked) -> Iterator[list]:
            for part in parts:
                yield part.splits(nodes, sent.value, asked, params)

        best = {}
        for found in columns.mapPartitions(run).collect():       # at most a split an open node and task
            for at, split, left in found:
                if at not in best or (-split[0], split[1]) < (-best[at][0][0], best[at][0][1]):
                    best[at] = split, left
        opened, before = {}, nodes.copy()
        for at in sorted(best):
            (c, node), ((_, feature, bin_, missing_left, lg, lh), left) = at, best[at]
            a, b = trees[c].split(node, feature, bin_, missing_left)
            here = np.flatnonzero(before[c] == node)
            nodes[c, here] = np.where(np.unpackbits(np.frombuffer(left, np.uint8), count=len(here)) > 0, a, b)
            g, h = totals[at]
            totals[c, a], totals[c, b] = (lg, lh), (g - lg, h - lh)
            # a node too light to be cut in two is a leaf at once
            opened |= {(c, k): totals[c, k] for k in (a, b) if totals[c, k][1] >= 2 * params.min_hessian * SCALE}
        if not opened:
            break
    sent.destroy()
    for (c, node), (g, h) in totals.items():
        if trees[c].feature[node] < 0:
            trees[c].value[node] = -params.rate * g / (h + params.l2 * SCALE)
    for c, tree in enumerate(trees):
        margin[:, c] += np.array(tree.value)[nodes[c]]
    return trees


def train_by_columns(blocks: DataFrame, classes: int, params: BoostParams, tasks: int) -> list[list[Tree]]:
    pieces = blocks.mapInArrow(deal_columns(tasks), PIECE).repartitionById(tasks, F.col("part"))
    bins = params.bins
    columns = pieces.rdd.mapPartitions(lambda rows: [Columns([r.asDict() for r in rows], bins)]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        y = columns.map(lambda x: x.y).first()        # 4 bytes a row
        margin, forest = np.zeros((len(y), classes)), []
        for _ in range(params.rounds):
            forest.append(grow_by_columns(columns, margin, y, params))
            if all(len(tree.feature) == 1 for tree in forest[-1]):
                break
        return forest
    finally:
        columns.unpersist()


def train(rows: DataFrame, classes: int, params: BoostParams = BoostParams()) -> list[list[Tree]]:
    """``rows``: rid, y (0..classes-1), kv array<struct<idx, bin>>.  Returns the
    trees of every round.  A round in which no tree splits is the last: from
    there on rounds would only shift whole classes."""
    blocks = cut_lineage(pack_blocks(rows, classes))
    if tasks := _column_tasks(blocks, classes):
        return train_by_columns(blocks, classes, params, tasks)
    return train_by_rows(blocks, classes, params)


def train_by_rows(blocks: DataFrame, classes: int, params: BoostParams) -> list[list[Tree]]:
    """``train`` with a job a level; holds nothing that grows with the rows."""
    grower, forest, cached = Grower(classes, params), [], None
    for t in range(params.rounds):
        forest.append(grower.grow(blocks))
        # the jobs of this round have filled the cache of its blocks
        if cached is not None:
            cached.unpersist()
            cached = None
        if t + 1 == params.rounds or all(len(tree.feature) == 1 for tree in forest[-1]):
            break
        moved = blocks.mapInArrow(apply_trees(forest[-1]), BLOCK)
        if (t + 1) % CHECKPOINT == 0:
            if blocks.is_cached:
                cached = blocks
            blocks = cut_lineage(moved)
        else:
            cached = blocks if blocks.is_cached else None
            blocks = moved.persist()
    for df in (cached, blocks):
        if df is not None:
            df.unpersist()
    return forest


def margins(forest: list[list[Tree]], rows: DataFrame, classes: int) -> DataFrame:
    """rid, p array<double>: softmax probabilities of ``rows`` (rid, kv)."""
    rid_type = rows.schema["rid"].dataType.simpleString()
    arrow_type = pa.string() if rid_type == "string" else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle
        for batch in batches:
            for block in batch.to_pylist():
                y, feat, row, bin_, margin = _arrays(block, classes)
                margin = margin.copy()
                for trees in forest:
                    for c, tree in enumerate(trees):
                        margin[:, c] += np.array(tree.value)[walk(tree, len(y), feat, row, bin_)]
                p = softmax(margin) if len(y) else margin
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * classes, pa.int32()), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(pickle.loads(block["rids"]), arrow_type), flat], names=["rid", "p"])
    return (pack_blocks(rows.withColumn("y", F.lit(-1)), classes)
            .mapInArrow(run, f"rid {rid_type}, p array<double>"))


# ---- features and storage -----------------------------------------------------------------

def bin_edges(weights: DataFrame) -> DataFrame:
    """idx, lo, span: smallest logarithm of each feature's weights and the
    distance to the largest."""
    return weights.groupBy("idx").agg(F.log(F.min("w")).alias("lo"), (F.log(F.max("w")) - F.log(F.min("w"))).alias("span"))


NODE = "round int, cls int, node int, feature int, bin int, missing_left boolean, left int, right int, value double"


def forest_table(spark, forest: list[list[Tree]]) -> DataFrame:
    """The trees as rows (bounded by rounds, classes and depth)."""
    rows = [(t, c, k, tree.feature[k], tree.bin[k], bool(tree.missing_left[k]), tree.left[k], tree.right[k], float(tree.value[k]))
            for t, trees in enumerate(forest) for c, tree in enumerate(trees) for k in range(len(tree.feature))]
    return spark.createDataFrame(rows, NODE)


def forest_of(table: DataFrame) -> list[list[Tree]]:
    rows = sorted(table.collect())
    out: list[list[Tree]] = []
    for r in rows:
        if r["round"] == len(out):
            out.append([])
        if r["cls"] == len(out[-1]):
            out[-1].append(Tree([], [], [], [], [], []))
        tree = out[-1][-1]
        for column, name in ((tree.feature, "feature"), (tree.bin, "bin"), (tree.missing_left, "missing_left"), (tree.left, "left"),
                             (tree.right, "right"), (tree.value, "value")):
            column.append(r[name])
    return out
