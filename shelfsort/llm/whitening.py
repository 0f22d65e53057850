"""Embedding whitening: principal components of a distributed covariance.

1. One pass sums every dimension of the fit list exactly (integers).
2. A second pass multiplies centred vectors, batch by batch, and adds the small
   matrices up in Spark.  Vectors are centred on the rounded mean, so every
   product and sum is an integer that a double holds exactly, whatever the
   partitioning; the rest of the mean (under one half a dimension) is taken off
   the finished matrix, where it loses nothing.
3. The driver takes the d x d matrix apart (d is the length of a vector and does
   not grow with the table): Householder reflections make it tridiagonal, Sturm
   counts bisect the leading eigenvalues, inverse iteration gives their vectors
   and reorthogonalises those of close eigenvalues.
4. The components go to every task (k x d numbers) and project the rows.

Defined cases: rows whose vector is null, or holds null, NaN, infinite entries
or entries of 2^42 and more, are dropped; vectors of another length than the
most frequent one (ties: the longer) can't share a covariance and are dropped
too; rows repeating an id are vectors of their own; a null id stays null;
components whose eigenvalue is zero (constant tables, a single row, fewer rows
than components) get a null ``whitened``; an empty table gives no rows; other
columns of the table play no part.  Signs follow the largest entry of a
component, which is made positive; equal eigenvalues share a plane, any
orthonormal pair of which is right.  A ``deviation`` beyond a long is null.
"""
from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsort.llm.common import store

SCALE, SHIFT = 1024.0, 100_000
COMPONENTS = 8
LIMIT = float(1 << 42)          # entries from here on count as not finite
LOW = (1 << 26) - 1
EPS = float(np.finfo(float).eps)


# ---- tasks: rows to small sums ------------------------------------------------

def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, embedding (doubles) of the rows that stay."""
    v = F.col(embedding).cast("array<double>")
    good = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= LIMIT))
    return (vectors.select(F.col(vec_id).alias("vec_id"), v.alias("v"))
            .where(F.col("v").isNotNull() & (F.size("v") > 0)).where(good))


def integers(column: pa.ListArray, size: int) -> np.ndarray:
    """The x-vectors of a batch, one a row."""
    c = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    return np.floor(SCALE * c).astype(np.int64) + SHIFT


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    lengths = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
    for size in np.unique(lengths):
        yield int(size), batch if len(lengths) == (same := lengths == size).sum() else batch.filter(pa.array(same))


def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """size, dim, n, total: a task's sums of every dimension, exact."""
    sums: dict[int, list] = {}
    for batch in batches:
        for size, part in by_length(batch):
            x = integers(part.column("v"), size)
            at = sums.setdefault(size, [0, [0] * size])
            at[0] += len(x)
            high, low = (x >> 26).sum(axis=0).tolist(), (x & LOW).sum(axis=0).tolist()
            at[1] = [t + (h << 26) + w for t, h, w in zip(at[1], high, low)]
    for size, (n, total) in sums.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([size] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()),
             pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], names=["size", "dim", "n", "total"])


def products(size: int, centre: list[int]):
    """A task's upper triangle of the summed products of centred vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle, out = np.array(centre, dtype=np.int64), None
        for batch in batches:
            for length, part in by_length(batch):
                if length == size:
                    z = (integers(part.column("v"), size) - middle).astype(np.float64)
                    out = z.T @ z if out is None else out + z.T @ z
        if out is not None:
            i, j = np.triu_indices(size)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(out[i, j])],
                                             names=["i", "j", "s"])
    return run


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n*x - S)^2, exact."""
    widest = max(int(np.abs(x).max(initial=0)) * n, max(map(abs, sums), default=0))
    if widest < 1 << 62:
        y = x * n - np.array(sums, dtype=np.int64)
        if float(np.abs(y).max(initial=0)) ** 2 * max(1, x.shape[1]) < float(1 << 62):
            return (y * y).sum(axis=1).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
    return [e if e < 1 << 63 else None for e in exact]


def projection(size: int, n: int, sums: list[int], weights: np.ndarray):
    """vec_id, deviation, w: the whitened coordinates of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.array([s // n for s in sums], dtype=np.int64)
        rest = np.array([(s % n) / n for s in sums])
        for batch in batches:
            for length, part in by_length(batch):
                if length != size:
                    continue
                x = integers(part.column("v"), size)
                w = ((x - whole).astype(np.float64) - rest) @ weights.T
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * weights.shape[0], pa.int32()), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(deviations(x, n, sums), pa.int64()), flat],
                                                 names=["vec_id", "deviation", "w"])
    return run


# ---- driver: a d x d matrix ------------------------------------------------------

def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """Householder reflections: diagonal, off-diagonal and the reflectors."""
    a = matrix.astype(np.float64).copy()
    d = len(a)
    mirrors = []
    for k in range(d - 2):
        x = a[k + 1:, k].copy()
        size = np.abs(x[1:]).max(initial=0.0)
        if size == 0.0:
            mirrors.append(None)
            continue
        norm = np.linalg.norm(x)
        v = x
        v[0] += norm if x[0] >= 0 else -norm
        v /= np.linalg.norm(v)
        block = a[k + 1:, k + 1:]
        p = 2.0 * (block @ v)
        q = p - (v @ p) * v
        block -= np.outer(v, q) + np.outer(q, v)
        head = a[k + 1:, k] - 2.0 * v * (v @ a[k + 1:, k])
        a[k + 1:, k], a[k, k + 1:] = head, head
        mirrors.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), mirrors


def below(diagonal: np.ndarray, squares: np.ndarray, x: float, least: float) -> int:
    """Sturm count: eigenvalues under x."""
    count, q = 0, 1.0
    for k, a in enumerate(diagonal):
        q = a - x - (squares[k - 1] / q if k else 0.0)
        if abs(q) < least:
            q = -least
        count += q < 0
    return count


def leading(diagonal: np.ndarray, off: np.ndarray, k: int) -> list[float]:
    """The k largest eigenvalues, falling, by bisection."""
    d = len(diagonal)
    reach = np.zeros(d)
    reach[:-1] += np.abs(off)
    reach[1:] += np.abs(off)
    low, high = float((diagonal - reach).min()), float((diagonal + reach).max())
    size = max(abs(low), abs(high))
    least = max(size * EPS * EPS, 1e-300)
    squares = (off * off).tolist()
    line = diagonal.tolist()
    low, high = low - 2 * EPS * size - least, high + 2 * EPS * size + least
    out = []
    for i in range(min(k, d)):
        a, b = low, out[-1] + 2 * EPS * size if out else high
        while True:
            middle = (a + b) / 2
            if middle <= a or middle >= b or b - a <= EPS * EPS * size:
                break
            # the i-th largest lies above middle when at most d-1-i eigenvalues lie under it
            if below(line, squares, middle, least) <= d - 1 - i:
                a = middle
            else:
                b = middle
        out.append((a + b) / 2)
    return out


def solve_shifted(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, least: float) -> np.ndarray:
    """(T - shift) y = right by elimination with row exchanges."""
    d = len(diagonal)
    a, b, c = (diagonal - shift).tolist(), off.tolist() + [0.0], [0.0] * d    # diagonal and two upper bands
    y = right.tolist()
    for k in range(d - 1):
        low, mid, up = float(off[k]), a[k + 1], b[k + 1]
        if abs(low) > abs(a[k]):
            factor = a[k] / low
            a[k], b[k], c[k], a[k + 1], b[k + 1] = low, mid, up, b[k] - factor * mid, c[k] - factor * up
            y[k], y[k + 1] = y[k + 1], y[k] - factor * y[k + 1]
        else:
            if abs(a[k]) < least:
                a[k] = least
            factor = low / a[k]
            a[k + 1], b[k + 1] = mid - factor * b[k], up - factor * c[k]
            y[k + 1] -= factor * y[k]
    for k in range(d - 1, -1, -1):
        s = y[k]
        if k + 1 < d:
            s -= b[k] * y[k + 1]
        if k + 2 < d:
            s -= c[k] * y[k + 2]
        y[k] = s / (a[k] if abs(a[k]) >= least else least)
        if abs(y[k]) > 1e150:                                     # keep the growth of a hit shift in range
            y[k:] = [v * 1e-150 for v in y[k:]]
            y[:k] = [v * 1e-150 for v in y[:k]]
    return np.array(y)


def vectors_of(diagonal: np.ndarray, off: np.ndarray, values: list[float]) -> np.ndarray:
    """Unit eigenvectors of the tridiagonal matrix, one a row, by inverse
    iteration; those of close eigenvalues are kept orthogonal."""
    d = len(diagonal)
    size = max(float(np.abs(diagonal).max(initial=0.0)), float(np.abs(off).max(initial=0.0)), 1e-300)
    least = EPS * size
    random = np.random.default_rng(12)
    out, shift, cluster = [], None, 0
    for k, value in enumerate(values):
        if k and values[k - 1] - value > 1e-3 * size:
            cluster = k
        # shifts of a cluster are kept apart by a few units in the last place
        shift = value if k == cluster or shift - value > 10 * least else shift - 10 * least
        y = random.standard_normal(d)
        for _ in range(6):
            y = solve_shifted(diagonal, off, shift, y / np.linalg.norm(y), least)
            y /= np.abs(y).max()
            for _ in range(2):
                for other in out[cluster:]:
                    y = y - (y @ other) * other
            y /= np.linalg.norm(y)
        out.append(y)
    return np.array(out).reshape(len(values), d)


def components_of(matrix: np.ndarray, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Leading eigenvalues (falling) and unit eigenvectors (rows) of a symmetric matrix."""
    diagonal, off, mirrors = tridiagonal(matrix)
    rows = vectors_of(diagonal, off, leading(diagonal, off, k))
    for at in range(len(mirrors) - 1, -1, -1):
        if (v := mirrors[at]) is not None:
            rows[:, at + 1:] -= 2.0 * np.outer(rows[:, at + 1:] @ v, v)
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    for row in rows:
        if row[np.abs(row).argmax()] < 0:
            row *= -1.0
    # the quotient of the finished vector is exact to the square of its error
    values = np.array([r @ matrix @ r for r in rows])
    return values, rows


# ---- the operator ----------------------------------------------------------------------

RESULT = "vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def fit(vectors: DataFrame, k: int = COMPONENTS) -> dict | None:
    """The whitening of the rows of ``usable``: size, n, sums, eigenvalues,
    components and trace; None without rows."""
    sums = (vectors.select("v").mapInArrow(totals, "size int, dim int, n long, total decimal(38,0)")
            .groupBy("size", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")))
    sizes = sums.where("dim = 0").orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    if not sizes:
        return None
    size, n = sizes[0]["size"], sizes[0]["n"]
    total = [int(r["total"]) for r in sums.where(F.col("size") == size).orderBy("dim").collect()]
    centre = [(2 * t + n) // (2 * n) for t in total]                       # the mean, rounded
    cells = (vectors.select("v").mapInArrow(products(size, centre), "i int, j int, s double")
             .groupBy("i", "j").agg(F.sum("s").alias("s")).collect())      # d * (d + 1) / 2 numbers
    matrix = np.zeros((size, size))
    for r in cells:
        matrix[r["i"], r["j"]] = matrix[r["j"], r["i"]] = r["s"]
    rest = np.array([(t - c * n) / n for t, c in zip(total, centre)])
    matrix = matrix / n - np.outer(rest, rest)
    values, rows = components_of(matrix, k)
    return {"size": size, "n": n, "sums": total, "values": values, "components": rows, "trace": float(np.trace(matrix)),
            "positive": [bool(v > size * EPS * max(values[0], 0.0)) for v in values]}


def identity_gap(table: DataFrame, which: list[int]) -> float | None:
    """Largest absolute entry of the whitened columns' covariance minus the identity."""
    pairs = [(a, b) for i, a in enumerate(which) for b in which[i:]]
    if not pairs:
        return None
    row = table.agg(*[F.covar_pop(F.col("w")[a], F.col("w")[b]).alias(f"c{a}_{b}") for a, b in pairs]).first()
    return max(abs(row[f"c{a}_{b}"] - (a == b)) for a, b in pairs)


def whiten(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error:
    one row for every usable row and component."""
    spark, rows = table.sparkSession, usable(table, vec_id, embedding)
    id_type = rows.schema["vec_id"].dataType.simpleString()
    model = fit(rows, k)
    if model is None:
        return spark.createDataFrame([], RESULT.format(id_type))
    count = len(model["values"])
    scale = np.array([1.0 / np.sqrt(v) if p else 0.0 for v, p in zip(model["values"], model["positive"])])
    run = projection(model["size"], model["n"], model["sums"], model["components"] * scale[:, None])
    done = store(rows.mapInArrow(run, f"vec_id {id_type}, deviation long, w array<double>"), "whitened")
    gap = identity_gap(done, [i for i in range(count) if model["positive"][i]])
    shares = [float(v) / model["trace"] if model["trace"] > 0 else None for v in model["values"]]
    facts = F.array(*[F.struct(F.lit(p).alias("positive"), F.lit(s).cast("double").alias("explained"))
                      for p, s in zip(model["positive"], shares)])
    return (done.select("vec_id", "deviation", F.posexplode("w").alias("at", "value"))
            .withColumn("fact", F.element_at(facts, F.col("at") + 1))
            .select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model["n"]).cast("long").alias("n"), "deviation",
                    F.when(F.col("fact.positive"), F.col("value")).alias("whitened"), F.col("fact.explained").alias("explained"),
                    F.lit(gap).cast("double").alias("identity_error")))
