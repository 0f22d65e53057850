"""Exact dedup over a sharded cuckoo-filter index.

Digests (SHA-256 of the text without white space) are dealt to shards by
their own bits.  Each shard holds a cuckoo filter and the content behind it:
the stored digests with their group's size and best row.  A digest that the
filter has not seen is inserted; a hit is verified against the stored content,
so a fingerprint clash never merges two texts.  When an insertion finds no free
slot, the filter doubles and is rebuilt from the stored keys.  Digests are
deleted by removing one of their fingerprints, so the index follows a live
corpus.

Copies are combined inside each map task before the shuffle, so a text that
fills a third of the corpus reaches its shard as one row per task.

Defined cases: null text equals the empty text, and texts of white space only
equal it too.  Ties on length go to the smallest doc_id, a null doc_id last.
Rows that repeat doc_id and text count as copies and exactly one is kept.
An empty table gives an empty result.  Other input columns are ignored.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsort.llm.common import WHITE_BYTES, join_hot, materialise

SLOTS = 4
MAX_KICKS = 200
NO_ID = np.iinfo(np.int64).max  # stands for a null doc_id: sorts last


class CuckooFilter:
    """Partial-key cuckoo filter: 16-bit fingerprints, buckets of four slots."""

    def __init__(self, log2_buckets: int = 10, table: np.ndarray | None = None):
        self.log2 = log2_buckets
        self.mask = (1 << log2_buckets) - 1
        self.table = np.zeros((1 << log2_buckets, SLOTS), np.uint16) if table is None else table
        self.turn = 0

    def places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[8:10], "little") or 1
        one = int.from_bytes(digest[10:16], "little") & self.mask
        return mark, one, self.other(one, mark)

    def other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995 >> 7)) & self.mask

    def __contains__(self, digest: bytes) -> bool:
        mark, one, two = self.places(digest)
        return mark in self.table[one] or mark in self.table[two]

    def _put(self, bucket: int, mark: int) -> bool:
        row = self.table[bucket]
        for i in range(SLOTS):
            if row[i] == 0:
                row[i] = mark
                return True
        return False

    def insert(self, digest: bytes) -> bool:
        """False when the filter is full; the caller then resizes from its keys."""
        mark, one, two = self.places(digest)
        if self._put(one, mark) or self._put(two, mark):
            return True
        at = two
        for _ in range(MAX_KICKS):
            self.turn = (self.turn + 1) % SLOTS
            mark, self.table[at, self.turn] = int(self.table[at, self.turn]), mark
            at = self.other(at, mark)
            if self._put(at, mark):
                return True
        return False

    def delete(self, digest: bytes) -> bool:
        mark, one, two = self.places(digest)
        for at in (one, two):
            for i in range(SLOTS):
                if self.table[at, i] == mark:
                    self.table[at, i] = 0
                    return True
        return False


class Shard:
    """A filter and the stored content it guards: digest -> [size, best length, best id, best row]."""

    def __init__(self, content: dict[bytes, list[int]] | None = None, filter: CuckooFilter | None = None):
        self.content = content or {}
        self.filter = filter
        self.resizes = 0
        if filter is None:
            self.filter = CuckooFilter(max(4, (len(self.content) // 3).bit_length()))
            if self.content:
                self._rebuild(self.filter.log2)

    def _rebuild(self, log2: int) -> None:
        while True:
            bigger = CuckooFilter(log2)
            if all(bigger.insert(k) for k in self.content):
                self.filter = bigger
                return
            log2 += 1

    def add(self, digest: bytes, size: int, length: int, doc: int, row: int) -> None:
        if digest in self.filter:
            entry = self.content.get(digest)  # verify the hit
            if entry is not None:
                entry[0] += size
                if (-length, doc, row) < (-entry[1], entry[2], entry[3]):
                    entry[1:] = length, doc, row
                return
        self.content[digest] = [size, length, doc, row]
        if not self.filter.insert(digest):
            self.resizes += 1
            self._rebuild(self.filter.log2 + 1)

    def remove(self, digest: bytes, size: int) -> bool:
        """Take ``size`` copies out; the last one takes the digest out of the filter."""
        if digest not in self.filter:
            return False
        entry = self.content.get(digest)
        if entry is None:
            return False
        entry[0] -= size
        if entry[0] <= 0:
            del self.content[digest]
            self.filter.delete(digest)
        return True

    def row(self, shard: int) -> pd.DataFrame:
        return pd.DataFrame({
            "shard": [shard], "log2_buckets": [self.filter.log2], "marks": [self.filter.table.tobytes()],
            "keys": [b"".join(self.content)],
            "entries": [np.array(list(self.content.values()), np.int64).reshape(-1, 4).tobytes()]})

    @staticmethod
    def of(frame: pd.DataFrame) -> "Shard":
        if not len(frame):
            return Shard()
        r = frame.iloc[0]
        e = np.frombuffer(r["entries"], np.int64).reshape(-1, 4).tolist()
        keys = r["keys"]
        log2 = int(r["log2_buckets"])
        marks = np.frombuffer(r["marks"], np.uint16).reshape(1 << log2, SLOTS).copy()
        return Shard({keys[32 * i:32 * i + 32]: x for i, x in enumerate(e)}, CuckooFilter(log2, marks))


INDEX_SCHEMA = "shard int, log2_buckets int, marks binary, keys binary, entries binary"


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, digest (32 bytes), n_points, row: one row per row of ``docs``.

    ``row`` tells repeated rows apart; it holds once the frame is materialised."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got, points = [], []
            for t in b.column(1).to_pylist():
                t = t or ""
                got.append(hashlib.sha256(t.encode().translate(None, WHITE_BYTES)).digest())
                points.append(len(t))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.binary()), pa.array(points, pa.int64())],
                                             names=["doc_id", "digest", "n_points"])

    return (docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
            .mapInArrow(run, "doc_id bigint, digest binary, n_points bigint")
            .withColumn("row", F.monotonically_increasing_id()))


def _combined(rows: DataFrame, shards: int) -> DataFrame:
    """Copies inside one task become one row: digest, size, length, doc, shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list[int]] = {}

        def out():
            k = list(seen)
            v = np.array(list(seen.values()), np.int64).reshape(-1, 4)
            return pa.RecordBatch.from_arrays(
                [pa.array([int.from_bytes(x[:8], "little") % shards for x in k], pa.int32()), pa.array(k, pa.binary()),
                 *(pa.array(v[:, i]) for i in range(4))], names=["shard", "digest", "size", "length", "doc", "row"])

        for b in batches:
            for doc, digest, n, row in zip(*(b.column(i).to_pylist() for i in range(4))):
                doc = NO_ID if doc is None else doc
                e = seen.get(digest)
                if e is None:
                    seen[digest] = [1, n, doc, row]
                else:
                    e[0] += 1
                    if (-n, doc, row) < (-e[1], e[2], e[3]):
                        e[1:] = n, doc, row
            if len(seen) >= 200_000:
                yield out()
                seen.clear()
        if seen:
            yield out()

    return rows.mapInArrow(run, "shard int, digest binary, size bigint, length bigint, doc bigint, row bigint")


def shard_count(rows: int, per_shard: int = 50_000) -> int:
    return max(1, min(1 << 20, -(-rows // per_shard)))


def _entries(frame: pd.DataFrame):
    return zip(map(bytes, frame["digest"]), *(frame[c].tolist() for c in ("size", "length", "doc", "row")))


def insert(index: DataFrame | None, rows: DataFrame, shards: int) -> DataFrame:
    """The index after inserting ``rows`` (as from ``digests``)."""
    new = _combined(rows, shards)
    if index is None:
        def build(key, frame: pd.DataFrame) -> pd.DataFrame:
            s = Shard()
            for x in _entries(frame):
                s.add(*x)
            return s.row(int(key[0]))
        return new.groupBy("shard").applyInPandas(build, INDEX_SCHEMA)

    def more(key, old: pd.DataFrame, frame: pd.DataFrame) -> pd.DataFrame:
        s = Shard.of(old)
        for x in _entries(frame):
            s.add(*x)
        return s.row(int(key[0]))
    return index.groupBy("shard").cogroup(new.groupBy("shard")).applyInPandas(more, INDEX_SCHEMA)


def delete(index: DataFrame, rows: DataFrame, shards: int) -> DataFrame:
    """The index after deleting ``rows`` (as from ``digests``).  A group's best
    row stays as recorded until the group is empty."""

    def less(key, old: pd.DataFrame, frame: pd.DataFrame) -> pd.DataFrame:
        s = Shard.of(old)
        for d, n in zip(frame["digest"], frame["size"]):
            s.remove(bytes(d), int(n))
        return s.row(int(key[0]))
    return index.groupBy("shard").cogroup(_combined(rows, shards).groupBy("shard")).applyInPandas(less, INDEX_SCHEMA)


def groups(index: DataFrame) -> DataFrame:
    """digest, group_size, keep_id, keep_row of every stored digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for keys, entries in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                e = np.frombuffer(entries, np.int64).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([keys[i:i + 32] for i in range(0, len(keys), 32)], pa.binary()), pa.array(e[:, 0]),
                     pa.array(e[:, 2], mask=e[:, 2] == NO_ID), pa.array(e[:, 3])],
                    names=["digest", "group_size", "keep_id", "keep_row"])

    return index.select("keys", "entries").mapInArrow(run, "digest binary, group_size bigint, keep_id bigint, keep_row bigint")


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_points: one row per row of ``docs``."""
    rows = materialise(digests(docs, doc_id, text))
    total = rows.count()
    found = materialise(groups(insert(None, rows, shard_count(total))))
    out = join_hot(rows, found.where("group_size > 1"), "digest", "group_size", total, F.col("row"))
    return out.select(
        "doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        (F.col("group_size").isNull() | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), "n_points")
