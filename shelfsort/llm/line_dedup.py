"""Line dedup by a range-partitioned sort of line hashes.

Every line becomes (hash of its key, document, position); a document is a
doc_id and a 64-bit tag of its text.  These are range
partitioned by (hash, document) and sorted inside the partition by (hash,
document, position), so one stream over a partition meets all lines of a key
together, first occurrence first.  Ranges split by document too, so a line
that a third of all documents carry covers many partitions: a run that touches
a partition's edge is completed from the edge runs of the other partitions, at
most two rows for each partition.

The stream sends back (document, position) of lines to drop only; each
document's lines are then kept or dropped by a bitmap (zlib), so texts move
only once, to meet their own bitmap.

Two rules.  ``min_docs`` given: keys found in at least so many documents lose
all their lines.  ``min_docs=None``: the first occurrence of each key stays, in
order of document and position, and later ones go.

Defined cases: a null or empty text is one empty line; a key of no code points
(a blank line) is never dropped; null doc_ids sort as smallest; rows repeating
a doc_id (or null) and text are one document, counted once, and keep the same
lines; rows of one doc_id (or null) with other texts are documents of their own,
in order of their tags; an empty table gives no rows.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsort.llm.common import WHITE_BYTES, materialise, partitions

NULL_ID = np.iinfo(np.int64).min


def line_key(line: bytes) -> bytes:
    """White space stripped at both ends, A-Z lower-cased."""
    return line.strip(WHITE_BYTES).lower()


def documents(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text, doc (the id, a number for null) and tag (of id and text)."""
    src = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return src.withColumn("doc", F.coalesce("doc_id", F.lit(NULL_ID))).withColumn("tag", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))


def line_rows(src: DataFrame) -> DataFrame:
    """h1, h2 (128-bit hash of the key), doc, tag, pos: one row per line of ``documents`` that has a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            h = np.frombuffer(b"".join(keys), dtype="<i8").reshape(-1, 2)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1])),
                 pa.array(np.repeat(np.array(ids, np.int64), counts)), pa.array(np.repeat(np.array(tags, np.int64), counts)),
                 pa.array(np.concatenate(places).astype(np.int32))],
                names=["h1", "h2", "doc", "tag", "pos"])

        for b in batches:
            keys, ids, tags, counts, places = [], [], [], [], []
            for doc, tag, t in zip(*(b.column(i).to_pylist() for i in range(3))):
                ks = [line_key(x) for x in (t or "").encode().split(b"\n")]
                at = [i for i, k in enumerate(ks) if k]
                if at:
                    keys += [xxhash.xxh3_128_digest(ks[i]) for i in at]
                    ids.append(doc)
                    tags.append(tag)
                    counts.append(len(at))
                    places.append(np.array(at))
                if len(keys) > 200_000:
                    yield out()
                    keys, ids, tags, counts, places = [], [], [], [], []
            if keys:
                yield out()

    return src.select("doc", "tag", "text").mapInArrow(run, "h1 bigint, h2 bigint, doc bigint, tag bigint, pos int")


def _changes(doc: np.ndarray) -> int:
    """Steps from one document to another in rows of (doc, tag)."""
    return int((doc[1:] != doc[:-1]).any(axis=1).sum())


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], np.ndarray, np.ndarray, bool]]:
    """Pieces of runs of equal (h1, h2): key, docs (rows of doc, tag), positions,
    whether the run goes on.  Memory is one batch, whatever the length of a run."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        h1, h2, doc, tag, pos = (b.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        doc = np.column_stack([doc, tag])
        cut = np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) + 1
        edges = np.concatenate([[0], cut, [len(h1)]])
        for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if last is not None:
                yield (*last, (int(h1[s]), int(h2[s])) == last[0])
            last = ((int(h1[s]), int(h2[s])), doc[s:e], pos[s:e])
    if last is not None:
        yield (*last, False)


def line_plan(src: DataFrame, min_docs: int | None = 10) -> DataFrame:
    """doc, tag, bitmap: for every one of ``documents`` that loses lines, the lines
    to keep (bit i of the little-endian bits is line i; zlib)."""
    spark = src.sparkSession
    n = partitions(spark)
    rows = materialise(line_rows(src))
    ranged = materialise(rows.repartitionByRange(n, "h1", "h2", "doc", "tag").sortWithinPartitions("h1", "h2", "doc", "tag", "pos")
                         .select("h1", "h2", "doc", "tag", "pos"))

    def edges(batches):
        """Of a partition's first and last run: documents in it, and the first and last document."""
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        found: list[list] = []
        for key, doc, pos, goes_on in _runs(batches):
            distinct = _changes(doc) + 1
            if found and found[-1][0] == key:
                r = found[-1]
                r[1] += distinct - (1 if r[3] == doc[0].tolist() else 0)
                r[3] = doc[-1].tolist()
            else:
                if len(found) == 2:
                    found[1] = None
                    found = [found[0]]
                found.append([key, distinct, doc[0].tolist(), doc[-1].tolist()])
        if found:
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([part] * len(found), pa.int32()), "h1": pa.array([r[0][0] for r in found], pa.int64()),
                "h2": pa.array([r[0][1] for r in found], pa.int64()), "n": pa.array([r[1] for r in found], pa.int64()),
                "lo": pa.array([r[2] for r in found], pa.list_(pa.int64())), "hi": pa.array([r[3] for r in found], pa.list_(pa.int64()))})

    # At most two rows for each partition.
    edge = ranged.mapInArrow(edges, "part int, h1 bigint, h2 bigint, n bigint, lo array<bigint>, hi array<bigint>").collect()
    totals: dict[tuple[int, int], list] = {}
    for r in sorted(edge, key=lambda r: (r.h1, r.h2, r.part)):
        t = totals.setdefault((r.h1, r.h2), [0, None, r.part])
        t[0] += r.n - (1 if t[1] == r.lo else 0)  # one document may end one partition and begin the next
        t[1] = r.hi
    shared = spark.sparkContext.broadcast({k: (t[0], t[2]) for k, t in totals.items()})

    def drops(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        docs_out, pos_out, size = [], [], 0

        def flush():
            d = np.concatenate(docs_out)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(d[:, 0])), pa.array(np.ascontiguousarray(d[:, 1])),
                                               pa.array(np.concatenate(pos_out).astype(np.int32))], names=["doc", "tag", "pos"])

        def pieces():
            """(docs, positions) of lines to drop."""
            if min_docs is None:
                before = first = None
                for key, doc, pos, _ in _runs(batches):
                    if key in shared.value and shared.value[key][1] != part:
                        yield doc, pos
                        continue
                    if key != before:
                        before, first = key, (doc[0], pos[0])
                    later = (doc != first[0]).any(axis=1) | (pos != first[1])  # copies of the first document keep the line too
                    yield doc[later], pos[later]
                return
            held, distinct, tail, over = [], 0, None, False
            for key, doc, pos, goes_on in _runs(batches):
                total = shared.value.get(key)
                if total is not None:
                    if total[0] >= min_docs:
                        yield doc, pos
                    continue
                distinct += _changes(doc) + (0 if tail == doc[0].tolist() else 1)
                tail = doc[-1].tolist()
                held.append((doc, pos))
                over = over or distinct >= min_docs
                if over:
                    yield from held
                    held = []
                if not goes_on:
                    held, distinct, tail, over = [], 0, None, False

        for d, p in pieces():
            if len(d):
                docs_out.append(d)
                pos_out.append(p)
                size += len(d)
                if size >= 200_000:
                    yield flush()
                    docs_out, pos_out, size = [], [], 0
        if size:
            yield flush()

    gone = ranged.mapInArrow(drops, "doc bigint, tag bigint, pos int")
    # One row per document; a document's lines are bounded by its own text, however often it is repeated.
    per_doc = gone.groupBy("doc", "tag").agg(F.collect_set("pos").alias("gone"))

    def bitmaps(batches):
        for b in batches:
            maps = []
            for at in b.column(2).to_pylist():
                bits = np.ones(max(at) // 8 * 8 + 8, np.uint8)
                bits[at] = 0
                maps.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(maps, pa.binary())], names=["doc", "tag", "bitmap"])

    return per_doc.mapInArrow(bitmaps, "doc bigint, tag bigint, bitmap binary")


def kept_lines(text: bytes, bitmap: bytes | None) -> tuple[list[bytes], int]:
    """(lines that stay, number of lines); lines past the bitmap stay."""
    lines = text.split(b"\n")
    if bitmap is None:
        return lines, len(lines)
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little")[:len(lines)]
    gone = set(np.flatnonzero(bits == 0).tolist())
    return [x for i, x in enumerate(lines) if i not in gone], len(lines)


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int | None = 10,
               with_text: bool = False) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256, bitmap (null: all lines stay)
    and, ``with_text``, the text that is left: one row per row of ``docs``."""
    import hashlib
    src = documents(docs, doc_id, text)
    both = src.join(line_plan(src, min_docs), ["doc", "tag"], "left").select("doc_id", "text", "bitmap")

    def run(batches):
        for b in batches:
            n, gone, sha, left = [], [], [], []
            for t, m in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                lines, total = kept_lines((t or "").encode(), m)
                joined = b"\n".join(lines)
                n.append(total)
                gone.append(total - len(lines))
                sha.append(hashlib.sha256(joined).hexdigest())
                if with_text:
                    left.append(joined.decode())
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), b.column(2)]
            names = ["doc_id", "n_lines", "n_dropped", "kept_sha256", "bitmap"]
            if with_text:
                cols.append(pa.array(left, pa.string()))
                names.append("text")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return both.mapInArrow(run, "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string, bitmap binary"
                           + (", text string" if with_text else ""))
