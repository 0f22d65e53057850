"""N-gram Jaccard join by T-occurrence search.

A document's set holds the hashes (64 bits) of its distinct five-word shingles.
Two sets of n and m members have Jaccard similarity >= 0.75 exactly when they
share T = ceil(0.75 (n + m) / 1.75) of them.

1. Equal sets become one node, named by a fingerprint of the set.
2. Shingles are counted over all nodes: tasks deal sorted runs of (shingle,
   node) by hash range; a range's task finds the shingles that two nodes or more
   have (their inverted lists).  Shingles of a single node are never moved again.
3. Lists are ordered by length, short ones first.  A node of n shingles looks
   into its n - ceil(0.75 n) + 1 shortest lists only: all others together are
   fewer than the overlap that every partner must reach, so each linked pair
   meets in one of these.
4. Nodes that meet, by a path, form a block: a short list pairs its members
   under the length and positional bounds, a long one links them as a tree, so
   no list is expanded into all its pairs.
5. Inside a block a DivideSkip search answers one query per node: the short
   inverted lists are merged with counts, candidates below T - L go, and the L
   long lists are probed by binary search.  Nodes already in one component are
   not compared again.
6. A block larger than ``piece`` nodes (or the shingles that a task can hold)
   is searched in random pieces.  Nodes
   outside the block's largest component are then searched against every piece,
   so no link between components is missed.

Links become components by checkpointed rounds on Spark.

Defined cases: null, empty and blank texts have no shingles and link with
nothing, not even with each other; a text of one to four words is one shingle;
the smallest doc_id names a component, a null doc_id only where there is no
other; repeated rows are copies; an empty table gives no rows.
"""
from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsort.llm.common import join_hot, materialise, partitions
from shelfsort.llm.components import components
from shelfsort.llm.hashing import U64, mix64, shingle_sets
from shelfsort.llm.lm import pack, unpack

NUM, DEN = 3, 4  # similarity 0.75
NO_ID = (1 << 63) - 1
BLOCK_SHINGLES = 1_000_000
RANGE_SHINGLES = 4_000_000
PAIR_LIST = 16  # longer lists link their members as a tree
PIECE, PIECE_SHINGLES = 4096, 4_000_000  # most nodes and (about) shingles of a block searched by one task
SIEVE = 1 << 20


def node_of(s: np.ndarray) -> int:
    """Signed 64-bit fingerprint of a set of shingles."""
    with np.errstate(over="ignore"):
        x = mix64(s).sum(dtype=np.uint64) + U64(len(s)) * U64(0xD6E8FEB86659FD93)
    return int(mix64([x]).view(np.int64)[0])


def _sets(b: pa.RecordBatch, column: int, words: int, step: int = 500):
    for at in range(0, b.num_rows, step):
        part = b.slice(at, step)
        yield part, shingle_sets(part.column(column), words)


def _source(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NO_ID)).alias("doc"), F.col(text).cast("string").alias("text"))


def nodes(src: DataFrame, words: int) -> DataFrame:
    """doc, n, node: one row per document."""

    def run(batches):
        for big in batches:
            for b, sets in _sets(big, 1, words):
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) for s in sets], pa.int64())],
                    names=["doc", "n", "node"])

    return src.mapInArrow(run, "doc bigint, n bigint, node bigint")


def _cuts(keys: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """(part, start, end) of sorted keys by equal hash ranges."""
    step = (1 << 64) // parts + 1
    cut = np.searchsorted(keys, np.array([step * i for i in range(1, parts)], dtype=np.uint64)) if parts > 1 else np.zeros(0, np.int64)
    edge = [0, *cut.tolist(), len(keys)]
    return [(r, s, e) for r, (s, e) in enumerate(zip(edge[:-1], edge[1:])) if e > s]


RUN = "part int, keys binary, owner binary, node binary, size binary"


def runs(src: DataFrame, words: int, parts: int) -> DataFrame:
    """Sorted runs of (shingle, node) by hash range; a task sends a node once."""

    def run(batches):
        seen: set[int] = set()
        sets, ids, total = [], [], 0

        def out():
            keys = np.concatenate(sets)
            size = np.array([len(s) for s in sets], np.uint32)
            owner = np.repeat(np.arange(len(sets), dtype=np.uint32), size)
            order = np.argsort(keys)
            keys, owner = keys[order], owner[order]
            node = np.array(ids, np.int64)
            cols = [[], [], [], [], []]
            for r, s, e in _cuts(keys, parts):
                used, at = np.unique(owner[s:e], return_inverse=True)
                for c, v in zip(cols, (r, pack(keys[s:e]), pack(at.astype(np.uint32)), pack(node[used]), pack(size[used]))):
                    c.append(v)
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32())] + [pa.array(c, pa.binary()) for c in cols[1:]],
                                              names=["part", "keys", "owner", "node", "size"])

        for big in batches:
            for _, got in _sets(big, 0, words):
                for s in got:
                    if len(s) and (x := node_of(s)) not in seen:
                        seen.add(x)
                        sets.append(s)
                        ids.append(x)
                        total += len(s)
                if total >= BLOCK_SHINGLES:
                    yield out()
                    sets, ids, total = [], [], 0
            if len(seen) > 200_000:
                seen.clear()
        if sets:
            yield out()

    return src.select("text").mapInArrow(run, RUN)


SHARED = "part int, node binary, size binary, count binary, keys binary, df binary"


def shared(sorted_runs: DataFrame, parts: int) -> DataFrame:
    """Shingles of two nodes or more, gathered by node: by node range, (node,
    size, its shared shingles with their list lengths)."""

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([unpack(x, np.uint64) for x in frame["keys"]])
        node, size = [], []
        for o, n, s in zip(frame["owner"], frame["node"], frame["size"]):
            at = unpack(o, np.uint32)
            node.append(unpack(n, np.int64)[at])
            size.append(unpack(s, np.uint32)[at])
        node, size = np.concatenate(node), np.concatenate(size)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        same = keys[1:] == keys[:-1]
        pick = np.zeros(len(keys), bool)
        pick[1:] |= same
        pick[:-1] |= same
        order, keys = order[pick], keys[pick]
        node, size = node[order], size[order]
        order = np.lexsort((node, keys))  # a node that several tasks sent counts once
        keys, node, size = keys[order], node[order], size[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (node[1:] != node[:-1])
        keys, node, size = keys[new], node[new], size[new]
        _, inverse, df = np.unique(keys, return_inverse=True, return_counts=True)
        df = df[inverse]
        many = df > 1
        keys, node, size, df = keys[many], node[many], size[many], df[many]
        order = np.lexsort((keys, node.view(np.uint64)))
        keys, node, size, df = keys[order], node[order].view(np.uint64), size[order], df[order]
        out = []
        for r, s, e in _cuts(node, parts):
            u, first, count = np.unique(node[s:e], return_index=True, return_counts=True)
            out.append((r, pack(u), pack(size[s:e][first]), pack(count.astype(np.uint32)), pack(keys[s:e]), pack(df[s:e].astype(np.uint64))))
        return pd.DataFrame(out, columns=["part", "node", "size", "count", "keys", "df"])

    return sorted_runs.groupBy("part").applyInPandas(run, SHARED)


POSTING = "part int, keys binary, node binary, size binary, place binary"


def prefixes(found: DataFrame, parts: int) -> DataFrame:
    """Each node's entries in its shortest lists, by hash range."""

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        node = np.concatenate([np.repeat(unpack(n, np.uint64), unpack(c, np.uint32)) for n, c in zip(frame["node"], frame["count"])])
        size = np.concatenate([np.repeat(unpack(n, np.uint32), unpack(c, np.uint32)) for n, c in zip(frame["size"], frame["count"])]).astype(np.int64)
        keys = np.concatenate([unpack(x, np.uint64) for x in frame["keys"]])
        df = np.concatenate([unpack(x, np.uint64) for x in frame["df"]])
        order = np.lexsort((keys, df, node))
        node, size, keys = node[order], size[order], keys[order]
        edge = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, np.int64)
        count = np.diff(np.append(edge, len(node)))
        rank = np.arange(len(node)) - np.repeat(edge, count)
        alone = size - np.repeat(count, count)  # shingles of this node only come first in the order
        prefix = size - -(-NUM * size // DEN) + 1
        place = alone + rank
        keep = place < prefix
        node, size, keys, place = node[keep], size[keep], keys[keep], place[keep]
        order = np.argsort(keys, kind="stable")
        node, size, keys, place = node[order], size[order], keys[order], place[order]
        return pd.DataFrame([(r, pack(keys[s:e]), pack(node[s:e]), pack(size[s:e].astype(np.uint32)), pack(place[s:e].astype(np.uint32)))
                             for r, s, e in _cuts(keys, parts)], columns=["part", "keys", "node", "size", "place"])

    return found.groupBy("part").applyInPandas(run, POSTING)


def least_overlap(n, m):
    """Shingles that sets of n and m members must share: ceil(0.75 (n + m) / 1.75)."""
    return -(-NUM * (n + m) // (NUM + DEN))


def meetings(postings: DataFrame) -> DataFrame:
    """Edges (a, b) between nodes that meet in a list."""

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([unpack(x, np.uint64) for x in frame["keys"]])
        node = np.concatenate([unpack(x, np.uint64) for x in frame["node"]]).view(np.int64)
        size = np.concatenate([unpack(x, np.uint32) for x in frame["size"]]).astype(np.int64)
        place = np.concatenate([unpack(x, np.uint32) for x in frame["place"]]).astype(np.int64)
        order = np.lexsort((node, keys))
        keys, node, size, place = keys[order], node[order], size[order], place[order]
        edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        length = np.diff(np.append(edge, len(keys)))
        a, b = [], []
        for n in range(2, PAIR_LIST + 1):
            start = edge[length == n]
            if len(start):
                i, j = np.triu_indices(n, 1)
                i, j = (start[:, None] + i).ravel(), (start[:, None] + j).ravel()
                least = least_overlap(size[i], size[j])
                ok = (1 + np.minimum(size[i] - place[i], size[j] - place[j]) - 1 >= least) & (np.minimum(size[i], size[j]) >= least)
                a.append(node[i[ok]])
                b.append(node[j[ok]])
        for start, n in zip(edge[length > PAIR_LIST].tolist(), length[length > PAIR_LIST].tolist()):
            i = np.arange(1, n)
            a.append(node[start + (i - 1) // PAIR_LIST])
            b.append(node[start + i])
        if not a:
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        return spanning(np.concatenate(a), np.concatenate(b))

    return postings.groupBy("part").applyInPandas(run, "a bigint, b bigint")


def spanning(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """Edges (a, b) that join the same nodes: from the smallest node of each
    component to its others, so at most one edge for each node of the task."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    forest = Forest(len(node))
    pair = np.unique(np.sort(at.reshape(2, -1).T, axis=1), axis=0)
    for x, y in pair.tolist():
        forest.join(x, y)
    root = np.fromiter((forest.root(i) for i in range(len(node))), np.int64, len(node))
    other = root != np.arange(len(node))
    return pd.DataFrame({"a": node[root[other]], "b": node[other]})


class Forest:
    """Union-find over 0..n-1; a root is its component's smallest."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def merge_counts(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Members of sorted lists with their numbers of occurrences: a heap merge
    for few entries, the same merge by one sort for many."""
    total = sum(map(len, lists))
    if total > 64:
        return np.unique(np.concatenate(lists), return_counts=True)
    member, count = [], []
    for x in heapq.merge(*(x.tolist() for x in lists)):
        if member and member[-1] == x:
            count[-1] += 1
        else:
            member.append(x)
            count.append(1)
    return np.array(member, np.int64), np.array(count, np.int64)


class Index:
    """Inverted lists of a piece's sets, searched by DivideSkip."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        token = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), self.size)
        order = np.argsort(token, kind="stable")  # owners stay in order inside a list
        self.owner = owner[order]
        self.token, start = np.unique(token[order], return_index=True)
        self.edge = np.append(start, len(token))

    def search(self, q: np.ndarray, allowed) -> np.ndarray:
        """Members whose Jaccard similarity with ``q`` is >= 0.75, among those that
        ``allowed`` (a function of an array of members) lets through."""
        n = len(q)
        at = np.searchsorted(self.token, q)
        at[at == len(self.token)] = 0
        at = at[self.token[at] == q] if len(self.token) else at[:0]
        least = -(-NUM * n // DEN)  # the smallest overlap with any partner
        if len(at) < least:
            return np.zeros(0, np.int64)
        start, end = self.edge[at], self.edge[at + 1]
        order = np.argsort(end - start, kind="stable")
        start, end = start[order], end[order]
        # A list is long when probing it costs less than merging it; at most
        # least - 1 lists may be, so that a candidate shows in a short one.
        n_long = min(least - 1, len(at) - (len(at) - least + 1))
        short = len(at) - n_long
        member, count = merge_counts([self.owner[s:e] for s, e in zip(start[:short], end[:short])])
        ok = count >= least - n_long
        ok &= allowed(member)
        member, count = member[ok], count[ok]
        need = least_overlap(n, self.size[member])
        for i, (s, e) in enumerate(zip(start[short:], end[short:])):
            if not len(member):
                break
            x = self.owner[s:e]
            p = np.searchsorted(x, member)
            p[p == len(x)] = 0
            count += x[p] == member
            live = count + (n_long - 1 - i) >= need
            if not live.all():
                member, count, need = member[live], count[live], need[live]
        return member[count >= need]


def _links(node: list[int], sets: list[np.ndarray], label: list[int], queries: int | None = None):
    """Edges (a, b) that join components: every node is a query against the
    members before it; with ``queries``, the first so many nodes are queries
    against the others.  Nodes of equal ``label`` are known to be joined."""
    forest = Forest(len(node))
    first: dict[int, int] = {}
    for i, x in enumerate(label):
        if x in first:
            forest.join(first[x], i)
        else:
            first[x] = i
    base = 0 if queries is None else queries
    index = Index(sets[base:])
    a, b, degree = [], [], 0
    for i in range(len(node) if queries is None else queries):
        def allowed(member: np.ndarray, i=i) -> np.ndarray:
            r = forest.root(i)
            ok = member + base < i if queries is None else np.ones(len(member), bool)
            return ok & np.fromiter((forest.root(m + base) != r for m in member.tolist()), bool, len(member))
        for m in index.search(sets[i], allowed).tolist():
            if forest.join(i, m + base):
                a.append(node[i])
                b.append(node[m + base])
    return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def fetch_sets(src: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """node, keys (packed set) with the columns of ``wanted`` (doc, node, ...).

    Texts of other documents are sieved out before the shuffle by a table of
    hashes of the wanted ids modulo 2**20, so at most 2**20 rows are broadcast."""
    sieve = wanted.select(F.pmod(F.xxhash64("doc"), F.lit(SIEVE)).alias("h")).distinct()
    few = src.withColumn("h", F.pmod(F.xxhash64("doc"), F.lit(SIEVE))).join(F.broadcast(sieve), "h", "left_semi").drop("h")

    def run(batches):
        for big in batches:
            for b, sets in _sets(big, 1, words):
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([node_of(s) for s in sets], pa.int64()), pa.array([pack(s) for s in sets], pa.binary())],
                    names=["doc", "node", "keys"])

    texts = few.join(wanted.select("doc").distinct(), "doc", "left_semi").dropDuplicates(["doc", "text"])
    got = texts.select("doc", "text").mapInArrow(run, "doc bigint, node bigint, keys binary")
    return got.join(wanted, ["doc", "node"]).dropDuplicates(["node"])


def links(src: DataFrame, classes: DataFrame, words: int, total_shingles: int, piece: int = PIECE) -> DataFrame:
    """Edges (a, b) that span the components of the similarity graph of nodes."""
    spark = src.sparkSession
    parts = max(1, -(-total_shingles // RANGE_SHINGLES))
    tasks = max(parts, partitions(spark))
    found = shared(runs(src, words, parts).repartition(tasks, "part"), parts).repartition(tasks, "part")
    met = materialise(meetings(prefixes(found, parts).repartition(tasks, "part")).distinct())
    block = components(met)
    named = block.join(classes.select("node", "doc", "n"), "node")
    sizes = named.groupBy("label").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / F.lit(piece)), F.ceil(F.sum("n") / F.lit(PIECE_SHINGLES))).cast("bigint").alias("pieces"))
    member = materialise(named.join(sizes, "label").select(
        "doc", "node", F.col("label").alias("block"), "pieces", F.pmod(F.xxhash64("node"), F.col("pieces")).alias("piece")))
    sets = fetch_sets(src, member, words)
    large = member.where("pieces > 1").limit(1).count() > 0
    if large:
        sets = materialise(sets)

    def inside(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node")
        node = frame["node"].tolist()
        return _links(node, [unpack(x, np.uint64) for x in frame["keys"]], list(range(len(node))))

    found = materialise(sets.select("block", "piece", "node", "keys").groupBy("block", "piece").applyInPandas(inside, "a bigint, b bigint"))
    if not large:
        return found

    big = sets.where("pieces > 1")
    across_schema = "a bigint, b bigint"

    def across(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Queries of the left against a piece on the right."""
        left, right = left.sort_values("node"), right.sort_values("node")
        node = left["node"].tolist() + right["node"].tolist()
        if not len(left) or not len(right):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        return _links(node, [unpack(x, np.uint64) for x in [*left["keys"], *right["keys"]]],
                      left["label"].tolist() + right["label"].tolist(), len(left))

    def labelled(edges: DataFrame) -> DataFrame:
        lab = components(edges)
        return materialise(big.join(lab, "node", "left").withColumn("label", F.coalesce("label", "node")))

    def ask_all(queries: DataFrame, everyone: DataFrame) -> DataFrame:
        pieces = F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1)
        # Queries of a piece's task are dealt out too, so their number does not grow with the block.
        q = queries.withColumn("to", F.explode(pieces)).where("to <> piece").select(
            "block", F.col("to").alias("piece"), "node", "keys", "label", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(4)).alias("deal"))
        q = q.toDF(*q.columns)  # columns of its own, as both sides come from one frame
        e = everyone.withColumn("deal", F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(4)])))
        return (q.groupBy("block", "piece", "deal")
                .cogroup(e.select("block", "piece", "node", "keys", "label", "deal").groupBy("block", "piece", "deal"))
                .applyInPandas(across, across_schema))

    # A few nodes of the first pieces join the pieces' large components.
    now = labelled(found)
    hubs = now.where(f"piece < 4 and pmod(xxhash64(node, 2), {piece}) < 16")
    found = materialise(found.unionByName(ask_all(hubs, now)))
    now = labelled(found)
    largest = (now.groupBy("block", "label").agg(F.count(F.lit(1)).alias("n"))
               .groupBy("block").agg(F.max(F.struct("n", "label")).alias("top")).select("block", F.col("top.label").alias("top")))
    rest = now.join(largest, "block").where("label <> top").drop("top")
    return materialise(found.unionByName(ask_all(rest, now)))


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, piece: int = PIECE) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of ``docs``."""
    src = _source(docs, doc_id, text)
    table = materialise(nodes(src, words))
    total, shingles = table.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()  # two numbers
    classes = materialise(table.where("n > 0").groupBy("node").agg(
        F.min("doc").alias("doc"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n")))
    label = components(links(src, classes, words, shingles, piece))
    named = classes.drop("n").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("doc").alias("component"))
    of_node = materialise(named.join(least, "label").select("node", "component", "copies"))
    out = join_hot(table, of_node, "node", "copies", total, F.col("doc"))
    null = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc"))
    return out.withColumn("component", component).select(
        null("doc").alias("doc_id"), F.col("n").alias("n_shingles"), null("component").alias("component_id"))
