"""Edit-aware token counts.

A document's pre-tokens (the pieces that a tokenizer never merges across) are
the leaves of a segment tree: a leaf has its length in characters and its
number of tokens, inner nodes have the sums.  An edit re-encodes only the
pre-tokens it touches plus boundary context: from the last pre-token whose
piece can't depend on the edit, on to the first place after the edit where the
new pieces fall into step with the old ones.  The tree gets the new leaves and
the sums on their path, nothing else.

A piece is decided by the text from its start to at most the end of the white
space that follows it plus one character (three characters for contractions).
So a restart is safe four characters before the edit with some other character
than white space between, and in-step pieces stay in step to the end.

Edits (start, deleted, inserted) are in code points and are applied in order,
each to the text that the one before has left; they are clipped to the text.

Defined cases: null text is empty and has no tokens; null or empty edits change
nothing; edits beyond the end append there; negative numbers count as 0;
repeated rows are counted each; an empty table gives no rows.
"""
from __future__ import annotations

import base64
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the pattern that splits text for the public byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CONTEXT = 4
CACHE = 400_000
LEAVES = 64  # pre-tokens in a leaf block of the tree


class Counter:
    """Tokens of a pre-token, remembered for the frequent ones."""

    def __init__(self, ranks: bytes, pattern: str = PATTERN):
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.encoding = tiktoken.Encoding("counter", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def one(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            n = len(self.encoding.encode_ordinary(piece))
            if len(self.known) >= CACHE:
                self.known.clear()
            if len(piece) <= 64:
                self.known[piece] = n
        return n

    def leaves(self, text: str) -> tuple[list[int], list[int]]:
        pieces = self.pattern.findall(text)
        known, one = self.known, self.one
        return [len(p) for p in pieces], [known[p] if p in known else one(p) for p in pieces]


class SegmentTree:
    """Sums of (length, tokens) over blocks of leaves; a block is a list of leaves."""

    def __init__(self, lengths: list[int], counts: list[int]):
        self.blocks = [[lengths[i:i + LEAVES], counts[i:i + LEAVES]] for i in range(0, len(lengths), LEAVES)] or [[[], []]]
        self._grow()

    def _grow(self) -> None:
        size = 1
        while size < len(self.blocks):
            size *= 2
        self.size = size
        self.length = [0] * (2 * size)
        self.tokens = [0] * (2 * size)
        for i, (a, b) in enumerate(self.blocks):
            self.length[size + i], self.tokens[size + i] = sum(a), sum(b)
        for i in range(size - 1, 0, -1):
            self.length[i] = self.length[2 * i] + self.length[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def n_leaves(self) -> int:
        return sum(len(a) for a, _ in self.blocks)

    def find(self, at: int) -> tuple[int, int, int]:
        """(block, leaf, start) of the leaf that holds character ``at``, by descent;
        past the end, the place after the last leaf."""
        if at >= self.length[1]:
            return len(self.blocks) - 1, len(self.blocks[-1][0]), self.length[1]
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if at >= start + self.length[node]:
                start += self.length[node]
                node += 1
        block = node - self.size
        ends = list(accumulate(self.blocks[block][0]))
        leaf = bisect_right(ends, at - start)
        return block, leaf, start + (ends[leaf - 1] if leaf else 0)

    def before(self, block: int, leaf: int, start: int) -> tuple[int, int, int]:
        """The leaf before (there is one when start > 0)."""
        while leaf == 0:
            block -= 1
            leaf = len(self.blocks[block][0])
        return block, leaf - 1, start - self.blocks[block][0][leaf - 1]

    def replace(self, first: tuple[int, int], last: tuple[int, int], lengths: list[int], counts: list[int]) -> None:
        """Leaves from ``first`` up to, not including, ``last`` become the given ones."""
        (b, i), (c, j) = first, last
        a_len = self.blocks[b][0][:i] + lengths + self.blocks[c][0][j:]
        a_cnt = self.blocks[b][1][:i] + counts + self.blocks[c][1][j:]
        if b == c and len(a_len) <= 2 * LEAVES:
            self.blocks[b] = [a_len, a_cnt]
            node = self.size + b
            self.length[node], self.tokens[node] = sum(a_len), sum(a_cnt)
            node //= 2
            while node:
                self.length[node] = self.length[2 * node] + self.length[2 * node + 1]
                self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]
                node //= 2
            return
        new = [[a_len[k:k + LEAVES], a_cnt[k:k + LEAVES]] for k in range(0, len(a_len), LEAVES)]
        self.blocks[b:c + 1] = new or [[[], []]]
        self._grow()

    def pack(self) -> bytes:
        flat = [np.array([x for block in self.blocks for x in block[k]], np.uint32) for k in (0, 1)]
        return np.stack(flat).tobytes()

    @staticmethod
    def unpack(data: bytes) -> "SegmentTree":
        lengths, counts = np.frombuffer(data, np.uint32).reshape(2, -1).tolist()
        return SegmentTree(lengths, counts)


def apply_edit(text: str, tree: SegmentTree, counter: Counter, start: int, deleted: int, inserted: str) -> tuple[str, int]:
    """(the new text, pre-tokens re-encoded); ``tree`` is changed in place."""
    start = min(max(start, 0), len(text))
    end = min(start + max(deleted, 0), len(text))
    new = text[:start] + inserted + text[end:]
    block, leaf, at = tree.find(max(start - 1, 0))
    while at > 0 and not (start - at >= CONTEXT and text[at:start - 1].strip()):
        block, leaf, at = tree.before(block, leaf, at)
    first = (block, leaf)
    shift = len(inserted) - (end - start)
    lengths, counts = [], []
    # The old leaves past the edit, walked in step with the new pieces.
    ob, ol, old = tree.find(end)
    if old < end and ol < len(tree.blocks[ob][0]):
        old += tree.blocks[ob][0][ol]
        ol += 1
    here, last = at, None
    n_old = len(text)

    def step():
        nonlocal ob, ol, old
        while ol >= len(tree.blocks[ob][0]) and ob + 1 < len(tree.blocks):
            ob, ol = ob + 1, 0
    step()
    for m in counter.pattern.finditer(new, at):
        while old + shift < here and old < n_old:
            old += tree.blocks[ob][0][ol]
            ol += 1
            step()
        if here == old + shift and here >= start + len(inserted) and old < n_old:
            last = (ob, ol)
            break
        lengths.append(len(m.group()))
        counts.append(counter.one(m.group()))
        here = m.end()
    if last is None:
        last = (len(tree.blocks) - 1, len(tree.blocks[-1][0]))
    tree.replace(first, last, lengths, counts)
    return new, len(lengths)


_COUNTERS: dict[int, Counter] = {}


def _counter(ranks) -> Counter:
    """One per Python worker."""
    if ranks.value and hash(ranks.value) not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[hash(ranks.value)] = Counter(ranks.value)
    return _COUNTERS[hash(ranks.value)]


def _ranks(docs: DataFrame, vocabulary: str):
    with open(vocabulary, "rb") as f:  # on the driver; executors get it by broadcast (about a megabyte)
        return docs.sparkSession.sparkContext.broadcast(f.read())


def count(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, text, tree, n_pretokens, n_tokens: the counted state of every row."""
    ranks = _ranks(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _counter(ranks)
        for big in batches:
            for i in range(0, big.num_rows, 500):
                b = big.slice(i, 500)
                trees, pre, tok = [], [], []
                for t in b.column(1).to_pylist():
                    lengths, counts = c.leaves(t or "")
                    trees.append(np.array([lengths, counts], np.uint32).tobytes())
                    pre.append(len(lengths))
                    tok.append(sum(counts))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(trees, pa.binary()), pa.array(pre, pa.int64()),
                                                  pa.array(tok, pa.int64())], names=["doc_id", "text", "tree", "n_pretokens", "n_tokens"])

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, "doc_id bigint, text string, tree binary, n_pretokens bigint, n_tokens bigint")


EDITS = "array<struct<start:int,deleted:int,inserted:string>>"


def edit(state: DataFrame, edits: str = "edits", vocabulary: str = VOCABULARY, with_state: bool = True) -> DataFrame:
    """The state after each row's ``edits`` (a column of ``state``, type EDITS):
    doc_id, n_edits, n_tokens_before, n_pretokens, n_tokens, n_reencoded and, ``with_state``,
    text and tree for the next edits."""
    ranks = _ranks(state, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _counter(ranks)
        for big in batches:
            for i in range(0, big.num_rows, 500):
                b = big.slice(i, 500)
                out = [[] for _ in range(7)]
                for t, packed, todo in zip(*(b.column(k).to_pylist() for k in (1, 2, 3))):
                    tree = SegmentTree.unpack(packed)
                    before, again, t = tree.total, 0, t or ""
                    for e in todo or []:
                        if e is None:
                            continue
                        t, n = apply_edit(t, tree, c, e["start"] or 0, e["deleted"] or 0, e["inserted"] or "")
                        again += n
                    for col, v in zip(out, (len(todo or []), before, tree.n_leaves(), tree.total, again, t, tree.pack() if with_state else b"")):
                        col.append(v)
                cols = [b.column(0)] + [pa.array(x, pa.int64()) for x in out[:5]]
                names = ["doc_id", "n_edits", "n_tokens_before", "n_pretokens", "n_tokens", "n_reencoded"]
                if with_state:
                    cols += [pa.array(out[5], pa.string()), pa.array(out[6], pa.binary())]
                    names += ["text", "tree"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return state.select("doc_id", "text", "tree", F.col(edits).cast(EDITS).alias("edits")).mapInArrow(
        run, "doc_id bigint, n_edits bigint, n_tokens_before bigint, n_pretokens bigint, n_tokens bigint, n_reencoded bigint"
             + (", text string, tree binary" if with_state else ""))


def review_edits(doc_id: Column, text: Column, per_chars: int = 4000) -> Column:
    """Edits of a text made from the text itself, one for each ``per_chars``
    characters begun: at a hashed place, a hashed number of characters is
    replaced by a piece of the text from another place."""
    n = F.char_length(F.coalesce(text, F.lit("")))
    draw = lambda i, what: F.pmod(F.xxhash64(F.lit(what), doc_id, i), F.greatest(n, F.lit(1)).cast("bigint")).cast("int")
    few = lambda i, what, most: F.pmod(F.xxhash64(F.lit(what), doc_id, i), F.lit(most)).cast("int")
    return F.transform(F.sequence(F.lit(1), F.floor(n / F.lit(per_chars)).cast("int") + 1), lambda i: F.struct(
        draw(i, "start").alias("start"), few(i, "deleted", 40).alias("deleted"),
        F.substring(F.coalesce(text, F.lit("")), draw(i, "from") + 1, few(i, "length", 40)).alias("inserted")))
