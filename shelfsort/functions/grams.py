"""Counting character grams of whole texts inside a task (T5).

The JVM lower-cases a text and joins its words by single spaces; here a text is
a row of code points, and a gram is a window of 2 to 4 of them without a space
in its interior.  Windows of all texts of a step are packed into 64-bit numbers
(text, characters) and sorted, so equal grams of a text lie together and their
number is the length of the run.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

STEP_CHARS = 1 << 20      # code points whose windows are sorted at once


class Grams:
    """Grams of the texts of a step: entry i says that text ``owner[i]`` holds
    gram ``gram[i]`` ``cnt[i]`` times; ``names`` are the distinct grams."""

    def __init__(self, owner: np.ndarray, gram: np.ndarray, cnt: np.ndarray, names: list):
        self.owner, self.gram, self.cnt, self.names = owner, gram, cnt, names


def _runs(a: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers of ``a``, sorted, and how often each is there (or the sum of ``n``)."""
    if n is None:
        a = np.sort(a)
    else:
        order = np.argsort(a, kind="stable")
        a, n = a[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.empty(0, np.int64)
    return a[first], np.diff(np.append(first, len(a))) if n is None else np.add.reduceat(n, first) if len(a) else n


def count_grams(texts: list[str]) -> Grams:
    """``texts``: words joined by single spaces."""
    codes = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    alphabet = np.unique(codes)
    bits = int(len(alphabet)).bit_length()
    if 4 * bits + len(texts).bit_length() > 64:
        return _one_by_one(texts)
    number = np.zeros(int(alphabet[-1]) + 1, np.uint64)
    number[alphabet] = np.arange(1, len(alphabet) + 1, dtype=np.uint64)
    # place 0 is the space before the first text; a text owns the space after it
    belongs = np.repeat(np.arange(len(texts) + 1, dtype=np.uint32), [1, *(len(t) + 1 for t in texts)] if texts else [2])
    found = []
    for at in range(0, len(codes), STEP_CHARS):
        part = codes[at:at + STEP_CHARS + 3]                     # windows that start in this step
        char = number[part]
        space = part == 32
        last = min(STEP_CHARS, len(part))
        owner = belongs[at:at + len(part)]
        for n in (2, 3, 4):
            m = min(last, len(part) - n + 1)
            if m <= 0:
                continue
            whole = ~space[1:1 + m] if n > 2 else ~(space[:m] & space[1:1 + m])
            if n == 4:
                whole &= ~space[2:2 + m]
            p = np.flatnonzero(whole)
            key = owner[p + space[p]].astype(np.uint64) - np.uint64(1)   # texts are numbered from 1 here
            for k in range(4):
                key = key << np.uint64(bits) | (char[p + k] if k < n else np.uint64(0))
            found.append(_runs(key))
    keys, cnt = found[0] if len(found) == 1 else _runs(np.concatenate([k for k, _ in found]), np.concatenate([c for _, c in found]))
    width = np.uint64(4 * bits)
    distinct, gram = np.unique(keys & ((np.uint64(1) << width) - np.uint64(1)), return_inverse=True)
    cells = np.stack([(distinct >> np.uint64(bits * (3 - k))) & np.uint64((1 << bits) - 1) for k in range(4)], 1).astype(np.int64)
    sizes = (cells > 0).sum(1)
    flat = alphabet[cells[cells > 0] - 1].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    stops = np.cumsum(sizes).tolist()
    names = [flat[a:b] for a, b in zip([0, *stops], stops)]
    return Grams((keys >> width).astype(np.int64), gram, cnt.astype(np.int64), names)


def _one_by_one(texts: list[str]) -> Grams:
    """Texts of so many different characters that four do not fit one number."""
    place: dict[str, int] = {}
    owner, gram, cnt = [], [], []
    for i, text in enumerate(texts):
        own = Counter(p[a:a + n] for w in text.split(" ") if w for p in (f" {w} ",)
                      for n in range(2, min(4, len(p)) + 1) for a in range(len(p) - n + 1))
        for g, c in own.items():
            owner.append(i)
            gram.append(place.setdefault(g, len(place)))
            cnt.append(c)
    return Grams(np.array(owner, np.int64), np.array(gram, np.int64), np.array(cnt, np.int64), list(place))


def _add(a: Grams | None, b: Grams) -> Grams:
    """Grams of one text, of two parts."""
    if a is None:
        return b
    total = Counter(dict(zip((a.names[g] for g in a.gram.tolist()), a.cnt.tolist())))
    for g, n in zip(b.gram.tolist(), b.cnt.tolist()):
        total[b.names[g]] += n
    n = len(total)
    return Grams(np.zeros(n, np.int64), np.arange(n), np.fromiter(total.values(), np.int64, n), list(total))


def steps(batches: Iterator[pa.RecordBatch], keys: int, max_chars: int = 4 * STEP_CHARS) -> Iterator[tuple[list, Grams]]:
    """``(rows, grams)`` of rows sorted by their first ``keys`` columns; the last
    column is the text.  ``rows`` lists, for every owner, the rows (all columns
    but the text) of one key; their texts count as one.  A step holds up to about
    ``max_chars`` code points; a key with more text is counted in parts."""
    rows: list[list] = []
    texts: list[list] = []
    chars, part = 0, None

    def count(own: list[list]) -> Grams:
        return count_grams([" ".join(t for t in x if t) for x in own])

    for batch in batches:
        *columns, words = (batch.column(i).to_pylist() for i in range(batch.num_columns))
        for row, text in zip(zip(*columns), words):
            text = text or ""
            same = bool(rows) and rows[-1][0][:keys] == row[:keys]
            if rows and chars + len(text) > max_chars:
                if not same:
                    yield rows, _add(part, count(texts)) if part else count(texts)
                    rows, texts, chars, part = [], [], 0, None
                else:
                    if len(rows) > 1:
                        yield rows[:-1], count(texts[:-1])
                        rows, texts = rows[-1:], texts[-1:]
                    part, texts, chars = _add(part, count(texts)), [[]], 0
            elif part and not same:
                yield rows, _add(part, count(texts))
                rows, texts, chars, part = [], [], 0, None
            if same:
                rows[-1].append(row)
                texts[-1].append(text)
            else:
                rows.append([row])
                texts.append([text])
            chars += len(text)
    if rows:
        yield rows, _add(part, count(texts)) if part else count(texts)
