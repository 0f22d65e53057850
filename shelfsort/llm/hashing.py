"""Vectorised word hashing over Arrow string columns (numpy inside a task).

One call works on all texts of an Arrow batch at once: bytes are classified
through a 256-entry table, words are the runs of non-separator bytes that stay
inside one text, and the hash of a word is a difference of prefix sums of a
polynomial over its bytes, finished by a 64-bit mixer.  Separators are ASCII
only, so working on UTF-8 bytes splits exactly like working on code points.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C55)  # odd, so invertible modulo 2**64
_CHUNK = 1 << 22


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64; a bijection on 64-bit words."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def mix64(x) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(np.asarray(x, dtype=U64))


def _byte_table(seed: int = 7) -> np.ndarray:
    """A mixed 64-bit value per byte; A-Z get the values of a-z."""
    with np.errstate(over="ignore"):
        t = _mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95) + U64(seed))
    t[65:91] = t[97:123]
    return t


BYTE_VALUE = _byte_table()
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def inverse_power_of_base() -> np.uint64:
    x = 1
    for _ in range(7):  # Newton's iteration doubles the correct bits
        x = x * (2 - int(_BASE) * x) % (1 << 64)
    return U64(x)


_INV = inverse_power_of_base()


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, dtype=U64)
    if n:
        p[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(p, dtype=U64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and the n+1 borders; nulls are empty."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    _, off, data = column.buffers()
    off = np.frombuffer(off, dtype=np.int64)[column.offset:column.offset + len(column) + 1] if off else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    raw = raw[off[0]:off[-1]]
    return raw, off - off[0]


def words(column: pa.Array, separator: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, number of words of each text)."""
    raw, border = text_bytes(column)
    n = len(raw)
    if n == 0:
        return np.zeros(0, U64), np.zeros(len(border) - 1, np.int64)
    inside = ~separator[raw]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    cut = border[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    start[cut] = inside[cut]
    end[cut - 1] = inside[cut - 1]
    s = np.flatnonzero(start)
    e = np.flatnonzero(end) + 1
    del inside, start, end
    # Hash in chunks that end where a word ends, so memory stays near the text's own size.
    out = np.empty(len(s), dtype=U64)
    i = 0
    while i < len(s):
        j = max(i + 1, int(np.searchsorted(e, s[i] + _CHUNK, side="right")))
        a, b = int(s[i]), int(e[j - 1])
        with np.errstate(over="ignore"):
            h = np.empty(b - a + 1, dtype=U64)
            h[0] = 0
            np.cumsum(BYTE_VALUE[raw[a:b]] * _powers(_BASE, b - a), out=h[1:])
            ls, le = s[i:j] - a, e[i:j] - a
            w = (h[le] - h[ls]) * _powers(_INV, b - a)[ls]
            out[i:j] = _mix(w + (le - ls).astype(U64) * U64(0xA0761D6478BD642F))
        i = j
    count = np.searchsorted(s, border[1:]) - np.searchsorted(s, border[:-1])
    return out, count.astype(np.int64)


def combine(parts: list[np.ndarray]) -> np.ndarray:
    """Order-sensitive hash of aligned word-hash arrays."""
    with np.errstate(over="ignore"):
        x = np.full(len(parts[0]), U64(len(parts)) * U64(0x8CB92BA72F3D8DD7), dtype=U64)
        for p in parts:
            x = _mix(x * U64(0x9FB21C651E98DF25) + p)
        return x


def shingle_sets(column: pa.Array, k: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text.  A text of
    fewer than k words has its whole sequence as its only shingle; a text
    without words has none."""
    w, count = words(column)
    out, at = [], 0
    full = combine([w[i:len(w) - k + 1 + i] for i in range(k)]) if len(w) >= k else None
    for n in count.tolist():
        if n >= k:
            out.append(np.unique(full[at:at + n - k + 1]))
        elif n:
            out.append(combine([w[at + i:at + i + 1] for i in range(n)]))
        else:
            out.append(np.zeros(0, U64))
        at += n
    return out
