"""String similarity.

The only Python on this path is the longest-common-subsequence kernel, run as
an Arrow-batched pandas UDF on pairs that survived blocking.  Everything
around it (token sorting, token sets, lengths) is built-in expressions.
"""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import sort_tokens, split_ws


def lcs_length(a: str, b: str) -> int:
    """Bit-parallel LCS length (Allison–Dix / Hyyrö), O(|a|·|b|/w)."""
    if not a or not b:
        return 0
    if len(a) > len(b):
        a, b = b, a
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    s = full
    for ch in b:
        m = masks.get(ch)
        if m is None:
            continue
        u = s & m
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def indel_ratio_py(a: str, b: str) -> float:
    """Normalised Indel similarity in 0..100; two empty strings score 100."""
    total = len(a) + len(b)
    if total == 0:
        return 100.0
    return 200.0 * lcs_length(a, b) / total


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """T6 kernel: 200·LCS/(|a|+|b|) on already prepared strings."""
    out = [
        None if (x is None or y is None) else indel_ratio_py(x, y)
        for x, y in zip(a.tolist(), b.tolist())
    ]
    return pd.Series(out, dtype="float64")


@F.pandas_udf(T.LongType())
def lcs_len(a: pd.Series, b: pd.Series) -> pd.Series:
    """LCS length of two prepared strings (null if either is null)."""
    out = [
        None if (x is None or y is None) else lcs_length(x, y)
        for x, y in zip(a.tolist(), b.tolist())
    ]
    return pd.Series(out, dtype="Int64")


def token_sort_ratio(a, b) -> Column:
    """Ratio of the whitespace tokens sorted and re-joined (case as given)."""
    return indel_ratio(sort_tokens(a), sort_tokens(b))


def token_set_ratio(a, b) -> Column:
    """T7 token-set ratio, 0..100.

    Token sets A, B; intersection I and differences are sorted and joined.
    Either set empty → 0; I non-empty and one difference empty → 100; else
    max(ratio(I+dA, I+dB), ratio(I, I+dA), ratio(I, I+dB)) where the last two
    exist only for non-empty I and have a closed form (LCS = |I|).
    """
    ta = F.array_distinct(split_ws(a))
    tb = F.array_distinct(split_ws(b))
    inter = F.array_sort(F.array_intersect(ta, tb))
    da = F.array_sort(F.array_except(ta, tb))
    db = F.array_sort(F.array_except(tb, ta))
    si = F.array_join(inter, " ")
    sa = F.array_join(da, " ")
    sb = F.array_join(db, " ")
    li, la, lb = F.length(si), F.length(sa), F.length(sb)
    has_i = F.size(inter) > 0
    sep = F.when(has_i, F.lit(1)).otherwise(F.lit(0))
    # ratio(I+dA, I+dB): both share the prefix "I ", so LCS = |I|+sep+LCS(dA,dB)
    ab_len = li + sep + la
    ba_len = li + sep + lb
    lcs_ab = lcs_len(sa, sb)
    r1 = F.when(ab_len + ba_len == 0, F.lit(0.0)).otherwise(
        200.0 * (li + sep + lcs_ab) / (ab_len + ba_len))
    r2 = 200.0 * li / (li + ab_len)
    r3 = 200.0 * li / (li + ba_len)
    general = F.when(has_i, F.greatest(r1, r2, r3)).otherwise(r1)
    return (
        F.when((F.size(ta) == 0) | (F.size(tb) == 0), F.lit(0.0))
        .when(has_i & ((F.size(da) == 0) | (F.size(db) == 0)), F.lit(100.0))
        .otherwise(general)
    )


def token_set_ratio_py(a: str, b: str) -> float:
    """Reference implementation used by tests (plain Python)."""
    ta, tb = set(a.split()), set(b.split())
    if not ta or not tb:
        return 0.0
    inter = sorted(ta & tb)
    da, db = sorted(ta - tb), sorted(tb - ta)
    if inter and (not da or not db):
        return 100.0
    si, sa, sb = " ".join(inter), " ".join(da), " ".join(db)
    s1 = (si + " " + sa) if si else sa
    s2 = (si + " " + sb) if si else sb
    best = indel_ratio_py(s1, s2) if (s1 or s2) else 0.0
    if si:
        best = max(best, indel_ratio_py(si, s1), indel_ratio_py(si, s2))
    return best


def token_sort_ratio_py(a: str, b: str) -> float:
    return indel_ratio_py(" ".join(sorted(a.split())), " ".join(sorted(b.split())))
