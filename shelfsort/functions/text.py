"""Text column expressions.

All of them are built-in Spark expressions, so they stay inside whole-stage
code generation; regexes run on the JVM with Unicode word boundaries
(``(?U)``) to agree with Python's Unicode-aware ``\\b``/``\\s``.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import GENERIC_WORDS_PATTERN, KEYWORD_RULES, NOISE_PATTERN

_WS = r"(?U)\s+"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_ws(col) -> Column:
    """Python ``str.strip()``: remove Unicode whitespace at both ends."""
    return F.regexp_replace(_c(col), r"(?U)^\s+|\s+$", "")


def norm_key(col) -> Column:
    """T4: ``strip().lower()`` — the key used by every lookup and merge."""
    return F.lower(strip_ws(col))


def category_hint(col, rules=KEYWORD_RULES) -> Column:
    """Category of the first rule whose pattern is found, else null."""
    c = _c(col)
    expr = None
    for pattern, category in rules:
        cond = c.rlike("(?iU)" + pattern)
        expr = F.when(cond, F.lit(category)) if expr is None else expr.when(cond, F.lit(category))
    return expr.otherwise(F.lit(None).cast("string"))


def clean_name(col) -> Column:
    """Drop size/packaging/descriptor tokens, collapse spaces, strip;
    keep the original when nothing is left."""
    c = _c(col)
    cleaned = F.regexp_replace(c, "(?iU)" + NOISE_PATTERN, " ")
    cleaned = strip_ws(F.regexp_replace(cleaned, r"(?U)\s{2,}", " "))
    return F.when(cleaned == "", c).otherwise(cleaned)


def split_ws(col) -> Column:
    """Python ``str.split()``: whitespace-separated tokens, no empties."""
    return F.filter(F.split(_c(col), _WS), lambda t: t != "")


def sort_tokens(col) -> Column:
    """Tokens sorted by code point and joined by one space (token-sort form)."""
    return F.array_join(F.array_sort(split_ws(col)), " ")


def char_wb_grams(col) -> Column:
    """T5: character 2–4-grams inside word boundaries, after lowercasing.

    Each whitespace-separated word is padded with one space on both sides;
    all substrings of length n = 2 .. min(4, padded length) are emitted, so a
    one-letter word yields its three grams once.
    """
    words = split_ws(F.lower(_c(col)))

    def word_grams(w):
        p = F.concat(F.lit(" "), w, F.lit(" "))
        ln = F.length(p)
        return F.flatten(F.transform(
            F.sequence(F.lit(2), F.least(F.lit(4), ln)),
            lambda n: F.transform(F.sequence(F.lit(1), ln - n + 1), lambda i: F.substring(p, i, n)),
        ))

    return F.flatten(F.transform(words, word_grams))


def word_char_grams(word) -> Column:
    """Grams of one (lower-cased, non-empty) word — used after exploding words
    so huge texts never build one giant array."""
    p = F.concat(F.lit(" "), _c(word), F.lit(" "))
    ln = F.length(p)
    return F.flatten(F.transform(
        F.sequence(F.lit(2), F.least(F.lit(4), ln)),
        lambda n: F.transform(F.sequence(F.lit(1), ln - n + 1), lambda i: F.substring(p, i, n)),
    ))


def strip_generic(col) -> Column:
    """Remove the generic words beer/ale/brew/brewing/brewed; keep the
    original when nothing is left."""
    c = _c(col)
    s = strip_ws(F.regexp_replace(c, "(?iU)" + GENERIC_WORDS_PATTERN, ""))
    return F.when(s == "", c).otherwise(s)


def latin_words(col) -> Column:
    """Runs of ``[a-z]`` in the lower-cased text."""
    return F.regexp_extract_all(F.lower(_c(col)), F.lit("[a-z]+"), 0)


def word_runs(col) -> Column:
    """Maximal runs of Unicode word characters; ``\\bw\\b`` matches a purely
    alphabetic word ``w`` exactly when ``w`` is one of these runs."""
    return F.regexp_extract_all(_c(col), F.lit(r"(?U)\w+"), 0)
