"""Plain-Python models of the row-by-row semantics, used as test oracles."""
from __future__ import annotations

import math
from collections import Counter

SAVE = {"human": 0, "seed": 1, "llm": 2, "batch_cache": 3, "vector": 4, "fuzzy": 5, "ml": 6, "keyword": 7}


def grams(text: str) -> list[str]:
    out = []
    for w in text.lower().split():
        p = " " + w + " "
        for n in range(2, min(4, len(p)) + 1):
            out.extend(p[i:i + n] for i in range(len(p) - n + 1))
    return out


def tfidf_fit(corpus: list[str], max_features=None):
    counts = [Counter(grams(t)) for t in corpus]
    tf = Counter()
    df = Counter()
    for c in counts:
        tf.update(c)
        df.update(c.keys())
    vocab = sorted(tf, key=lambda g: (-tf[g], g))
    if max_features:
        vocab = vocab[:max_features]
    n = len(corpus)
    idf = {g: math.log((1 + n) / (1 + df[g])) + 1 for g in vocab}
    return idf


def tfidf_vec(text: str, idf: dict) -> dict:
    c = Counter(g for g in grams(text) if g in idf)
    v = {g: (1 + math.log(k)) * idf[g] for g, k in c.items()}
    nrm = math.sqrt(sum(x * x for x in v.values()))
    return {g: x / nrm for g, x in v.items()} if nrm > 0 else {}


def cos(a: dict, b: dict) -> float:
    return sum(x * b.get(g, 0.0) for g, x in a.items())


def refit_best(query: str, corpus: list[str]):
    idf = tfidf_fit(corpus + [query])
    q = tfidf_vec(query, idf)
    scores = [cos(q, tfidf_vec(c, idf)) for c in corpus]
    best = max(range(len(scores)), key=lambda i: (scores[i], -i))
    return best, scores[best]


def save(table: list[dict]) -> list[dict]:
    """Stable sort by priority, keep first per exact name."""
    order = sorted(range(len(table)), key=lambda i: (SAVE.get(table[i]["source"], 8), i))
    seen, out = set(), []
    for i in order:
        r = table[i]
        if r["product_name"] in seen:
            continue
        seen.add(r["product_name"])
        out.append(dict(r))
    return out


def append_prediction(table, name, category, source, conf, sub, sub_conf):
    key = name.strip().lower()
    hits = [r for r in table if r["product_name"].lower() == key]
    if hits:
        if hits[0]["source"] in ("seed", "human"):
            return table
        for r in hits:
            r.update(category=category.strip(), source=source, confidence=conf,
                     predicted_sub_category=(sub or "").strip(), sub_confidence=sub_conf)
    else:
        table = table + [dict(product_name=name.strip(), predicted_sub_category=(sub or "").strip(),
                              category=category.strip(), source=source, confidence=conf,
                              sub_confidence=sub_conf, corrected=False)]
    return save(table)


def apply_correction(table, name, category):
    key = name.strip().lower()
    hits = [r for r in table if r["product_name"].lower() == key]
    if not hits:
        table = table + [dict(product_name=name.strip(), predicted_sub_category=name.strip(),
                              category=category.strip(), source="human", confidence=1.0,
                              sub_confidence=1.0, corrected=True)]
        return save(table)
    for r in hits:
        r.update(category=category.strip(), source="human", confidence=1.0, sub_confidence=1.0, corrected=True)
    return save(table)


def leaders_sequential(names: list[str], threshold: float, ratio) -> list:
    """J6 loop: returns per row the index of the leader row it reuses, or None."""
    cache: list[tuple[int, str]] = []
    out = []
    for i, n in enumerate(names):
        best, bs = None, -1.0
        for j, ln in cache:
            s = ratio(n, ln)
            if s > bs:
                best, bs = j, s
        if best is not None and bs >= threshold:
            out.append(best)
        else:
            out.append(None)
            cache.append((i, n))
    return out
