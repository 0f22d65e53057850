"""Small inputs and plain Python versions of the operators' contracts."""
import binascii
import hashlib
import random
import re

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, texts, first=0, source=None, schema=DOC):
    rows = [(first + i, t, "en", source(i) if source else f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, schema)


def crc(i, n):
    return binascii.crc32(str("null" if i is None else i).encode()) % n


def rows(df, *names):
    return {r[names[0]]: tuple(r[n] for n in names[1:]) for r in df.collect()}


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    words = [f"w{int(r.paretovariate(0.7)) % vocabulary}" for _ in range(n)]
    return " ".join(words)


def edited(text, seed, changes):
    r = random.Random(seed)
    w = text.split(" ")
    for _ in range(changes):
        w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
    return " ".join(w)


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else (tuple(w[i:i + 5]) for i in range(len(w) - 4)))


def jaccard_components(items):
    """doc_id -> (n_shingles, component_id), by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in items]
    up = {i: i for i, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets}


def contamination(docs, items):
    """doc_id -> (n_words, n_hit, n_items, items_sha256, contaminated)."""
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = {}
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[s:s + 13]), set()).add(str(i))
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for span, ids in windows.items():
            for s in range(len(w) - len(span) + 1):
                if tuple(w[s:s + len(span)]) == span:
                    hit.update(range(s, s + len(span)))
                    found |= ids
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(),
                  len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def exact(items):
    """doc_id -> (keep_id, group_size, kept, sha) for unique ids."""
    groups = {}
    for i, t in items:
        n = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        groups.setdefault(n, []).append((-len(t or ""), i))
    return {i: (min(g)[1], len(g), i == min(g)[1], hashlib.sha256(n.encode()).hexdigest()) for n, g in groups.items() for _, i in g}
