import hashlib
import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import helpers as H  # noqa: E402

from shelfsort.llm import exact_dedup as X  # noqa: E402
from shelfsort.llm import line_dedup as L  # noqa: E402


def test_cuckoo_filter_inserts_deletes_and_resizes():
    r = random.Random(1)
    keys = [r.randbytes(32) for _ in range(5000)]
    s = X.Shard()
    for i, k in enumerate(keys):
        s.add(k, 1, 5, i, i)
    assert s.resizes > 0 and all(k in s.filter for k in keys)
    s.add(keys[7], 2, 9, 1, 1)
    assert s.content[keys[7]] == [3, 9, 1, 1]
    assert s.remove(keys[7], 1) and keys[7] in s.filter
    for k in keys:
        s.remove(k, 3)
    assert not s.content and not s.filter.table.any()
    assert not s.remove(keys[0], 1)
    assert sum(r.randbytes(32) in s.filter for _ in range(2000)) == 0


def test_fingerprint_clash_is_verified():
    a = bytes(8) + b"\x01\x02" + b"\x03" * 6 + bytes(16)
    b = a[:16] + b"\x09" * 16  # same fingerprint and buckets
    s = X.Shard()
    s.add(a, 1, 1, 1, 1)
    s.add(b, 1, 1, 2, 2)
    assert len(s.content) == 2
    assert s.remove(a, 1) and b in s.filter


def test_exact_dedup_equals_brute_force(spark):
    texts = ["a b", "ab", " a\tb\n", None, "", " \n", "A b", "é é", "éé", "x" * 50_000, "x " * 50_000, " ", "a b"] + ["hot"] * 3000
    docs = H.documents(spark, texts).repartition(7)
    got = H.rows(X.exact_dedup(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got == H.exact(list(enumerate(texts)))


def test_exact_dedup_repeated_rows_nulls_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a", 1, "q"), (1, "a", 1, "q"), (None, "a", 2, "q"), (None, "b", 2, None)],
                               "doc_id bigint, text string, row int, digest string")
    out = X.exact_dedup(df).collect()
    assert sorted((r.doc_id is None, r.group_size, r.keep_id) for r in out) == sorted([(False, 3, 1)] * 2 + [(True, 3, 1), (True, 1, None)],)
    assert sum(r.kept for r in out if r.group_size == 3) == 1
    assert X.exact_dedup(df.limit(0)).count() == 0


def test_index_insert_and_delete_on_spark(spark):
    first = H.documents(spark, ["a", "b", "b", "c"])
    more = H.documents(spark, ["b", "d"], first=10)
    index = X.insert(None, X.digests(first), 3)
    index = X.insert(index, X.digests(more), 3)
    index = X.delete(index, X.digests(H.documents(spark, ["a", "b", "nowhere"])), 3)
    got = {r.digest.hex(): r.group_size for r in X.groups(index).collect()}
    want = {hashlib.sha256(t.encode()).hexdigest(): n for t, n in (("b", 2), ("c", 1), ("d", 1))}
    assert {k: v for k, v in got.items()} == want


def lines(items, at_least):
    df = {}
    for i, t in items:
        for k in {L.line_key(x.encode()) for x in (t or "").split("\n")}:
            df.setdefault(k, set()).add(i)
    out = {}
    for i, t in items:
        x = (t or "").split("\n")
        kept = [y for y in x if not L.line_key(y.encode()) or len(df[L.line_key(y.encode())]) < at_least]
        out[i] = (len(x), len(x) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def test_line_dedup_equals_brute_force(spark):
    r = random.Random(5)
    texts = ["\n".join(r.choice(["Menu", " menu\t", "MENU", "", "  ", f"own {i} {r.random()}", f"mid {r.randrange(40)}", "é", "É"])
                       for _ in range(r.randrange(30))) for i in range(300)] + [None, "", "\n", "\n\nMenu\n", "solo " * 30_000]
    docs = H.documents(spark, texts).repartition(5)
    want = lines(list(enumerate(texts)), 10)
    got = H.rows(L.line_dedup(docs, with_text=True), "doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert got == want
    assert L.line_dedup(docs.limit(0)).count() == 0


def test_hot_line_over_many_partitions(spark):
    texts = [f"everywhere\nown {i}\neverywhere" for i in range(4000)] + [f"nine {i % 2}" for i in range(18)]
    docs = H.documents(spark, texts).repartition(9)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        got = H.rows(L.line_dedup(docs), "doc_id", "n_lines", "n_dropped", "kept_sha256")
        assert got == lines(list(enumerate(texts)), 10)
        first = L.line_dedup(docs, min_docs=None, with_text=True)
        kept = {r.doc_id: r.text for r in first.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert kept[0] == "everywhere\nown 0" and all(kept[i] == f"own {i}" for i in range(1, 4000))
    assert kept[4000] == "nine 0" and kept[4001] == "nine 1" and kept[4002] == ""


def test_line_dedup_null_ids_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "a\nb")] * 2 + [(5, "a")] * 30, "doc_id bigint, text string")
    out = L.line_dedup(df).collect()
    assert len(out) == 32 and all(r.n_dropped == 0 for r in out)  # two documents have the line


def test_line_dedup_tells_texts_of_one_id_apart(spark):
    texts = [(None, f"menu\nown {i}\nmenu") for i in range(12)] + [(7, f"own {i}\nmenu\nten {i}") for i in range(12, 15)]
    texts += [(9, "first\nsecond")] * 11 + [(9, "second\nthird")]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(4)
    def left(min_docs):
        return sorted((r.doc_id or 0, r.n_dropped, r.text) for r in L.line_dedup(df, min_docs=min_docs, with_text=True).collect())
    own = [(0, 2, f"own {i}") for i in range(12)] + [(7, 1, f"own {i}\nten {i}") for i in range(12, 15)]
    assert left(10) == sorted(own + [(9, 0, "first\nsecond")] * 11 + [(9, 0, "second\nthird")])
    got = left(None)
    assert sum(t.split("\n").count("menu") for _, _, t in got) == 1 and all(any(f"own {i}" in t.split("\n") for _, _, t in got) for i in range(15))
    held = {t for i, _, t in got if i == 9}
    assert len(held) == 2 and held in ({"first\nsecond", "third"}, {"first", "second\nthird"})
