"""Conversation repair, whitening and personal data against plain Python."""
import hashlib
import heapq
import math
import random
import re

import numpy as np
import pytest

from helpers import crc

CONV = "conv_id bigint, turn bigint, role string, text string"


# ---- op11 ------------------------------------------------------------------------

STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
NEW = {"": "u", "s": "u", "u": "a", "a": "u"}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text, h = " " if role is None else role, " " if text is None else text, crc(key, 20)
        if h:
            out += [(turn, "user" if h == 4 else role, "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text)] * (2 if h == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def brute(rows):
    """One conversation: every cheapest repair by Dijkstra over (cost, audit)."""
    rows = damaged(rows)
    seen, fault = set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\v\f\r")
        fault.append("blank" if not bare.strip(" \t\n\v\f\r") else "duplicate" if (role, text) in seen
                     else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, s, made = heapq.heappop(heap)
        if i == len(rows) and s in ("", "a"):
            break
        if (i, s) in done:
            continue
        done.add((i, s))
        heapq.heappush(heap, (cost + 3, audit + "I", i, NEW[s], made + (({"u": "user", "a": "assistant"}[NEW[s]]) + ":",)))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, s, made))
            if fault[i] not in ("blank", "duplicate"):
                more = 3 if fault[i] == "truncated" else 0
                heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, NEW[s], made + (f"{ {'u': 'user', 'a': 'assistant'}[NEW[s]]}:{text}",)))
                if (to := STEP.get((s, role[:1]))):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, to, made + (f"{role}:{text}",)))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *(fault.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
            hashlib.sha256("\n".join(made).encode()).hexdigest())


def random_rows(seed, conv, n):
    r = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "ua"]
    texts = ["Hi.", "Yes!", "no end", " ", "", None, "Ok? \n", "tail. ", "é😀."] + [f"t{i}." for i in range(n)]
    return [(conv, None if r.random() < 0.05 else i - r.randrange(3) * (r.random() < 0.1), r.choice(roles[:4] if r.random() < 0.8 else roles),
             r.choice(texts)) for i in range(n)]


def check_repair(spark, rows, partitions=None):
    from shelfsort.llm.conversations import repair
    df = spark.createDataFrame(rows, CONV)
    out = repair(df.repartition(partitions) if partitions else df).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    assert len(out) == len(groups)
    for r in out:
        assert tuple(r)[1:] == brute(groups[r["conv_id"]]), r["conv_id"]


def test_repair_equals_brute_force(spark):
    rows = [x for c in range(150) for x in random_rows(c, c if c else None, c % 12)]
    rows += [(500 + i, 0, "user", "Alone.") for i in range(30)]      # some lose their only row
    check_repair(spark, rows + rows[:40], 5)


def test_repair_of_a_long_conversation(spark):
    """The null conversation holds most rows: many ranges and pieces."""
    rows = random_rows(1, None, 1700) + random_rows(2, 7, 700) + random_rows(3, 8, 3)
    check_repair(spark, rows)


def test_repair_of_hot_equal_rows(spark):
    rows = [(1, 1, "user", "Same.")] * 3000 + [(1, 2, "assistant", "Fine.")] + [(2, None, None, None)] * 500
    check_repair(spark, rows)


def test_repair_empty_and_extra_columns(spark):
    from pyspark.sql import functions as F
    from shelfsort.llm.conversations import repair
    assert repair(spark.createDataFrame([], CONV)).collect() == []
    rows = random_rows(5, 3, 9)
    df = spark.createDataFrame(rows, CONV).withColumn("conv", F.lit(1)).withColumn("n", F.lit("x")).withColumn("same", F.lit(0))
    assert tuple(repair(df).first())[1:] == brute(rows)


def test_auction_in_pieces_equals_whole():
    from shelfsort.llm.conversations import END, FAR, Lattice, STATES, crossing
    r = random.Random(4)
    for _ in range(60):
        rows = [(r.choice("sua" if r.random() < 0.9 else "tx"), r.random() < 0.3) for _ in range(r.randrange(0, 25))]
        whole = Lattice(rows)
        cut = r.randrange(len(rows) + 1)
        table = [crossing(rows[:cut]), crossing(rows[cut:])]
        ends = [min(FAR, *(table[1][4 * s + t] + END[t] for t in STATES)) for s in STATES]
        assert whole.cost(0) == min(table[0][t] + ends[t] for t in STATES)
        first, s = Lattice(rows[:cut], tuple(ends)).trace(0) if cut else ([], 0)
        second, _ = Lattice(rows[cut:]).trace(s)
        assert first + second == whole.trace(0)[0]


# ---- op12 -------------------------------------------------------------------------------

def plain_whitening(vectors):
    x = np.floor(1024.0 * np.array(vectors, dtype=np.float64)).astype(np.int64) + 100000
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    values, rows = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(values)[::-1][:8]
    dev = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums)) for row in x]
    return n, dev, centred @ rows[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def test_whitening_equals_numpy(spark):
    from shelfsort.llm.whitening import whiten
    r = np.random.default_rng(3)
    vectors = (r.standard_normal((400, 20)) * np.linspace(1, 3, 20)).astype(np.float32)
    bad = [None, [math.nan] * 20, [math.inf] + [0.0] * 19, [None] + [0.0] * 19, [], [1.0, 2.0]]
    rows = [(i if i else None, v.tolist(), 1) for i, v in enumerate(vectors)] + [(900 + i, b, 2) for i, b in enumerate(bad)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(7)
    out = whiten(df).collect()
    n, dev, white, share = plain_whitening(vectors)
    assert len(out) == 400 * 8 and {x["n"] for x in out} == {n}
    assert len({x["identity_error"] for x in out}) == 1 and out[0]["identity_error"] < 1e-9
    sign = {}
    for x in out:
        i, c = x["vec_id"] or 0, x["component"] - 1
        sign.setdefault(c, np.sign(x["whitened"]) * np.sign(white[i, c]))
        assert x["deviation"] == dev[i]
        assert abs(sign[c] * x["whitened"] - white[i, c]) < 1e-9
        assert abs(x["explained"] - share[c]) < 1e-12


def test_whitening_edge_cases(spark):
    from shelfsort.llm.whitening import whiten
    shape = "vec_id bigint, embedding array<double>, n string"
    assert whiten(spark.createDataFrame([], shape)).collect() == []
    assert whiten(spark.createDataFrame([(1, None, "")], shape)).collect() == []
    one = whiten(spark.createDataFrame([(1, [0.5, 2.0, 3.0], "")], shape)).collect()
    assert [(r["component"], r["deviation"], r["whitened"]) for r in one] == [(1, 0, None), (2, 0, None), (3, 0, None)]
    # two different points: one direction, the others have no variance
    two = whiten(spark.createDataFrame([(1, [0.0, 0.0], ""), (2, [1.0, 1.0], ""), (2, [1.0, 1.0], "")], shape)).collect()
    assert sorted(round(r["whitened"], 9) for r in two if r["component"] == 1) in (
        [-0.707106781, -0.707106781, 1.414213562], [-1.414213562, 0.707106781, 0.707106781])
    assert all(r["whitened"] is None for r in two if r["component"] == 2)
    # entries so large that a deviation needs more than 64 bits in between
    big = whiten(spark.createDataFrame([(1, [1e9, 0.0], ""), (2, [0.0, 1.0], "")], shape)).collect()
    assert {r["deviation"] for r in big} == {None}


@pytest.mark.parametrize("matrix", [
    np.eye(6), np.zeros((4, 4)), np.diag([3.0, 3, 3, 1, 1, 0]), np.ones((5, 5)), np.kron(np.eye(5), [[2.0, 1], [1, 2]]),
    np.diag(1.0 + 1e-13 * np.arange(9)), np.array([[5.0]])])
def test_components_of_close_eigenvalues(matrix):
    from shelfsort.llm.whitening import components_of
    values, rows = components_of(matrix, 8)
    assert np.abs(values - np.linalg.eigvalsh(matrix)[::-1][:8]).max() < 1e-13 * max(1, abs(matrix).max())
    assert np.abs(rows @ rows.T - np.eye(len(rows))).max() < 1e-12
    assert np.abs(rows @ matrix - values[:, None] * rows).max() < 1e-12


def test_exact_deviations_beyond_64_bits():
    from shelfsort.llm.whitening import deviations
    x = np.array([[1 << 50, 3], [5, -(1 << 51)]])
    assert deviations(x, 2, [(1 << 50) + 5, 3 - (1 << 51)]) == [None, None]
    assert deviations(np.array([[10, 20], [30, 40]]), 2, [40, 60]) == [800, 800]


# ---- op13 ----------------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
            "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            number = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (13 <= len(number) <= 19 and luhn(number)):
                continue
            if kind == "phone" and not 9 <= len(number) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def personal(spark, texts, extra=False):
    from pyspark.sql import functions as F
    from shelfsort.llm.pii import find, report
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    if extra:
        df = df.withColumn("row", F.lit(1)).withColumn("email", F.lit("x")).withColumn("kind", F.lit("x"))
    return {r["doc_id"]: r for r in report(find(df)).collect()}


def same_base(row, text):
    spans = base_spans(text)
    assert [row[f"n_{k}"] for k in PATTERNS] == [sum(s[0] == k for s in spans) for k in PATTERNS], text
    assert row["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest(), text


def test_base_spans_equal_re(spark):
    r = random.Random(8)
    pieces = ["a.b", "@", "x-y", ".", "_", "+1", " (988) ", "555-2485", "4539 1488 0343 6467", "4111111111111111", "192.168", ".1.255", ".256",
              "00012.1.2.3", "é", "😀", " ", "\n", "-", "%", "+", "0", "7", "12345678901234567890", "@c.d", "a@b.c_d@e.f", "mail", "1.2.3.4.5.6.7.8"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randrange(1, 14))) for _ in range(1500)]
    texts += [None, "", " ", "a@b.c@d.e", "+1 5", "+" * 50, "9" * 50, "1 " * 3000, ".1" * 3000]
    out = personal(spark, texts, extra=True)
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        same_base(out[i], t)


def test_long_runs_take_linear_time(spark):
    texts = ["a" * 400_000, "1" * 400_000, "a@" + "b." * 100_000, "+1" + " " * 200_000, "1." * 150_000, "(1" * 100_000]
    out = personal(spark, texts)
    for i in (0, 1, 3):
        assert out[i]["spans"] == ""
    assert out[2]["spans"] == f"email:0:{2 + 2 * 100_000 - 1}"


def test_patterns_find_unseen_identifiers(spark):
    r = random.Random(2)

    def filler():
        return " ".join(r.choice(["the", "of", "house", "river", "and", "stone"]) for _ in range(30))
    texts = [f"{filler()} Phone: +1 ({r.randrange(200, 999)}) 555-{r.randrange(1000, 9999)} {filler()}" for _ in range(12)]
    texts += [f"{filler()} mailto: u{i}@host{i}.org {filler()}" for i in range(8)]
    unseen = [f"{filler()} phone: (415) 555-01{i}7 {filler()}" for i in range(4)] + [f"{filler()} mailto: josé{i}@intranet {filler()}" for i in range(3)]
    # numbers of the same shape in other places, and the words that stand anywhere
    clean = [f"{filler()} the 555 123 45{i} {filler()}" for i in range(10)] + [f"{filler()} the +1 (312) 555-{r.randrange(1000, 9999)}" for _ in range(4)]
    # a candidate that is known from its pattern elsewhere is a span wherever it stands
    again = [f"{filler()} stone (415) 555-0107 {filler()}"]
    all_ = texts + unseen + clean + again
    out = personal(spark, all_)
    for i, t in enumerate(all_):
        same_base(out[i], t)
        spans = [f"{k}:{s}:{e}" for k, s, e in base_spans(t)]
        m = re.search(r"\(415\) 555-01\d7|josé\d@intranet", t)
        if m:
            spans.append(f"{'email' if '@' in m.group() else 'phone'}:{m.start()}:{m.end()}")
        assert out[i]["spans"] == ",".join(spans), t


def test_pii_rows_apart_and_empty(spark):
    from shelfsort.llm.pii import find, report
    df = spark.createDataFrame([(None, "a@b.cd"), (None, None), (1, "+1 555 123 4567"), (1, "")], "doc_id bigint, text string")
    assert sorted(r["spans"] for r in report(find(df)).collect()) == ["", "", "email:0:6", "phone:0:15"]
    assert report(find(df.where("false"))).collect() == []
