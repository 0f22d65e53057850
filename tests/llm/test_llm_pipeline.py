import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import helpers as H  # noqa: E402
from test_llm_model import copies  # noqa: E402

import corpus_pipeline  # noqa: E402
from shelfsort.llm import stages as S  # noqa: E402
from shelfsort.llm.toxicity import toxicity  # noqa: E402

BAD = ["grumbleface", "snotwit", "dolthead"]


def tables(spark, path):
    r = random.Random(6)
    items = [(i, H.prose(900 + i, 16, 500)) for i in range(6)]
    rows = []
    for i in range(700):
        w = H.prose(i, r.randrange(30, 120), 900).split(" ")
        toxic = r.random() < 0.25
        for _ in range(2 + len(w) // 20 if toxic else 0):
            w.insert(r.randrange(len(w)), r.choice(BAD))
        rows.append([i, " ".join(w), toxic])
    rows += [[700 + k, rows[k % 20][1] + " " * (k % 3), rows[k % 20][2]] for k in range(60)]
    rows += [[800 + k, H.edited(rows[20 + k % 10][1], k, 1), rows[20 + k % 10][2]] for k in range(40)]
    rows += [[900 + k, H.prose(2000 + k, 30, 900) + " " + items[k % 6][1], False] for k in range(12)]
    rows += [[950, None, False], [951, "", False], [952, " ", False]]
    spark.createDataFrame([(i, t, "en", f"s{i % 4}", len(t or ""), "extra") for i, t, _ in rows],
                          H.DOC + ", n_points string").repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(y)) for i, _, y in rows if i % 3], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return rows, items


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows, items = tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    toxic = H.rows(toxicity(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")), "doc_id", "predicted")
    left = [(i, t) for i, t, _ in rows if toxic[i] == (0,)]
    assert 0 < len(left) < len(rows)
    e = H.exact(left)
    left = [(i, t) for i, t in left if e[i][2]]
    j = H.jaccard_components(left)
    left = [(i, t) for i, t in left if j[i][1] == i]
    c = H.contamination(left, items)
    assert any(v[4] for v in c.values())
    left = [(i, t) for i, t in left if not c[i][4]]
    size = {}
    for i, _ in left:
        size[f"s{i % 4}"] = size.get(f"s{i % 4}", 0) + 1
    mass = sum(n ** 0.5 for n in size.values())
    want = {i: copies(i, (size[f"s{i % 4}"] ** 0.5) / mass * len(left) / size[f"s{i % 4}"]) for i, _ in left}
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*docs.columns, "copy", "mix_order"]
    got = out.collect()
    n = {}
    for r in got:
        n[r.doc_id] = n.get(r.doc_id, 0) + 1
    assert n == {i: k for i, k in want.items() if k}
    text = dict(left)
    assert all(r.text == text[r.doc_id] and r.n_points == "extra" for r in got)


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).dtypes == docs.dtypes, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard_join", "benchmark_decontamination", "mixing"]


def test_exact_stage_with_repeated_and_null_ids(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a "), (None, "c"), (None, "c"), (4, "b")], "doc_id bigint, text string")
    got = sorted((r.doc_id or 0, r.text) for r in S.exact_dedup_stage(spark, df, str(tmp_path)).collect())
    assert got == [(0, "c"), (1, "b"), (2, "a ")]


def test_near_and_decontamination_stages_decide_by_row(spark, tmp_path):
    """Rows without an id, and rows that repeat one, stay or go by their own texts."""
    item = H.prose(77, 16, 500)
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    base, other = H.prose(1, 60, 900), H.prose(2, 60, 900)
    clean = [H.prose(10 + i, 40, 900) for i in range(6)]
    rows = [(5, base), (None, H.edited(base, 1, 1)), (None, clean[0]), (None, clean[1]), (None, other), (None, H.edited(other, 2, 1)),
            (7, clean[2]), (7, H.edited(base, 3, 1)), (3, H.edited(base, 4, 1)), (None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = S.near_dedup_stage(spark, df, str(tmp_path)).collect()
    left = sorted((r.doc_id or 0, r.text or "") for r in got)
    assert [x for x in left if x[1] not in (other, rows[5][1])] == sorted([(3, rows[8][1]), (0, clean[0]), (0, clean[1]), (7, clean[2]), (0, ""), (0, "")])
    assert len(left) == 7  # and one of the two near copies without an id
    rows = [(None, clean[0]), (None, clean[1] + " " + item), (None, clean[2]), (4, clean[3]), (4, item), (6, clean[4])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sorted((r.doc_id or 0, r.text) for r in S.decontamination_stage(spark, df, str(tmp_path)).collect())
    assert got == sorted([(0, clean[0]), (0, clean[2]), (4, clean[3]), (6, clean[4])])


def test_near_dedup_of_split_blocks_keeps_estimates_plain(spark, monkeypatch):
    """Blocks searched in pieces: every table written on the way has an estimate
    that a plan can carry, and one row of each component of copies is left."""
    from shelfsort.llm import components as C, ngram_join as J, stages as S
    seen = []

    def watched(df, write=C.materialise):
        out = write(df)
        seen.append(int(out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        return out
    for module in (C, J, S):
        monkeypatch.setattr(module, "materialise", watched)
    monkeypatch.setattr(J.jaccard_components, "__defaults__", ("doc_id", "text", 5, 3))
    words = [f"w{i}" for i in range(60)]
    rows = [(10 + i, " ".join(words[:58] + [f"x{i}"])) for i in range(12)] + [(50, "another text of its own with words"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    left = S.near_dedup_stage(spark, docs, "").collect()
    assert sorted(r.doc_id or 0 for r in left) == [0, 10, 50]
    assert max(seen) < 1 << 64
