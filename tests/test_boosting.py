"""Boosted trees against a plain Python booster that scans all splits."""
import math
import random

import numpy as np
import pytest

from shelfsort.operators import boosting
from shelfsort.operators.boosting import SCALE, BoostParams
from shelfsort.operators.model import cross_validate, fit, predict

ROW = "rid long, y int, kv array<struct<idx:int,bin:int>>"


def plain_train(rows, classes, params):
    """rows: (y, {feature: bin}) -> margins per row after all rounds."""
    margins, split = [[0.0] * classes for _ in rows], []

    def leaf_or_split(ids, g, h, depth):
        tg, th = sum(g[i] for i in ids), sum(h[i] for i in ids)
        best = None
        if depth < params.depth:
            for f in sorted({f for i in ids for f in rows[i][1]}):
                for b in range(params.bins):
                    for missing_left in (False, True):
                        left = [i for i in ids if (rows[i][1][f] <= b if f in rows[i][1] else missing_left)]
                        lg, lh = sum(g[i] for i in left), sum(h[i] for i in left)
                        if min(lh, th - lh) < params.min_hessian * SCALE:
                            continue
                        l2 = params.l2 * SCALE
                        gain = (lg * 1.0 * lg / (lh + l2) + (tg - lg) * 1.0 * (tg - lg) / (th - lh + l2) - tg * 1.0 * tg / (th + l2)) / SCALE
                        if gain > boosting.LEAST_GAIN and (best is None or gain > best[0]):
                            best = (gain, left)
        split.append(best is not None)
        if best is None:
            value = -params.rate * tg / (th + params.l2 * SCALE)
            return {i: value for i in ids}
        left = set(best[1])
        return leaf_or_split([i for i in ids if i in left], g, h, depth + 1) | leaf_or_split([i for i in ids if i not in left], g, h, depth + 1)

    for _ in range(params.rounds):
        p = boosting.softmax(np.array(margins))
        moves, split = [], []
        for c in range(classes):
            g = [round((p[i][c] - (y == c)) * SCALE) for i, (y, _) in enumerate(rows)]
            h = [round(max(2 * p[i][c] * (1 - p[i][c]), 1e-16) * SCALE) for i in range(len(rows))]
            moves.append(leaf_or_split(list(range(len(rows))), g, h, 0))
        for c, move in enumerate(moves):
            for i, v in move.items():
                margins[i][c] += v
        if not any(split):
            break
    return np.array(margins)


@pytest.mark.parametrize("partitions", [1, 5])
def test_equals_a_plain_booster(spark, partitions, monkeypatch):
    r = random.Random(3)
    rows = []
    for i in range(90):
        y = r.randrange(3)
        kv = {f: r.randrange(4) for f in range(8) if r.random() < 0.4}
        if r.random() < 0.8:
            kv[y] = 3
        rows.append((y, kv))
    rows.append((0, {}))
    params = BoostParams(rounds=11, depth=2, rate=0.3, bins=4, min_hessian=0.5)
    df = spark.createDataFrame([(i, y, [(f, b) for f, b in sorted(kv.items())]) for i, (y, kv) in enumerate(rows)], ROW)
    df = df.repartition(partitions)
    forest = boosting.train(df, 3, params)
    got = {r.rid: r.p for r in boosting.margins(forest, df, 3).collect()}
    want = boosting.softmax(plain_train(rows, 3, params))
    assert len(got) == len(rows)
    assert max(abs(a - b) for i in got for a, b in zip(got[i], want[i])) < 1e-9


@pytest.mark.parametrize("classes,depth,least", [(2, 3, 0.0), (11, 2, 0.2)])
def test_columns_grow_the_trees_of_blocks(spark, classes, depth, least, monkeypatch):
    """Dealt by feature, a level is one job without a shuffle: the same trees, node by node."""
    monkeypatch.setattr(boosting, "COLUMN_ENTRIES", 300)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 64)
    r = random.Random(classes)
    rows = []
    for i in range(400):
        y = r.randrange(classes)
        kv = {f: r.randrange(6) for f in range(30) if r.random() < 0.2}
        if r.random() < 0.7:
            kv[30 + y] = r.randrange(6)
        rows.append((i // 2, y, sorted(kv.items())))      # ids repeat
    params = BoostParams(rounds=3, depth=depth, rate=0.3, bins=6, min_hessian=least)
    df = spark.createDataFrame(rows + [(None, 0, []), (900, 1, [])], ROW).repartition(7)
    blocks = boosting.cut_lineage(boosting.pack_blocks(df, classes))
    tasks = boosting._column_tasks(blocks, classes)
    assert tasks > 1
    group = f"columns-{classes}"
    spark.sparkContext.setJobGroup(group, group)
    by_columns = boosting.train_by_columns(blocks, classes, params, tasks)
    tracker = spark.sparkContext.statusTracker()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(group)]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 3 * depth + 2
    assert by_columns == boosting.train_by_rows(blocks, classes, params)
    # tables that a task or the driver would not hold are grown by rows
    for name in ("COLUMN_BYTES", "ROW_CELLS"):
        with monkeypatch.context() as m:
            m.setattr(boosting, name, 100)
            assert boosting._column_tasks(blocks, classes) == 0


def test_walk_sends_missing_rows_to_the_learned_side():
    tree = boosting.Tree()
    a, b = tree.split(0, 4, 1, True)
    tree.split(b, 2, 0, False)
    feat, row, bin_ = (np.array(x) for x in ([2, 4, 4], [1, 1, 2], [0, 3, 0]))
    # row 0 has nothing, row 1 has both, row 2 only feature 4
    assert boosting.walk(tree, 3, feat, row, bin_).tolist() == [a, tree.left[b], a]


TEXTS = [("red lager beer", "Beer"), ("pale ale beer", "Beer"), ("stout beer dark", "Beer"), ("beer amber", "Beer"),
         ("hard seltzer lime", "Hard"), ("hard cider", "Hard"), ("hard seltzer", "Hard"), ("hard lemonade", "Hard")]


def _train(spark):
    return spark.createDataFrame([(i, t, y, i) for i, (t, y) in enumerate(TEXTS * 4)], "rid long, text string, label string, ord long")


def test_texts_round_trip_and_folds(spark, tmp_path):
    from shelfsort.plans.workflow import load_model, save_model
    boost = BoostParams(rounds=3, depth=2, rate=0.5)
    m = fit(_train(spark), kind="boosted", boost=boost)
    save_model(m, str(tmp_path / "m"))
    again = load_model(spark, str(tmp_path / "m"))
    assert again.kind == "boosted" and again.boost == boost
    q = spark.createDataFrame([(0, "amber lager beer"), (1, "hard seltzer"), (2, "zzz"), (3, "")], "rid long, text string")
    a, b = ({r.rid: (r.ml_category, r.ml_confidence) for r in predict(x, q).collect()} for x in (m, again))
    assert a == b and a[0][0] == "Beer" and a[1][0] == "Hard"
    assert all(0 < p <= 1 and not math.isnan(p) for _, p in a.values())
    assert cross_validate(_train(spark), kind="boosted", boost=BoostParams(rounds=1, depth=2, rate=0.5)) == 1.0


def test_rules_of_training(spark):
    one = spark.createDataFrame([(0, "a", "X")], "rid long, text string, label string")
    assert fit(one, kind="boosted") is None
    with pytest.raises(ValueError):
        fit(_train(spark), kind="forest")


def test_boosted_model_in_the_category_chain(spark, seed_labels):
    from shelfsort.config import TagConfig
    from shelfsort.plans.tagging import tag
    from shelfsort.plans.workflow import force_retrain
    cfg = TagConfig(classifier="boosted", boost=BoostParams(rounds=1, depth=2))
    state, metrics = force_retrain(spark, seed_labels.where("category <> 'Non-alcoholic Beer'").limit(6), cfg)
    assert state.model.kind == "boosted" and metrics.first().status == "trained"
    names = spark.createDataFrame([(0, "Qqq Zzz")], "row_id long, product_name string")
    r = tag(names, state, cfg).first()
    assert r.steps_tried[:4] == ["dataset_exact", "fuzzy", "vector", "ml"] and r.category in state.model.classes
