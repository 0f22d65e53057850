import random

import pytest

from shelfsort.functions.fuzz import indel_ratio_py
from shelfsort.operators.fuzzy import similar_pairs


@pytest.mark.parametrize("threshold", [30.0, 60.0, 70.0, 80.0, 84.0, 85.0, 92.0, 100.0])
def test_blocked_join_finds_every_pair(spark, threshold):
    rnd = random.Random(int(threshold))
    alpha = "abcd e"
    base = ["".join(rnd.choice(alpha) for _ in range(rnd.randint(0, 14))) for _ in range(200)]
    strs = base + ["".join(rnd.choice(alpha) if rnd.random() < 0.08 else ch for ch in s) for s in base[:120]]
    df = spark.createDataFrame(list(enumerate(strs)), "sid long, s string")
    got = {(r.lid, r.rid) for r in similar_pairs(df, df, threshold).collect()}
    exp = {(i, j) for i, a in enumerate(strs) for j, b in enumerate(strs) if indel_ratio_py(a, b) >= threshold}
    assert got == exp


def test_threshold_range(spark):
    df = spark.createDataFrame([(0, "a")], "sid long, s string")
    for bad in (0.0, -1.0, 101.0):
        with pytest.raises(ValueError):
            similar_pairs(df, df, bad)
