from pyspark.sql import functions as F

from shelfsort.functions.text import category_hint, char_wb_grams, clean_name, strip_generic
from shelfsort.workloads import FIXTURE_NAMES

# FIXTURES §4: hint and cleaned text per fixture name
EXPECTED = [
    ("Beer", "Corona Extra Lager Can"), ("Beer", None), ("Beer", None), ("Non-alcoholic Beer", None),
    ("Beer", None), ("Non-alcoholic Beer", None), ("Hard Beverage", "White Claw Hard Seltzer"),
    (None, None), ("Hard Beverage", None), (None, None), ("Beer", None), (None, None), (None, None),
    ("Spirits", None), ("Wine", None), ("Spirits", None), ("Hard Beverage", None), ("Wine", "rosé"),
    (None, None), (None, "Heineken"), ("Beer", None), ("Beer", "Beck's Beer"), (None, "Hard Seltzers"),
    (None, None), (None, None), (None, None), (None, None), (None, None), ("Beer", "Hazy IPA"),
]


def test_hint_and_clean_goldens(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(FIXTURE_NAMES)], "i int, n string")
    rows = {r.i: r for r in df.select("i", category_hint("n").alias("h"), clean_name("n").alias("c")).collect()}
    for i, (h, c) in enumerate(EXPECTED):
        assert rows[i].h == h, (FIXTURE_NAMES[i], rows[i].h, h)
        assert rows[i].c == (c or FIXTURE_NAMES[i]), (FIXTURE_NAMES[i], rows[i].c)


def test_char_grams_golden(spark):
    g = spark.createDataFrame([("a Beer",)], "t string").select(char_wb_grams("t").alias("g")).first().g
    assert g == [" a", "a ", " a ", " b", "be", "ee", "er", "r ", " be", "bee", "eer", "er ",
                 " bee", "beer", "eer "]


def test_strip_generic(spark):
    df = spark.createDataFrame([("Beck's Beer",), ("beer ale",), ("Brewed Ale Stout",)], "t string")
    got = [r[0] for r in df.select(strip_generic("t")).collect()]
    assert got == ["Beck's", "beer ale", "Stout"]


def test_clean_keeps_original_when_empty(spark):
    df = spark.createDataFrame([("12 x 330ml",), ("  Premium  ",)], "t string")
    got = [r[0] for r in df.select(clean_name(F.col("t"))).collect()]
    assert got == ["12 x 330ml", "  Premium  "]
