from shelfsort.config import TagConfig
from shelfsort.operators.llm import merge_category_replies, merge_sub_replies, request_id, request_table
from shelfsort.plans.state import build_state


def test_reply_cases(spark, seed_labels):
    st = build_state(seed_labels, TagConfig(use_ml=False), with_index=False)
    names = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("e",)], "name string")
    reps = spark.createDataFrame([
        ("a", '{"category":"beers","confidence":0.9}'),
        ("b", "no braces here"),
        ("c", 'ok {"category": "hard beverage"} thanks'),
        ("d", '{"category": "Beer", "confidence": "high"}'),
        ("e", '{bad json}'),
    ], "name string, reply string").select(request_id("name").alias("request_id"), "reply")
    got = {r.name: (r.llm_cat, round(r.llm_conf, 6)) for r in merge_category_replies(names, reps, st).collect()}
    assert got == {"a": ("Beer", 0.7), "c": ("Hard Beverage", 0.5)}


def test_sub_reply_accepts_unknown(spark, seed_labels):
    st = build_state(seed_labels, TagConfig(use_ml=False), with_index=False)
    pairs = spark.createDataFrame([("x", "Beer"), ("y", "Beer"), ("z", "Beer")], "name string, category string")
    reps = spark.createDataFrame([
        ("x", "Beer", '{"sub_category": "craft beer"}'),
        ("y", "Beer", '{"sub_category": "Imperial Stout"}'),
        ("z", "Beer", '{"sub_category": ""}'),
    ], "name string, category string, reply string").select(
        request_id("name", "category").alias("request_id"), "reply")
    got = {r.name: r.llm_sub for r in merge_sub_replies(pairs, reps, st).collect()}
    assert got == {"x": "Craft Beer", "y": "Imperial Stout"}


def test_request_prompt(spark, seed_labels):
    st = build_state(seed_labels, TagConfig(use_ml=False), with_index=False)
    r = request_table(spark.createDataFrame([("Foo",)], "name string"), st).first()
    user = r.messages[1].content
    assert user.startswith("Available categories:\n  1. Beer\n  2. Hard Beverage\n  3. Non-alcoholic Beer\n\n")
    assert user.endswith('Product name: "Foo"\n\nReturn JSON only.')


def test_request_with_model_hint(spark, seed_labels):
    st = build_state(seed_labels, TagConfig(use_ml=False), with_index=False)
    names = spark.createDataFrame([("Foo",), ("Bar",)], "name string")
    hints = spark.createDataFrame([("Foo", "Beer")], "name string, ml_category string")
    rows = {r.product_name: r for r in request_table(names, st, hints).collect()}
    assert rows["Foo"].messages[1].content.endswith("Return JSON only.\n(ML model hinted: 'Beer', but with low confidence)")
    assert rows["Bar"].messages[1].content.endswith("Return JSON only.")
    assert rows["Foo"].messages[0].role == "system" and rows["Foo"].request_id == request_id_py("Foo")


def request_id_py(name):
    import hashlib
    return hashlib.sha256(name.encode()).hexdigest()
