"""Ordered CSV reading in splits against Python's csv module."""
import csv
import io
import random

import pytest

from shelfsort.sources.store import read_batch_csv, read_label_csv, write_batch_csv


@pytest.fixture()
def tiny_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "3"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


def _cell(r):
    return "".join(r.choice(['a', 'bc', ',', '"', '""', '\n', ' ', 'é', '\n\n', '6"', "x,y"]) for _ in range(r.randrange(0, 6)))


@pytest.mark.parametrize("seed", range(4))
def test_random_files_in_small_splits(spark, tmp_path, tiny_splits, seed):
    r = random.Random(seed)
    want = []
    for part in range(3):
        rows = [(str(i), _cell(r), _cell(r), "z") for i in range((5, 80, 20)[(part + seed) % 3])]
        text = io.StringIO()
        csv.writer(text, lineterminator="\n").writerows([("product_id", "product_name", "x", "end"), *rows])
        (tmp_path / f"part-{part}.csv").write_text(text.getvalue(), newline="")
        want += rows
    got = read_batch_csv(spark, str(tmp_path)).orderBy("row_id").collect()
    assert [r.row_id for r in got] == list(range(len(want)))
    assert [(r.product_id, r.product_name, r.x, r.end) for r in got] == want


def test_quotes_inside_plain_fields_and_crlf(spark, tmp_path, tiny_splits):
    lines = ['product_name,x', '6" pizza,1', 'a "quoted" word,2', '"open', 'still, ""open""', 'closed" tail,3', '', ',', '"","4"', 'é😀,5']
    (tmp_path / "a.csv").write_text("\r\n".join(lines) + "\r\n", newline="")
    got = [(r.product_name, r.x) for r in read_batch_csv(spark, str(tmp_path)).orderBy("row_id").collect()]
    assert got[:2] == [('6" pizza', "1"), ('a "quoted" word', "2")]
    assert [x for _, x in got] == ["1", "2", "3", "", "4", "5"]


def test_rows_of_several_files_keep_file_order(spark, tmp_path):
    (tmp_path / "part-0.csv").write_text("product_name\na0\na1\na2\n")
    (tmp_path / "part-1.csv").write_text("product_name\n" + "".join(f"b{i}\n" for i in range(5000)))
    (tmp_path / "part-2.csv").write_text("product_name\n")
    got = [r.product_name for r in read_batch_csv(spark, str(tmp_path)).orderBy("row_id").collect()]
    assert got == ["a0", "a1", "a2", *[f"b{i}" for i in range(5000)]]


def test_one_file_uses_many_tasks(spark, tmp_path, tiny_splits):
    (tmp_path / "a.csv").write_text("product_name\n" + "".join(f"name {i}\n" for i in range(200)))
    from shelfsort.sources.csvfile import records
    assert records(spark, str(tmp_path)).select("block").distinct().count() > 10


def test_label_csv_is_numbered_in_file_order(spark, tmp_path):
    head = "sub_category,predicted_sub_category,category,source,confidence,sub_confidence,timestamp,corrected\n"
    (tmp_path / "0.csv").write_text(head + "Foo,S,A,ml,0.5,x,,True\n")
    (tmp_path / "1.csv").write_text(head + "".join(f"Bar{i},S,B,seed,,,2024-01-01T00:00:00,False\n" for i in range(300)))
    got = read_label_csv(spark, str(tmp_path)).orderBy("seq").collect()
    assert [r.seq for r in got] == list(range(301)) and got[0].product_name == "Foo" and got[300].product_name == "Bar299"
    assert (got[0].confidence, got[0].sub_confidence, got[0].corrected, got[1].timestamp is not None) == (0.5, None, True, True)


def test_written_batches_come_back_in_order(spark, tmp_path):
    rows = [(i, f"n{i} \"q\",\n{i}") for i in range(500)]
    write_batch_csv(spark.createDataFrame(rows, "row_id long, product_name string").repartition(7), str(tmp_path / "o"))
    got = read_batch_csv(spark, str(tmp_path / "o")).orderBy("row_id").collect()
    assert [(r.row_id, r.product_name) for r in got] == rows


def test_rows_are_numbered_where_they_lie(spark, tmp_path):
    """Blank lines and headers have no number, records over splits have one; no
    row is sorted or written again for it."""
    rows = [("a", "x" * 30), ("b", "two\nlines\n\nand more"), ("c", ""), ("d", 'say "hi"\n' * 9), ("e", "end")]
    for name, some in (("p1.csv", rows), ("p2.csv", rows[::-1])):
        quoted = "".join('%s,"%s"\n' % (k, v.replace('"', '""')) for k, v in some)
        (tmp_path / name).write_text("k,v\n\n" + quoted.replace("e,", "\r\ne,"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16")
    try:
        df = read_batch_csv(spark, str(tmp_path))
        plan = df._jdf.queryExecution().executedPlan().toString()
        got = [(r.k, r.v, r.row_id) for r in df.orderBy("row_id").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(k, v, i) for i, (k, v) in enumerate(rows + rows[::-1])]
    assert "ExistingRDD" not in plan and "rangepartitioning" not in plan
