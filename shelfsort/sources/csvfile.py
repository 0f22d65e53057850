"""CSV with quoted line feeds, read by many tasks and in file order.

A plain multi-line reader gives each file to one task and forgets the order of
files.  Here files are read as lines, in splits.  Whether a line starts inside a
quoted field depends on all lines before it, but a line only ever does one of
four things to that state (keep it, flip it, end outside, end inside), and such
steps compose: every split is summed up on its own, the sums are chained over
the splits of a file, and each split then knows the state of all its lines.
Lines that start outside a field start a record; records of several lines are
put together again, and every record is parsed on its own.

Order is (file, place of the split, line).  A quote opens a field only at the
field's beginning, ``""`` is a quote inside a quoted field, and what follows a
closing quote belongs to the field up to the next comma, as Spark's own reader
has it.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_BODY = r'(?:[^"]|"")*+'
_CLOSED = rf'"{_BODY}"[^,]*+'
_FIELD = rf'(?:[^",][^,]*+|(?=,|$)|{_CLOSED})'
#: A line that starts outside a field ends inside one.
_OPENS = rf'(?s)\A(?:{_FIELD},)*+"{_BODY}\z'
#: A line that starts inside a field ends inside one: the same, or another.
_STAYS = rf'(?s)\A{_BODY}\z'
_REOPENS = rf'(?s)\A{_BODY}"[^,]*+(?:,{_FIELD})*+,"{_BODY}\z'

PLACE = ["file", "block", "line", "position"]


def records(spark: SparkSession, path: str) -> DataFrame:
    """``(file, block, line, record, first, position)``: the records of all files
    under ``path`` with the place where each starts; ``first`` marks a file's first,
    ``position`` numbers the others in the order of their places, from 0.

    Lines move once, to the other lines of their split."""
    raw = (spark.read.option("lineSep", "\n").text(path)
           .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                   F.monotonically_increasing_id().alias("line"), "value"))
    v = F.col("value")
    out, inside = v.rlike(_OPENS).cast("int"), (v.rlike(_STAYS) | v.rlike(_REOPENS)).cast("int")
    # most lines have no quote: they end as they began
    quoted = v.contains('"')
    raw = raw.withColumn("from_out", F.when(quoted, out).otherwise(0)).withColumn("from_in", F.when(quoted, inside).otherwise(1))
    fixed = F.when(F.col("from_out") == F.col("from_in"), F.col("from_out"))
    flip = ((F.col("from_out") == 1) & (F.col("from_in") == 0)).cast("int")
    here = Window.partitionBy("file", "block").orderBy("line")
    upto = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # after a line: the last fixed state and the flips since, or the flips since the split began
    raw = raw.withColumn("flips", F.sum(flip).over(upto))
    raw = raw.withColumn("set", F.last(F.when(fixed.isNotNull(), F.struct(fixed.alias("to"), F.col("flips").alias("at"))), ignorenulls=True).over(upto))
    splits = raw.groupBy("file", "block").agg(F.max_by("set", "line").alias("set"), F.max("flips").alias("flips"))
    # a row a split: the state in which each begins
    along = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("all", F.sum("flips").over(along)).withColumn(
        "known", F.last(F.when(F.col("set").isNotNull(), F.struct(
            F.pmod(F.col("set.to") + F.col("flips") - F.col("set.at"), F.lit(2)).alias("to"),
            (F.coalesce("all", F.lit(0)) + F.col("flips")).alias("at"))), ignorenulls=True).over(along))
    begin = F.when(F.col("known").isNotNull(), F.pmod(F.col("known.to") + F.col("all") - F.col("known.at"), F.lit(2))).otherwise(
        F.pmod(F.coalesce("all", F.lit(0)), F.lit(2)))
    splits = splits.select("file", "block", begin.cast("int").alias("begin"))
    lines = raw.join(splits, ["file", "block"])
    after = F.when(F.col("set").isNotNull(), F.pmod(F.col("set.to") + F.col("flips") - F.col("set.at"), F.lit(2))).otherwise(
        F.pmod(F.col("begin") + F.col("flips"), F.lit(2)))
    lines = lines.withColumn("after", after.cast("int"))
    lines = lines.withColumn("starts", F.coalesce(F.lag("after").over(here), F.col("begin")) == 0)
    lines = lines.withColumn("own", F.last(F.when(F.col("starts"), F.col("line")), ignorenulls=True).over(upto))
    head = (F.col("block") == 0) & (F.row_number().over(here) == 1)
    lines = lines.withColumn("first", head)
    # the place of a record among its split's rows; blank lines and the header are none
    row = F.col("starts") & ~F.col("first") & (F.regexp_replace("value", r"\r\z", "") != "")
    lines = lines.withColumn("place", F.sum(row.cast("long")).over(upto))
    # a record may go on in the next splits: the last start before a split, the
    # state at its end and the rows of earlier splits, a row a split
    last = lines.groupBy("file", "block").agg(F.max("own").alias("start"), F.max_by("after", "line").alias("open"), F.max("place").alias("rows"))
    last = last.withColumn("carried", F.last(F.when(F.col("start").isNotNull(), F.struct("block", "start")), ignorenulls=True).over(along))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("offset", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    lines = lines.join(last.select("file", "block", "carried", "start", "open", "offset"), ["file", "block"])
    key = F.when(F.col("own").isNotNull(), F.struct(F.col("block"), F.col("own").alias("start"))).otherwise(F.col("carried"))
    lines = lines.withColumn("key", F.coalesce(key, F.struct("block", F.col("line").alias("start"))))
    lines = lines.withColumn("position", F.col("offset") + F.col("place") - 1)
    # only records that go on in another split move again
    crosses = F.col("own").isNull() | ((F.col("own") == F.col("start")) & (F.col("open") == 1))

    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "line", "value"))), lambda x: x["value"]), "\n")

    def put_together(some: DataFrame, keys: list) -> DataFrame:
        return (some.groupBy(*keys).agg(text.alias("record"), F.max("first").alias("first"), F.min_by("position", F.struct("block", "line")).alias("position"))
                .select("file", F.col("key.block").alias("block"), F.col("key.start").alias("line"), "record", "first", "position"))

    every = (put_together(lines.where(~crosses), ["file", "block", "key"])
             .unionByName(put_together(lines.where(crosses), ["file", "key"])))
    return every.withColumn("record", F.regexp_replace("record", r"\r\z", "")).where(F.col("record") != "")


def read_ordered(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the CSV files under ``path`` (header, all strings) with
    ``file, block, line, position`` in a struct ``_place`` that orders them as the files do."""
    columns = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"').columns
    if not columns:
        raise ValueError(f"no header in {path}")
    ddl = ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)
    parsed = F.from_csv("record", ddl, {"escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"})
    rows = records(spark, path).where(~F.col("first")).select(F.struct(*PLACE).alias("_place"), parsed.alias("_row"))
    return rows.select("_place", *[F.col(f"_row.`{c.replace('`', '``')}`").alias(c) for c in columns])
