"""Sources and sinks.

The label table lives as numbered Parquet snapshots under one root
(``<root>/v000001``, ``v000002`` …).  A save writes a *new* snapshot and
never overwrites the one being read, so a job that reads v(n) and writes
v(n+1) is safe to retry; the newest snapshot with a ``_SUCCESS`` marker is
current.  Paths go through the Hadoop FileSystem API, so the same code works
on HDFS/S3-style stores.
"""
from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT_SEEDS, LABEL_COLUMNS, LABEL_SCHEMA, SEED_SCHEMA
from ..operators.labels import coerce_legacy, dedup_priority, empty_labels
from ..session import dense_positions
from .csvfile import read_ordered

# pandas' default missing-value spellings (read as empty text by the CSV
# reader of the original tool; optional here).
PANDAS_NA = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
             "nan", "null")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


class LabelStore:
    """Snapshot store for the label table."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _folders(self) -> list[tuple[int, int | None, str, bool]]:
        """(version, batch id of its stamp, path, committed) of every snapshot folder."""
        fs, p = _fs(self.spark, self.root)
        if not fs.exists(p):
            return []
        out = []
        for st in fs.listStatus(p):
            m = re.fullmatch(r"v(\d+)(?:_b(\d+))?", st.getPath().getName())
            if m:
                done = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")
                out.append((int(m[1]), None if m[2] is None else int(m[2]), st.getPath().toString(), fs.exists(done)))
        return out

    def versions(self) -> list[int]:
        return sorted(v for v, _, _, ok in self._folders() if ok)

    def path(self, version: int) -> str:
        return next((p for v, _, p, ok in self._folders() if v == version and ok), f"{self.root}/v{version:06d}")

    def load(self, version: int | None = None) -> DataFrame:
        """The newest (or given) snapshot; an empty typed frame if none."""
        vs = self.versions()
        if version is None and not vs:
            return empty_labels(self.spark)
        v = version if version is not None else vs[-1]
        return self.spark.read.schema(LABEL_SCHEMA).parquet(self.path(v))

    def save(self, labels: DataFrame) -> int:
        """De-duplicate (W1) and write the next snapshot; returns it."""
        return self.save_as_is(dedup_priority(labels))

    def save_as_is(self, labels: DataFrame, batch_id: int | None = None) -> int:
        """Write an already de-duplicated table as the next snapshot.

        The number comes after every folder there is, committed or not, so the
        remains of a crashed write are skipped.  ``batch_id`` stamps the
        snapshot in its name: snapshot and stamp are one commit."""
        nxt = max([v for v, _, _, _ in self._folders()], default=0) + 1
        name = f"v{nxt:06d}" + ("" if batch_id is None else f"_b{batch_id:012d}")
        labels.select(*LABEL_COLUMNS).write.mode("errorifexists").parquet(f"{self.root}/{name}")
        return nxt

    def of_batch(self, batch_id: int) -> int | None:
        """The committed snapshot stamped with ``batch_id``."""
        return next((v for v, b, _, ok in self._folders() if ok and b == batch_id), None)


def read_label_csv(spark: SparkSession, path: str) -> DataFrame:
    """S1 CSV import: all-string read, legacy rename and coercion (P1, P2);
    ``seq`` = position in file order; timestamps are parsed when present."""
    raw = read_ordered(spark, path)
    ts = (F.to_timestamp(raw["timestamp"]) if "timestamp" in raw.columns else F.lit(None).cast("timestamp"))
    df = coerce_legacy(raw.withColumn("_timestamp", ts), keep=["_place", F.col("_timestamp").alias("timestamp")])
    return dense_positions(df, ["_place"], "seq").select(*LABEL_COLUMNS)


def read_seed_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON array of ``{sub_category, category}``; adds ``ord``."""
    return (spark.read.schema(SEED_SCHEMA).option("multiLine", True).json(path)
            .withColumn("ord", F.monotonically_increasing_id()))


def builtin_seeds(spark: SparkSession) -> DataFrame:
    """S3: the built-in seed records with ``ord``."""
    return spark.createDataFrame([(s, c, i) for i, (s, c) in enumerate(DEFAULT_SEEDS)],
                                 "sub_category string, category string, ord long")


def read_batch_csv(spark: SparkSession, path: str, pandas_na: bool = False) -> DataFrame:
    """Header CSV, all strings, null → ""; ``row_id`` is the position in
    file order (files by path, then as they are written).  Files are read in
    splits, however long they are.  ``pandas_na`` also maps pandas' default
    missing spellings to ""."""
    df = read_ordered(spark, path)
    cols = []
    for c in df.columns[1:]:
        v = F.col(f"`{c}`")
        if pandas_na:
            v = F.when(v.isin(*PANDAS_NA), F.lit(None)).otherwise(v)
        cols.append(F.coalesce(v, F.lit("")).alias(c))
    return df.select(*cols, F.col("_place.position").alias("row_id"))


def write_batch_csv(out: DataFrame, path: str, id_col: str = "row_id") -> None:
    """Header CSV in row order (sorted, written in parallel parts)."""
    (out.orderBy(id_col).drop(id_col).write.mode("overwrite").option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def write_index_meta_json(meta: DataFrame, path: str) -> None:
    """S7 (meta part): index rows as JSON lines."""
    meta.write.mode("overwrite").json(path)


def seeds_to_json(records) -> str:
    return json.dumps([{"sub_category": s, "category": c} for s, c in records])
