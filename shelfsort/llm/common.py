"""Shared helpers of the corpus operators."""
from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsort.session import cut_lineage, ensure_checkpoint_dir

WHITE_SPACE = " \t\n\v\f\r"
WHITE_BYTES = WHITE_SPACE.encode()
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def partitions(spark: SparkSession) -> int:
    """Tasks of an even shuffle: the session's setting, at least two waves of the cluster."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as decimal text, modulo n (a null id counts as 'null')."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), F.lit(n)).cast("int")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have."""
    have = {c.lower() for c in df.columns}
    name = base
    while name.lower() in have:
        name = "_" + name
    return name


def materialise(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder (survives lost executors)."""
    return cut_lineage(df)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    import uuid
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage like a
    checkpoint, but columnar and compressed."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_hot(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int,
             spread_by: Column, salts: int = 64) -> DataFrame:
    """Left join of ``rows`` to ``groups`` (unique in ``key``), where one key may
    hold a large part of all rows.

    Keys with more than total/1000 rows are salted.  At most 999 keys can be
    that large, whatever the data, so the list of them is broadcast.
    """
    limit = max(256, total // 1000)
    hot = groups.where(F.col(size) > limit).select(key, F.lit(True).alias("_hot"))
    rows = (rows.join(F.broadcast(hot), key, "left")
            .withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread_by), F.lit(salts))).otherwise(F.lit(0)).cast("int"))
            .drop("_hot"))
    groups = groups.withColumn("_salt", F.explode(
        F.when(F.col(size) > limit, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return rows.join(groups, [key, "_salt"], "left").drop("_salt")
