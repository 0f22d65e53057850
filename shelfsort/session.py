"""Session helpers: building a session for tests, lineage cuts, size-checked
broadcasts."""
from __future__ import annotations

import os
import tempfile

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.driver.memory": "16g",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.maxPlanStringLength": "200000",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app: str = "shelfsort") -> SparkSession:
    """Session used by tests, bench and the entry module.

    A session that already runs is used as it is.  A new one takes what the
    launcher (spark-submit, spark-defaults) has set; master, partitions and
    ``DEFAULTS`` only fill in settings that are unset.
    """
    spark = SparkSession.getActiveSession()
    if spark is None:
        conf = SparkConf()
        conf.setIfMissing("spark.master", master)
        conf.setIfMissing("spark.app.name", app)
        conf.setIfMissing("spark.sql.shuffle.partitions", str(shuffle_partitions))
        for k, v in DEFAULTS.items():
            conf.setIfMissing(k, v)
        spark = SparkSession.builder.config(conf=conf).getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def is_local(spark: SparkSession) -> bool:
    """Driver and executors are one process on one machine."""
    master = spark.sparkContext.master
    return master.startswith("local") and not master.startswith("local-cluster")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster names it; only when it is unset on a local master (tests) a
    folder of our own is created.  A cluster without one is refused: a folder
    on one machine is not shared.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        conf_dir = tempfile.mkdtemp(prefix="shelfsort-ckpt-", dir=os.environ.get("SHELFSORT_SCRATCH", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder.

    Survives executor loss (unlike ``localCheckpoint``) and keeps iterative
    plans (leader rounds) from growing without bound.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return _plain_estimate(df.checkpoint(eager=True))


MOST_BYTES = (1 << 63) - 1    # Spark's own estimate of a table it knows nothing about


def _plain_estimate(df: DataFrame) -> DataFrame:
    """A checkpoint without an estimate of its size beyond any real size.

    A checkpoint keeps its plan's estimate, and that of a join is the product of
    its sides'.  Over rounds of joins the number of its digits multiplies, until
    planning fills the driver's memory with a single number.
    """
    plan = df._jdf.queryExecution().logical()
    if int(plan.stats().sizeInBytes()) <= MOST_BYTES:
        return df
    jvm, session = df.sparkSession.sparkContext._jvm, df._jdf.sparkSession()
    plan = jvm.org.apache.spark.sql.execution.LogicalRDD(
        plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), plan.stream(),
        session, jvm.scala.Option.empty(), jvm.scala.Option.apply(plan.constraints()))
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(session, plan), df.sparkSession)


def _row_bytes(df: DataFrame):
    """Size of a row's values: text and binary by length, nested values by
    their JSON text, others 8 bytes."""
    parts = [F.lit(16)]
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.dataType.typeName() in ("string", "binary"):
            parts.append(F.coalesce(F.octet_length(c), F.lit(0)))
        elif f.dataType.typeName() in ("array", "map", "struct"):
            parts.append(F.coalesce(F.octet_length(F.to_json(F.struct(c.alias("v")))), F.lit(0)))
        else:
            parts.append(F.lit(8))
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total.cast("bigint")


def bounded_broadcast(df: DataFrame, max_rows: int, max_bytes: int = 256 << 20) -> DataFrame:
    """Broadcast ``df`` only if it is proven to hold at most ``max_rows`` rows
    and ``max_bytes`` bytes of values.

    The check reads at most ``max_rows + 1`` rows; above a bound the frame is
    returned unchanged and the planner shuffles (AQE may still pick a
    broadcast at run time from real sizes).
    """
    n, size = (df.limit(max_rows + 1).select(_row_bytes(df).alias("b"))
               .agg(F.count(F.lit(1)), F.coalesce(F.sum("b"), F.lit(0))).first())
    return F.broadcast(df) if n <= max_rows and size <= max_bytes else df


def dense_positions(df: DataFrame, order_cols: list, name: str) -> DataFrame:
    """Add ``name`` = 0-based position of each row in ``order_cols`` order.

    A distributed zip-with-index: one range-partitioned sort, a reliable
    checkpoint so partition ids stay fixed, then per-partition offsets (one
    row per partition, so broadcasting them is bounded).  No window over the
    whole table, no single task, nothing through the driver.
    """
    from pyspark.sql import Window

    s = (df.orderBy(*order_cols)
         .withColumn("_pid", F.spark_partition_id())
         .withColumn("_mid", F.monotonically_increasing_id()))
    s = cut_lineage(s)
    offs = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_c"), F.min("_mid").alias("_m0"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = offs.withColumn("_off", F.coalesce(F.sum("_c").over(w), F.lit(0)))
    return (s.join(F.broadcast(offs), "_pid")
            .withColumn(name, (F.col("_off") + F.col("_mid") - F.col("_m0")).cast("long"))
            .drop("_pid", "_mid", "_c", "_m0", "_off"))


def spread(df: DataFrame, factor: int = 2) -> DataFrame:
    """Round-robin a scan of fewer files than the cluster has cores to
    ``factor × defaultParallelism`` partitions.

    Expanding operators (gram explosion ×25 rows) must not run in the few
    tasks a small or single-row-group input gives.  The file list comes from
    the plan, so nothing runs to decide it; frames that are not read from
    files stay as they are.
    """
    target = df.sparkSession.sparkContext.defaultParallelism
    if 0 < len(df.inputFiles()) < target:
        return df.repartition(target * factor)
    return df


def ship_package(spark: SparkSession) -> None:
    """Ship this package to the executors' Python workers (``addPyFile``), so
    pandas UDFs defined here unpickle on any node, whatever the working
    directory.  Done once per SparkContext."""
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_shelfsort_shipped", False):
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    base = os.path.dirname(pkg)
    path = os.path.join(tempfile.mkdtemp(prefix="shelfsort-pkg-"), "shelfsort.zip")
    with zipfile.ZipFile(path, "w") as z:
        for d, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, base))
    sc.addPyFile(path)
    sc._shelfsort_shipped = True
