"""Mixing sources to target weights by Poisson replication.

A document of source s is repeated k times, k ~ Poisson(rate of s), where
rate = target rows of s / rows of s.  k comes from inverting the Poisson
distribution at a uniform number hashed from (seed, doc_id), so the draw is
repeatable, needs no state and does not depend on the partitioning.  Copies are
then put into one global random order by a hash of (seed, doc_id, copy): the
leading bits choose the partition, a sort inside it does the rest.

Everything is a DataFrame expression.  Distribution functions are made once per
source.  A rate above ``MAX_RATE`` is drawn as a sum of independent Poisson
parts of equal rate, which keeps exp(-rate) away from zero.

Defined cases: a null source is a source of its own; a source without a target
weight, or with a weight of null, zero or less, gets no copies; null texts are
repeated like others; rows that repeat a doc_id get the same number of copies;
an empty table gives an empty result.  Input columns are kept as they are.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsort.llm.common import fresh, partitions
from shelfsort.session import bounded_broadcast

MAX_RATE = 16.0
NULL_SOURCE = "\x00null"


def _id(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("null"))


def tempered_weights(sizes: DataFrame, exponent: float = 0.5) -> DataFrame:
    """Target weight of a source: its number of rows to the power ``exponent``."""
    return sizes.select("key", F.pow(F.col("n").cast("double"), F.lit(float(exponent))).alias("weight"))


def source_rates(docs: DataFrame, source: str, weights: DataFrame | None, rows_out: float | None,
                 exponent: float = 0.5) -> DataFrame:
    """key, rate, parts, cdf: one row per source."""
    sizes = docs.groupBy(F.coalesce(F.col(source).cast("string"), F.lit(NULL_SOURCE)).alias("key")).agg(
        F.count(F.lit(1)).alias("n"))
    if weights is None:
        weights = tempered_weights(sizes, exponent)
    else:
        s, w = weights.columns[:2]
        weights = (weights.groupBy(F.coalesce(F.col(s).cast("string"), F.lit(NULL_SOURCE)).alias("key"))
                   .agg(F.sum(F.col(w).cast("double")).alias("weight")))
    both = sizes.join(weights.where("weight > 0"), "key")
    mass, n = both.agg(F.sum("weight"), F.sum("n")).first()  # two numbers
    target = float(rows_out if rows_out is not None else n or 0)
    rate = F.col("weight") / F.lit(float(mass or 1.0)) * F.lit(target) / F.col("n")
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / F.lit(MAX_RATE))).cast("int")
    each = F.col("rate") / F.col("parts")
    # Terms until the rest is far below 2**-52, the step of the uniform numbers.
    terms = F.sequence(F.lit(1), (F.lit(40) + F.ceil(each * 8)).cast("int"))
    start = F.struct(F.exp(-each).alias("p"), F.exp(-each).alias("s"), F.array(F.exp(-each)).alias("c"))
    step = lambda a, k: F.struct(
        (a["p"] * each / k).alias("p"), (a["s"] + a["p"] * each / k).alias("s"),
        F.concat(a["c"], F.array(a["s"] + a["p"] * each / k)).alias("c"))
    return (both.select("key", rate.alias("rate")).withColumn("parts", parts)
            .withColumn("cdf", F.aggregate(terms, start, step, lambda a: a["c"])))


def uniform(seed: int, doc_id: Column, part: Column) -> Column:
    """52 bits of md5(seed:doc_id:part) as a number in [0, 1)."""
    text = F.concat_ws(":", F.lit(f"mix{seed}"), _id(doc_id), part.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix(docs: DataFrame, weights: DataFrame | None = None, rows_out: float | None = None, seed: int = 17,
        doc_id: str = "doc_id", source: str = "source", exponent: float = 0.5,
        copy: str = "copy", order: str = "mix_order") -> DataFrame:
    """The columns of ``docs``, then ``copy`` (0, 1, ...) and ``mix_order`` (the
    place in the global order, 32 hex digits); partitions and the rows in them
    are in that order.  ``weights`` has (source, weight); without it weights are
    row counts to the power ``exponent``.  ``rows_out``: expected rows, by
    default those of the sources with a weight."""
    copy, order = fresh(docs, copy), fresh(docs, order)
    rates = bounded_broadcast(source_rates(docs, source, weights, rows_out, exponent), 100_000)
    names = docs.columns
    key = fresh(docs, "key")
    rates = rates.select(F.col("key").alias(key), F.struct("parts", "cdf").alias(fresh(docs, "law")))
    law = rates.columns[1]
    with_law = docs.withColumn(key, F.coalesce(F.col(source).cast("string"), F.lit(NULL_SOURCE))).join(rates, key)
    times = F.aggregate(
        F.sequence(F.lit(1), F.col(law)["parts"]), F.lit(0),
        lambda total, i: total + F.size(F.filter(F.col(law)["cdf"], lambda c: c <= uniform(seed, F.col(doc_id), i))))
    n = partitions(docs.sparkSession)
    place = fresh(docs, "place")
    spread = (with_law.withColumn(copy, F.explode(F.sequence(F.lit(0), times)))
              .where(F.col(copy) < times)
              .withColumn(order, F.md5(F.concat_ws(":", F.lit(f"order{seed}"), _id(F.col(doc_id)), F.col(copy).cast("string")))))
    part = F.floor(F.conv(F.substring(F.col(order), 1, 8), 16, 10).cast("bigint") * F.lit(n) / F.lit(1 << 32)).cast("int")
    return (spread.select(*names, copy, order).withColumn(place, part)
            .repartitionById(n, F.col(place)).drop(place).sortWithinPartitions(order, copy))
