"""Registered queries of the corpus operators: each applies one operator, with
its production parameters, to its whole table."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsort.llm.common import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfsort.llm.exact_dedup import exact_dedup
    return exact_dedup(table(spark, sf_dir, "documents")).drop("n_points")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfsort.llm.mixing import mix
    return mix(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_mixing)}


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfsort.llm.decontaminate import decontaminate
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfsort.llm.line_dedup import line_dedup
    return line_dedup(table(spark, sf_dir, "documents")).drop("bitmap")


QUERIES |= {f.__name__: f for f in (op8_benchmark_decontamination, op9_line_dedup)}


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfsort.llm.warc import read_archives, write_archives
    return read_archives(write_archives(table(spark, sf_dir, "pages"))).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfsort.llm.toxicity import toxicity
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfsort.llm.ngram_join import jaccard_components
    return jaccard_components(table(spark, sf_dir, "documents"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfsort.llm.lm import score
    return score(table(spark, sf_dir, "documents"))


QUERIES |= {f.__name__: f for f in (op4_warc, op5_toxicity, op6_ngram_jaccard_join, op10_lm_scoring)}


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfsort.llm.html_text import extract
    return extract(table(spark, sf_dir, "pages"))


QUERIES |= {"op3_html_extraction": op3_html_extraction}


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfsort.llm.token_counts import count, edit, review_edits
    state = count(table(spark, sf_dir, "documents")).withColumn("edits", review_edits(F.col("doc_id"), F.col("text")))
    return edit(state, with_state=False)


QUERIES |= {"op7_token_counts": op7_token_counts}


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfsort.llm.conversations import repair
    return repair(table(spark, sf_dir, "conversations"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfsort.llm.whitening import whiten
    return whiten(table(spark, sf_dir, "embeddings"))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfsort.llm.pii import find, report
    return report(find(table(spark, sf_dir, "documents")))


QUERIES |= {f.__name__: f for f in (op11_conversation_repair, op12_embedding_whitening, op13_pii)}
