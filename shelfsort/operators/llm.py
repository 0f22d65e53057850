"""Reviewer / language-model layer as table jobs.

No network call runs inside a query.  ``request_table`` builds the chat
messages for every name still open; an outside service (or a person) answers
them into a ``(request_id, reply)`` table; the merge functions parse the
replies and join them back.  Request ids are SHA-256 of the request key, so
they are stable across runs and retries.
"""
from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import (CATEGORY_SYSTEM_PROMPT, CATEGORY_USER_PROMPT, MODEL_HINT_LINE, SUB_SYSTEM_PROMPT, SUB_USER_PROMPT,
                      TagConfig)
from ..functions.fuzz import token_sort_ratio_py
from ..functions.text import strip_ws

_MSG = "array<struct<role:string,content:string>>"


def request_id(*cols) -> Column:
    return F.sha2(F.concat_ws("\u0001", *cols), 256)


def numbered_list(items: Column) -> Column:
    """``"  1. A\\n  2. B"`` from an ordered array."""
    return F.array_join(F.transform(items, lambda c, i: F.concat(
        F.lit("  "), (i + 1).cast("string"), F.lit(". "), c)), "\n")


def fill(template: str, **values: Column) -> Column:
    """A text with ``{name}`` places as a column expression."""
    parts = re.split(r"\{(" + "|".join(values) + r")\}", template)
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def extract_reply(reply) -> Column:
    """First non-greedy ``{...}`` (dot matches newline) parsed as strict
    JSON: a variant, null when there is none or it does not parse."""
    j = F.regexp_extract(reply, r"(?s)\{.*?\}", 0)
    return F.try_parse_json(F.when(j != "", j))


def reply_field(parsed: Column, field: str) -> tuple[Column, Column]:
    """(value, kind) of a field of a parsed reply: the value as text, the kind
    as 'ABSENT', 'VOID' (JSON null), 'STRING', 'BOOLEAN', a number type, ..."""
    v = F.try_variant_get(parsed, f"$.{field}", "variant")
    kind = F.coalesce(F.schema_of_variant(v), F.lit("ABSENT"))
    return F.try_variant_get(parsed, f"$.{field}", "string"), kind


def _known_sorted(state) -> list:
    # the list goes into a prompt, so it is bounded by what a prompt can hold
    return [r[0] for r in state.known.orderBy("category").collect()]


def request_table(open_names: DataFrame, state, ml_hints: DataFrame | None = None) -> DataFrame:
    """L1: ``(request_id, product_name, messages)`` for open names; ``ml_hints``
    (name, ml_category) adds the weak model hint line."""
    cats = _known_sorted(state)
    cat_list = "\n".join(f"  {i + 1}. {c}" for i, c in enumerate(cats))
    df = open_names.select("name")
    if ml_hints is not None:
        df = df.join(ml_hints.select("name", "ml_category"), "name", "left")
    else:
        df = df.withColumn("ml_category", F.lit(None).cast("string"))
    hinted = F.col("ml_category").isNotNull() & (F.col("ml_category") != "")
    user = F.concat(fill(CATEGORY_USER_PROMPT, categories=F.lit(cat_list), name=F.col("name")),
                    F.when(hinted, fill(MODEL_HINT_LINE, category=F.col("ml_category"))).otherwise(F.lit("")))
    msgs = F.array(
        F.struct(F.lit("system").alias("role"), F.lit(CATEGORY_SYSTEM_PROMPT).alias("content")),
        F.struct(F.lit("user").alias("role"), user.alias("content")))
    return df.select(request_id("name").alias("request_id"), F.col("name").alias("product_name"),
                     msgs.cast(_MSG).alias("messages"))


def _best_choice_udf(choices: list):
    @F.pandas_udf(T.StructType([T.StructField("choice", T.StringType()),
                                T.StructField("score", T.DoubleType())]))
    def best(texts: pd.Series) -> pd.DataFrame:
        out_c, out_s = [], []
        for t in texts.tolist():
            bc, bs = None, -1.0
            for c in choices:
                s = token_sort_ratio_py(t or "", c)
                if s > bs:
                    bc, bs = c, s
            out_c.append(bc)
            out_s.append(bs)
        return pd.DataFrame({"choice": out_c, "score": out_s})
    return best


def merge_category_replies(open_names: DataFrame, replies: DataFrame, state,
                           cfg: TagConfig = TagConfig()) -> DataFrame:
    """L2 + J12: ``(name, llm_cat, llm_conf)`` for names with a usable reply.

    Reply without braces, bad JSON or a non-numeric confidence → no row (the
    name falls back).  Category is stripped; confidence defaults to 0.5.  A
    case-insensitive match to a known category gives its spelling; otherwise
    the known category with the best token-sort ratio (first on ties) at
    ``max(0.1, confidence − 0.2)``.
    """
    cats = _known_sorted(state)
    if not cats:
        return open_names.select("name").where(F.lit(False)).select(
            "name", F.lit(None).cast("string").alias("llm_cat"), F.lit(None).cast("double").alias("llm_conf"))
    lower_map = {}
    for c in cats:
        lower_map[c.lower()] = c
    lm = F.create_map(*[x for k, v in lower_map.items() for x in (F.lit(k), F.lit(v))])
    j = (open_names.select("name", request_id("name").alias("request_id"))
         .join(replies.select("request_id", "reply"), "request_id")
         .select("name", extract_reply(F.col("reply")).alias("m")).where(F.col("m").isNotNull()))
    cat, cat_kind = reply_field(F.col("m"), "category")
    conf, conf_kind = reply_field(F.col("m"), "confidence")
    # a category must be text; a confidence a number, numeric text or a truth value
    number = (F.when(conf_kind == "ABSENT", F.lit(0.5))
              .when(conf_kind == "BOOLEAN", (conf == "true").cast("double"))
              .when(~conf_kind.rlike("^(VOID|ARRAY|OBJECT)"), strip_ws(conf).try_cast("double")))
    j = j.where(cat_kind.isin("ABSENT", "STRING")).select(
        "name", strip_ws(F.coalesce(cat, F.lit(""))).alias("cat"), number.alias("conf"))
    j = j.where(F.col("conf").isNotNull())
    j = j.withColumn("canon", F.element_at(lm, F.lower("cat")))
    # only replies without a canonical spelling are compared, each distinct text once
    odd = j.where(F.col("canon").isNull())
    near = odd.select("cat").distinct().select("cat", _best_choice_udf(cats)("cat")["choice"].alias("near"))
    return j.where(F.col("canon").isNotNull()).select("name", F.col("canon").alias("llm_cat"), F.col("conf").alias("llm_conf")).unionByName(
        odd.join(near, "cat").select("name", F.col("near").alias("llm_cat"), F.greatest(F.lit(0.1), F.col("conf") - 0.2).alias("llm_conf")))


def sub_request_table(pairs: DataFrame, state) -> DataFrame:
    """L1 for sub-categories: one request per open (name, category) with the
    category's candidate list in table order."""
    cl = (state.candidates.groupBy("cat_key")
          .agg(F.sort_array(F.collect_list(F.struct("cand_ord", "candidate"))).alias("cs"))
          .select("cat_key", F.transform("cs", lambda x: x["candidate"]).alias("cands")))
    df = pairs.withColumn("cat_key", F.lower("category")).join(cl, "cat_key")
    user = fill(SUB_USER_PROMPT, name=F.col("name"), category=F.col("category"), candidates=numbered_list(F.col("cands")))
    msgs = F.array(
        F.struct(F.lit("system").alias("role"), F.lit(SUB_SYSTEM_PROMPT).alias("content")),
        F.struct(F.lit("user").alias("role"), user.alias("content")))
    return df.select(request_id("name", "category").alias("request_id"), F.col("name").alias("product_name"),
                     "category", msgs.cast(_MSG).alias("messages"))


def merge_sub_replies(pairs: DataFrame, replies: DataFrame, state) -> DataFrame:
    """L3: ``(name, category, llm_sub)``; known spelling when it matches a
    candidate case-insensitively (later duplicate wins), otherwise accepted
    as written; empty → no row."""
    j = (pairs.select("name", "category", request_id("name", "category").alias("request_id"))
         .join(replies.select("request_id", "reply"), "request_id")
         .select("name", "category", extract_reply(F.col("reply")).alias("m")).where(F.col("m").isNotNull()))
    sc, kind = reply_field(F.col("m"), "sub_category")
    j = j.where(kind == "STRING").select(
        "name", "category", F.lower("category").alias("cat_key"), strip_ws(sc).alias("sc"))
    j = j.where(F.col("sc") != "")
    cmap = (state.candidates.groupBy("cat_key", F.lower("candidate").alias("lc"))
            .agg(F.max_by("candidate", "cand_ord").alias("canon")))
    j = j.join(cmap, (j["cat_key"] == cmap["cat_key"]) & (F.lower(j["sc"]) == cmap["lc"]), "left")
    return j.select("name", "category", F.coalesce("canon", "sc").alias("llm_sub"))
