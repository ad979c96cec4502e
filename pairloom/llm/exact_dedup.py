"""Exact deduplication by skew-safe combining, in DataFrame operations only.

1. Local: rows with the same text in one input partition become one row (Spark's map-side
   partial aggregate, keyed by digest, salt and the whole text).
2. Salted: the salt is the input partition modulo the number of shuffle partitions, so that a
   text that a third of all rows share is merged by many tasks, each with few rows of it.
3. Global: the salt winners of a digest are merged, again by the whole text.

The digest only routes rows; which rows are equal is always decided by the text. Rows then learn
their group's winner by digest. Where one digest has several texts they are told apart by the text.

Defined cases: a null text counts as empty; null doc_ids lose to any other and a group of nothing
but null doc_ids has a null keep_id; every input row gets one row in `exact_groups`, repeated rows
too (rows that repeat the winner's doc_id and text are all marked kept); `exact_keep` returns
exactly one row per distinct text; an empty table gives an empty result; further columns, whatever
their names, pass through `exact_keep` untouched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import shuffle_partitions, staged


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _keyed(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), digest(text).alias("sha"))


def _salt(docs: DataFrame) -> Column:
    return F.spark_partition_id() % F.lit(shuffle_partitions(docs.sparkSession))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 (the digest): one row per input row.

    Of equal texts the row with the largest id stays. digest: of a text; it may have clashes.
    """
    keyed = _keyed(docs, id_col, text_col, digest)
    salted = (
        keyed.withColumn("salt", _salt(docs))
        .groupBy("sha", "salt", "text")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    )
    winners = salted.groupBy("sha", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    # Without the texts: one row per digest, which also tells whether the digest has several texts.
    groups = staged(
        winners.groupBy("sha").agg(F.count(F.lit(1)).alias("texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size")),
        "exact_groups",
    )
    single = groups.where("texts = 1").drop("texts")
    rows = keyed.select("doc_id", "sha").join(single, "sha")
    if not groups.where("texts > 1").isEmpty():
        several = groups.where("texts > 1").select("sha")
        told_apart = winners.join(several, "sha", "left_semi")
        rows = rows.unionByName(keyed.join(told_apart, ["sha", "text"]).drop("text"))
    return rows.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("doc_id").isNull() & F.col("keep_id").isNull()).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def exact_keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay: one per distinct text, that with the largest id.

    All columns of docs are returned. Equal ids are told apart by the other columns' order where
    they have one.
    """
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    packed = F.struct(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").isNotNull().alias("t"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    best = F.max("row") if not any("map<" in kind or kind == "variant" for _, kind in docs.dtypes) else F.max_by("row", F.col("row.i"))
    rows = docs.select(F.sha2(text, 256).alias("sha"), _salt(docs).alias("salt"), text.alias("text"), packed.alias("row"))
    won = rows.groupBy("sha", "salt", "text").agg(best.alias("row")).groupBy("sha", "text").agg(best.alias("row"))
    back = {c: F.col(f"row.c{k}").alias(c) for k, c in enumerate(others)}
    back |= {id_col: F.col("row.i").alias(id_col), text_col: F.when(F.col("row.t"), F.col("text")).alias(text_col)}
    return won.select(*(back[c] for c in docs.columns))
