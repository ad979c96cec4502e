"""Job 2: measures of texts and how they hang together, by language.

    python -m jobs.text_study --source DOCUMENTS --target OUT [--config FILE]

    OUT/features/lang=L              one row for each different text: the least id, its copies, its measures
    OUT/dependence/version=V/lang=L  n, rho and mi of every two measures

Every document is read whole and measured where it lies; only its digest and a handful of numbers move, and copies are
combined before they do. Measures become normal scores by rank within their language, so mi (in nats) does not
hang on their scale. Version raw takes them as they are, version adjusted what they are above a straight line in the logarithm of the
length. Partitions of languages that the input has are replaced, others stay, so a rerun, or a run over one language's
documents, is safe. Documents without an id, a language or words are left out; languages with too few texts have no dependence.
"""

from __future__ import annotations

import argparse
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import config, log, put, session
from pairloom.operators import adjust, cleaning, dependence

WORD = r"[^\x20\x09-\x0D]+"
#: Measures in the order of their numbers.
MEASURES = ("chars", "words", "lines", "word_length", "digits", "capitals", "marks", "distinct")
FEATURES = "doc_id long, copies long, " + ", ".join(f"{m} double" for m in MEASURES) + ", lang string"
DEPENDENCE = "a string, b string, n long, rho double, mi double, version string, lang string"


def measures(text: Column) -> dict[str, Column]:
    """Measures of a text that has a word."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    chars, n = F.char_length(text).cast("double"), F.size(words).cast("double")
    shown = {"chars": chars, "words": n, "lines": count(r"\n") + 1, "word_length": (chars - count(r"[\x20\x09-\x0D]")) / n, "digits": count("[0-9]") / chars}
    shown |= {"capitals": count("[A-Z]") / chars, "marks": count(r"[!-/:-@\[-`{-~]") / chars, "distinct": F.size(F.array_distinct(words)).cast("double") / n}
    return {m: shown[m] for m in MEASURES}


def features(docs: DataFrame) -> DataFrame:
    """doc_id, copies, the measures and lang of each different text; of equal texts of several languages the least id decides."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    docs = cleaning.measured(docs, "doc_id", "lang", "text").where(F.regexp_count("text", F.lit(WORD)) > 0)
    row = F.struct("doc_id", "lang", *(c.alias(m) for m, c in measures(F.col("text")).items()))
    one = docs.select(F.sha2("text", 256).alias("digest"), row.alias("r")).groupBy("digest").agg(F.min("r").alias("r"), F.count(F.lit(1)).alias("copies"))
    return one.select("r.doc_id", "copies", *(f"r.{m}" for m in MEASURES), "r.lang")


def hanging_together(table: DataFrame, least: int, covariate: str) -> DataFrame:
    """a, b, n, rho, mi, version, lang of every two measures."""
    whole = table.groupBy("lang").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= least).select("lang")
    listed = F.explode(F.array(*(F.struct(F.lit(k).alias("position"), F.col(m).alias("value")) for k, m in enumerate(MEASURES))))
    rows = table.join(F.broadcast(whole), "lang", "left_semi").select("lang", F.col("doc_id").alias("person"), F.ln(F.col(covariate) + 1).alias("size"), listed.alias("m")).select("lang", "person", "size", "m.*")
    kept = adjust.residuals_of_one(rows, ["lang", "position"], "value", "size", "kept").withColumn("kept", F.round("kept", 9))
    version = F.explode(F.array(F.struct(F.lit("raw").alias("version"), F.col("value").alias("x")), F.struct(F.lit("adjusted").alias("version"), F.col("kept").alias("x"))))
    by = ["version", "lang"]
    both = kept.select("lang", "person", "position", version.alias("v")).select("lang", "person", "position", "v.version", F.col("v.x").alias("value"))
    scored = dependence.copula(both, [*by, "position"])
    mi = dependence.information(dependence.correlations(scored, by))
    name = lambda c: F.element_at(F.array(*map(F.lit, MEASURES)), (F.col(c) + 1).cast("int"))
    return mi.select(name("pa").alias("a"), name("pb").alias("b"), "n", "rho", "mi", *by)


def run(spark: SparkSession, source: str, target: str, settings: dict[str, Any] | None = None) -> DataFrame:
    """The dependence of all languages that target has: a, b, n, rho, mi, version, lang."""
    settings = settings or config("text_study")
    docs = spark.read.parquet(source)
    if settings["languages"]:
        docs = docs.where(F.col("lang").isin(settings["languages"]))
    log.info("reads %s", source)
    put(features(docs), f"{target}/features", "lang")
    table = spark.read.schema(FEATURES).parquet(f"{target}/features")
    if settings["languages"]:
        table = table.where(F.col("lang").isin(settings["languages"]))
    log.info("measured: %s", {r.lang: (r.texts, r.documents) for r in table.groupBy("lang").agg(F.count(F.lit(1)).alias("texts"), F.sum("copies").alias("documents")).orderBy("lang").limit(100).collect()})
    put(hanging_together(table, settings["least_documents"], settings["adjust_for"]).coalesce(1), f"{target}/dependence", "version", "lang")
    return spark.read.schema(DEPENDENCE).parquet(f"{target}/dependence")


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("source", "target"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config")
    given = parser.parse_args()
    spark = session("text-study")
    try:
        log.info("%d rows of dependence", run(spark, given.source, given.target, config("text_study", given.config)).count())
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
