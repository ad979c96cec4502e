"""Job 1: all-against-all scores of an index that grows.

    python -m jobs.pair_scores --source IN --target OUT --checkpoint MARKS [--config FILE]

IN is a folder of Parquet files, or a pattern (a stream takes a single file only by one). New files are taken once, in batches, as a stream that ends when it has all. A batch's new items are scored
among themselves and against all items of earlier batches, and never anything twice:

    OUT/items/batch=N         the items that batch N brought, with their place in the index
    OUT/histogram/batch=N     scores of its pairs, by class
    OUT/best/batch=N          its best pairs of different items
    OUT/report/pair_class=C   score, n, rate (share of the class that scores at least as much) of all batches
    OUT/top                   the best pairs of all batches

Whatever breaks off a run, the next one does the batch it was in once more, into the same partitions, from items of
earlier batches only; the report is made anew from the partitions. So each pair counts once, and reruns change
nothing. An item whose id came before is not new. Rows with a null id, label or features are no items.
"""

from __future__ import annotations

import argparse
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobs.common import config, log, put, session
from pairloom.operators import dependence, pairs, tails
from pairloom.operators.scorers import similarity
from pairloom.sources.analogues import quantised

ITEMS = "idx long, item long, finger_id long, source long, q array<long>, batch long"
HISTOGRAM = "similarity long, n long, batch long, pair_class string"
BEST = "a long, b long, score long, batch long"


def _items(rows: DataFrame, settings: dict[str, Any]) -> DataFrame:
    """item, finger_id, source, q of the rows that are items, each id once."""
    named = {"item": F.col(f"`{settings['id']}`").cast("long"), "finger_id": F.col(f"`{settings['label']}`").cast("long"), "q": quantised(F.col(f"`{settings['features']}`"))}
    rows = rows.select(*(c.alias(n) for n, c in named.items())).dropna().where(F.forall("q", lambda x: x.isNotNull()))
    one = rows.groupBy("item").agg(F.min(F.struct("finger_id", "q")).alias("r"))
    return one.select("item", "r.finger_id", F.pmod("item", F.lit(settings["sources"])).cast("long").alias("source"), "r.q")


def score_batch(rows: DataFrame, number: int, target: str, settings: dict[str, Any]) -> int:
    """What one batch adds; how many new items it has. The same number writes the same partitions again."""
    spark = rows.sparkSession
    table = lambda name, schema: spark.read.schema(schema).parquet(f"{target}/{name}")
    found = _items(rows, settings)
    before = table("items", ITEMS).where(F.col("batch") < number) if number else spark.createDataFrame([], ITEMS)
    fresh = found.join(before.select("item"), "item", "left_anti")
    held = before.count()
    placed = dependence.numbered(fresh, "item", "place").select((F.col("place") + held).cast("long").alias("idx"), "item", "finger_id", "source", "q", F.lit(number).cast("long").alias("batch"))
    put(placed, f"{target}/items", "batch")
    # Read again, so that all that follows sees what was written.
    new = table("items", ITEMS).where(F.col("batch") == number)
    old = table("items", ITEMS).where(F.col("batch") < number)
    added = new.count()
    log.info("batch %d: %d new items, %d earlier ones", number, added, held)
    size, k = settings["tile_rows"], settings["best"]
    counts = [pairs.class_histogram(new, [similarity], pairs.THREE_WAY, tile_rows=size)]
    best = [pairs.best_pairs(new, [similarity], k, pairs.THREE_WAY, "impostor", tile_rows=size)]
    if held:
        counts.append(pairs.class_histogram(old, [similarity], pairs.THREE_WAY, tile_rows=size, against=new))
        best.append(pairs.best_pairs(old, [similarity], k, pairs.THREE_WAY, "impostor", tile_rows=size, against=new))
    both = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    mark = F.lit(number).cast("long").alias("batch")
    histogram = both(counts).groupBy("pair_class", "similarity").agg(F.sum("n").alias("n"))
    put(histogram.select("pair_class", "similarity", "n", mark).coalesce(1), f"{target}/histogram", "batch", "pair_class")
    names = table("items", ITEMS).select("idx", "item")
    listed = tails.top(both(best).withColumnRenamed("similarity", "score"), k)
    for end in ("i", "j"):
        listed = listed.join(names.select(F.col("idx").alias(end), F.col("item").alias(f"item_{end}")), end)
    put(listed.select(F.least("item_i", "item_j").alias("a"), F.greatest("item_i", "item_j").alias("b"), "score", mark).coalesce(1), f"{target}/best", "batch")
    return added


def report(spark: SparkSession, target: str, settings: dict[str, Any]) -> DataFrame:
    """The sums of all batches, written and read again."""
    histogram = spark.read.schema(HISTOGRAM).parquet(f"{target}/histogram").groupBy("pair_class", F.col("similarity").alias("score")).agg(F.sum("n").alias("n"))
    own = Window.partitionBy("pair_class")
    down = own.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    put(histogram.withColumn("rate", F.sum("n").over(down) / F.sum("n").over(own)), f"{target}/report", "pair_class", replace="static")
    top = tails.top(spark.read.schema(BEST).parquet(f"{target}/best").drop("batch"), settings["best"], ties=("a", "b"))
    top.write.mode("overwrite").parquet(f"{target}/top")
    return spark.read.schema("score long, n long, rate double, pair_class string").parquet(f"{target}/report")


def run(spark: SparkSession, source: str, target: str, checkpoint: str, settings: dict[str, Any] | None = None) -> DataFrame:
    """Take what is new in source; the report over everything that was ever taken: pair_class, score, n, rate."""
    settings = settings or config("pair_scores")
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", settings["files_per_batch"]).parquet(source)
    added: list[int] = []
    taken = stream.writeStream.foreachBatch(lambda rows, number: added.append(score_batch(rows, number, target, settings))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    taken.awaitTermination()
    log.info("read %s: %d batches with %d new items", source, len(added), sum(added))
    return report(spark, target, settings)


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("source", "target", "checkpoint"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config")
    given = parser.parse_args()
    spark = session("pair-scores")
    try:
        rows = run(spark, given.source, given.target, given.checkpoint, config("pair_scores", given.config))
        log.info("report of %d rows", rows.count())
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
