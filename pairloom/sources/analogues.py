"""The driver's tables read as the engine's inputs.

impressions: an index with whole-number features. captures: observations per person, capture and
position. blocks: 8 x 8 block maps. See the README for what stands for what.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quantised(values) -> "F.Column":
    return F.transform(values, lambda x: F.floor(x.cast("double") * 1000 + 0.5).cast("long"))


def impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """idx, finger_id, source, key, person, hand, finger, q."""
    return as_impressions(read(spark, sf_dir, "embeddings"))


def as_impressions(embeddings: DataFrame) -> DataFrame:
    df = embeddings.select(F.col("vec_id").alias("idx"), F.col("label").cast("long").alias("finger_id"), (F.col("vec_id") % 4).alias("source"), quantised(F.col("embedding")).alias("q"))
    place = F.col("idx") % 10
    return df.withColumns({"key": F.concat_ws("/", "source", "finger_id"), "person": F.floor(F.col("idx") / 10), "hand": F.floor(place / 5), "finger": place % 5})


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """person, capture, position (0 to 9: five fingers of hand 0, then of hand 1), value, quality, area, contrast."""
    df = read(spark, sf_dir, "lineitem")
    position = F.dayofmonth("l_shipdate") % 2 * 5 + F.month("l_shipdate") % 5
    keys = [F.col("l_suppkey").alias("person"), F.concat("l_returnflag", "l_linestatus").alias("capture"), position.cast("int").alias("position")]
    # Whole cents and hundredths keep sums exact in any order.
    cents = lambda c: F.sum(F.round(F.col(c) * 100).cast("long")) / F.count(F.lit(1)) / 100
    return df.groupBy(*keys).agg(cents("l_extendedprice").alias("value"), cents("l_quantity").alias("quality"), F.count(F.lit(1)).alias("area"), cents("l_discount").alias("contrast"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image, r, c, dir (0 to 15, -1 invalid), quality, curved."""
    q = quantised(F.col("embedding"))
    cells = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"), F.posexplode(q).alias("at", "q"))
    size = F.abs("q")
    return cells.select(
        "image",
        F.floor(F.col("at") / 8).cast("int").alias("r"),
        (F.col("at") % 8).cast("int").alias("c"),
        F.when(size % 7 == 0, -1).otherwise(size % 16).cast("int").alias("dir"),
        (size % 5).cast("int").alias("quality"),
        (size % 3 == 1).cast("int").alias("curved"),
    )
