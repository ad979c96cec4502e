"""Orientation fields on block grids: entropy, axial statistics, densities and singular points.

A field is a long table of blocks (image, r, c, dir, quality, curved); dir is 0 to 15 for axes in
steps of pi / 16, or -1. One shuffle by image serves every step.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_BLOCKS = 10
#: Cosines and sines are summed as whole numbers of this size, so sums are exact in any order.
UNIT = 10**12


def valid() -> Column:
    return (F.col("dir") >= 0) & (F.col("quality") > 0)


def _whole(c: Column) -> Column:
    return F.round(c * UNIT).cast("long")


def _double_angle() -> Column:
    return F.col("dir") * (F.pi() / 8)


def orientation_entropy(blocks: DataFrame) -> DataFrame:
    """image, n, entropy (nats) of the directions of valid blocks; null below LEAST_BLOCKS."""
    counts = blocks.where(valid()).groupBy("image", "dir").agg(F.count(F.lit(1)).alias("k"))
    sums = counts.groupBy("image").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.ln("k")).alias("s"))
    return sums.select("image", "n", F.when(F.col("n") >= LEAST_BLOCKS, F.ln("n") - F.col("s") / F.col("n")).alias("entropy"))


def axial_mean(blocks: DataFrame) -> DataFrame:
    """image, n, direction in [0, pi), coherence (resultant length), curved (share of curved blocks)."""
    sums = blocks.where(valid()).groupBy("image").agg(F.count(F.lit(1)).alias("n"), F.sum(_whole(F.cos(_double_angle()))).alias("c"), F.sum(_whole(F.sin(_double_angle()))).alias("s"), F.avg(F.col("curved").cast("double")).alias("curved"))
    enough = F.col("n") >= LEAST_BLOCKS
    c, s = F.col("c") / UNIT / F.col("n"), F.col("s") / UNIT / F.col("n")
    return sums.select("image", "n", F.when(enough, F.pmod(0.5 * F.atan2(s, c), F.pi())).alias("direction"), F.when(enough, F.sqrt(c * c + s * s)).alias("coherence"), F.when(enough, F.col("curved")).alias("curved"))


def density(blocks: DataFrame, minutiae: DataFrame, least_quality: int = 20) -> DataFrame:
    """image, area (valid blocks), minutiae (all), good (of sufficient quality), density; null without valid blocks."""
    area = blocks.groupBy("image").agg(F.count_if(valid()).alias("area"))
    found = minutiae.groupBy("image").agg(F.count(F.lit(1)).alias("minutiae"), F.count_if(F.col("quality") >= least_quality).alias("good"))
    both = area.join(found, "image", "left").fillna(0, ["minutiae", "good"])
    return both.select("image", "area", "minutiae", "good", F.when(F.col("area") > 0, F.col("good") / F.col("area")).alias("density"))


def contrast(blocks: DataFrame, pixels: DataFrame, size: int = 8) -> DataFrame:
    """image, n, quality (mean of valid blocks), contrast (population deviation of the grey of pixels in valid blocks, 0 if none).

    pixels: image, x, y, grey. A block covers size x size pixels; pixels outside the grid have none.
    """
    good = blocks.where(valid())
    inside = pixels.withColumns({"r": F.floor(F.col("y") / size).cast("int"), "c": F.floor(F.col("x") / size).cast("int")}).join(good.select("image", "r", "c"), ["image", "r", "c"])
    grey = inside.groupBy("image").agg(F.stddev_pop("grey").alias("contrast"))
    mean = blocks.groupBy("image").agg(F.count_if(valid()).alias("n"), F.avg(F.when(valid(), F.col("quality"))).alias("quality"))
    return mean.join(grey, "image", "left").select("image", "n", "quality", F.coalesce("contrast", F.lit(0.0)).alias("contrast"))


def _box(column: str) -> Column:
    """Sum over the 3 x 3 blocks around: across, then down; grids are whole rectangles."""
    return F.sum(column).over(Window.partitionBy("image", "r").orderBy("c").rowsBetween(-1, 1))


def _down(column: str) -> Column:
    return F.sum(column).over(Window.partitionBy("image", "c").orderBy("r").rowsBetween(-1, 1))


def smoothed(blocks: DataFrame) -> DataFrame:
    """image, r, c, theta in [0, pi), usable (valid and with 3 valid blocks around or more), interior (all 9 valid)."""
    ok = F.col("dir") >= 0
    df = blocks.select("image", "r", "c", ok.alias("ok"), ok.cast("long").alias("k"), F.when(ok, _whole(F.cos(_double_angle()))).otherwise(0).alias("u"), F.when(ok, _whole(F.sin(_double_angle()))).otherwise(0).alias("v"))
    df = df.withColumns({x: _box(x) for x in ("k", "u", "v")})
    df = df.withColumns({x: _down(x) for x in ("k", "u", "v")})
    theta = F.when((F.col("u") == 0) & (F.col("v") == 0), 0.0).otherwise(F.pmod(0.5 * F.atan2(F.col("v").cast("double"), F.col("u").cast("double")), F.pi()))
    usable = F.col("ok") & (F.col("k") >= 3)
    return df.select("image", "r", "c", F.when(usable, F.round(theta, 9)).otherwise(0.0).alias("theta"), usable.alias("usable"), (F.col("k") == 9).alias("interior"))


def _turn(d: Column) -> Column:
    x = d + F.pi() / 2
    return x - F.pi() * F.floor(x / F.pi()) - F.pi() / 2


def poincare_index(blocks: DataFrame) -> DataFrame:
    """image, r, c, turns: the index around the corner below and right of a block, where all four blocks are usable and interior."""
    right, below = Window.partitionBy("image", "r").orderBy("c"), Window.partitionBy("image", "c").orderBy("r")
    df = smoothed(blocks).select("image", "r", "c", F.struct("theta", (F.col("usable") & F.col("interior")).alias("ok")).alias("tl"))
    df = df.withColumn("tr", F.lead("tl").over(right)).withColumn("bl", F.lead("tl").over(below)).withColumn("br", F.lead("tr").over(below))
    loop = ["bl", "br", "tr", "tl", "bl"]
    turns = sum((_turn(F.col(f"{b}.theta") - F.col(f"{a}.theta")) for a, b in zip(loop, loop[1:])), F.lit(0.0)) / (2 * F.pi())
    whole = F.col("tl.ok") & F.col("tr.ok") & F.col("bl.ok") & F.col("br.ok")
    return df.where(whole).select("image", "r", "c", turns.alias("turns"))


def singular_points(blocks: DataFrame) -> DataFrame:
    """image, kind (core or delta), r, c (middle of the corner); images with LEAST_BLOCKS valid blocks or more."""
    enough = blocks.groupBy("image").agg(F.count_if(F.col("dir") >= 0).alias("k")).where(F.col("k") >= LEAST_BLOCKS).select("image")
    kind = F.when(F.abs(F.col("turns") - 0.5) < 0.2, "core").when(F.abs(F.col("turns") + 0.5) < 0.2, "delta")
    points = poincare_index(blocks).select("image", kind.alias("kind"), (F.col("r") + 0.5).alias("r"), (F.col("c") + 0.5).alias("c"))
    return points.where("kind is not null").join(enough, "image", "left_semi")


def greedy_clusters(points: np.ndarray, reach: float = 2.5) -> np.ndarray:
    """Centres of clusters; each point in turn joins the first cluster whose centre is within reach, or starts one."""
    sums: list[np.ndarray] = []
    sizes: list[int] = []
    for p in points:
        near = [k for k, (s, n) in enumerate(zip(sums, sizes)) if np.hypot(*(p - s / n)) <= reach]
        if near:
            sums[near[0]] = sums[near[0]] + p
            sizes[near[0]] += 1
        else:
            sums.append(np.array(p, float))
            sizes.append(1)
    return np.array([s / n for s, n in zip(sums, sizes)]).reshape(-1, 2)


def cancel_dipoles(cores: np.ndarray, deltas: np.ndarray, reach: float = 2.5) -> tuple[np.ndarray, np.ndarray]:
    """Each core that has a delta within reach goes, together with the first such delta."""
    left, kept = list(range(len(deltas))), []
    for k, core in enumerate(cores):
        near = [d for d in left if np.hypot(*(core - deltas[d])) <= reach]
        if near:
            left.remove(near[0])
        else:
            kept.append(k)
    return cores[kept], deltas[left]


def pattern(cores: np.ndarray, deltas: np.ndarray) -> str:
    if len(cores) >= 2 or (len(cores) == 1 and len(deltas) >= 2):
        return "whorl"
    if len(cores) == 1 and len(deltas) == 1:
        return "left_loop" if deltas[0][1] < cores[0][1] else "right_loop"
    return "arch" if not len(cores) and not len(deltas) else "undetermined"


def classes(blocks: DataFrame, reach: float = 2.5) -> DataFrame:
    """image, pattern, cores, deltas. An image has few points, so each is one small group."""
    points = singular_points(blocks)
    images = blocks.groupBy("image").agg((F.count_if(F.col("dir") >= 0) >= LEAST_BLOCKS).alias("enough"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["r", "c"])
        cores, deltas = (greedy_clusters(pdf.loc[pdf["kind"] == k, ["r", "c"]].to_numpy(), reach) for k in ("core", "delta"))
        cores, deltas = cancel_dipoles(cores, deltas, reach)
        return pd.DataFrame({"image": [pdf["image"].iloc[0]], "pattern": [pattern(cores, deltas)], "cores": [len(cores)], "deltas": [len(deltas)]})

    found = points.groupBy("image").applyInPandas(one, "image long, pattern string, cores int, deltas int")
    named = F.when(~F.col("enough"), "undetermined").otherwise(F.coalesce("pattern", F.lit("arch")))
    return images.join(found, "image", "left").select("image", named.alias("pattern"), F.coalesce("cores", F.lit(0)).alias("cores"), F.coalesce("deltas", F.lit(0)).alias("deltas"))
