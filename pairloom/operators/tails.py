"""Histograms, percentiles, tails and agreement of pair scores.

Scores are whole numbers with few values, so ranks, percentiles and error rates come from the
histogram of scores (a map-side combined count), never from sorting the pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERCENTS = (50, 75, 90, 95, 99, 99.9, 99.99)


def histogram(edges: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    return edges.groupBy(*by, score).agg(F.count(F.lit(1)).alias("n"))


def zero_filled(hist: DataFrame, score: str = "score") -> DataFrame:
    """(score, n) for every score from 0 to the greatest."""
    every = hist.agg(F.max(score).alias("top")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("top"))).alias(score))
    return every.join(hist, score, "left").select(score, F.coalesce("n", F.lit(0)).alias("n"))


def discrete_percentiles(hist: DataFrame, by: list[str], percents=PERCENTS, score: str = "score") -> DataFrame:
    """by, percent, value: the least score whose cumulative count reaches the percentage of the total."""
    up = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("n").over(Window.partitionBy(*by))
    ranked = hist.withColumns({"upto": F.sum("n").over(up), "total": total})
    asked = ranked.withColumn("percent", F.explode(F.array(*(F.lit(float(p)) for p in percents))))
    return asked.where(F.col("upto") >= F.col("total") * F.col("percent") / 100).groupBy(*by, "percent").agg(F.min(score).alias("value"))


def summary(edges: DataFrame, by: list[str], score: str = "score", thresholds=(40,), percents=(50, 90, 99, 99.9), weight: str | None = None) -> DataFrame:
    """Count, mean, population deviation, greatest, interpolated percentiles, and count and share at or above thresholds.

    weight: how often each row counts, for histograms.
    """
    w, x = F.col(weight) if weight else F.lit(1), F.col(score).cast("double")
    n = F.sum(w)
    mean = F.sum(w * x) / n
    named = [n.cast("long").alias("n"), mean.alias("mean"), F.max(score).alias("top")]
    named.append((F.sqrt(F.greatest(F.sum(w * x * x) / n - mean * mean, F.lit(0.0))) if weight else F.stddev_pop(score)).alias("std"))
    named += [F.percentile(score, F.lit(p / 100), w).alias("p" + f"{p:g}".replace(".", "_")) for p in percents]
    for t in thresholds:
        reach = F.sum(F.when(F.col(score) >= t, w).otherwise(0))
        named += [reach.cast("long").alias(f"n_ge_{t}"), (reach / n).alias(f"share_ge_{t}")]
    return edges.groupBy(*by).agg(*named)


def match_rates(hist: DataFrame, score: str = "score") -> DataFrame:
    """(score, n, rate): the share of all counted pairs that score at least as much."""
    down = Window.orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, 0)
    return hist.select(score, "n", (F.sum("n").over(down) / F.sum("n").over(Window.partitionBy(F.lit(0)))).alias("rate"))


def top(edges: DataFrame, k: int, score: str = "score", ties=("i", "j")) -> DataFrame:
    return edges.orderBy(F.col(score).desc(), *ties).limit(k)


def ranked(edges: DataFrame, score: str, name: str, most: int) -> DataFrame:
    """The `most` best pairs with their rank from 0; ties in order of i and j."""
    best = top(edges, most, score)
    return best.withColumn(name, F.row_number().over(Window.orderBy(F.col(score).desc(), "i", "j")) - 1)


def places(rows: DataFrame, score: str, ties: list[str], name: str) -> DataFrame:
    """rows with their place from 1, best first, ties in the given order. Only the different scores meet in one task."""
    hist = rows.groupBy(score).agg(F.count(F.lit(1)).alias("_n"))
    better = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.join(hist.select(score, F.coalesce(better, F.lit(0)).alias("_better")), score)
    own = F.row_number().over(Window.partitionBy(score).orderBy(*ties))
    return rows.withColumn(name, F.col("_better") + own).drop("_better")


def overlap(a: DataFrame, b: DataFrame, rank_a: str, rank_b: str, sizes) -> DataFrame:
    """(k, common): how many of the k best pairs are the same, for ranked tables."""
    both = a.select("i", "j", rank_a).join(b.select("i", "j", rank_b), ["i", "j"])
    worst = F.greatest(rank_a, rank_b)
    counts = both.agg(*(F.count_if(worst < k).alias(str(k)) for k in sizes))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(str(k)).alias("common")) for k in sizes))).alias("r")).select("r.k", "r.common")


def either(a: DataFrame, b: DataFrame, rank_a: str, rank_b: str) -> DataFrame:
    """i, j, both ranks (null beyond its table) and best, the lesser: the pairs of either ranked table."""
    both = a.select("i", "j", rank_a).join(b.select("i", "j", rank_b), ["i", "j"], "full")
    return both.withColumn("best", F.least(rank_a, rank_b))


def binned(hist: DataFrame, by: list[str], score: str, low: float, high: float, bins: int) -> DataFrame:
    """by, bin, n: a histogram in bins of equal width from low to high; what lies beyond is in the bins at the ends."""
    place = F.floor((F.col(score) - low) / ((high - low) / bins))
    place = F.greatest(F.lit(0), F.least(place, F.lit(bins - 1))).cast("int")
    return hist.groupBy(*by, place.alias("bin")).agg(F.sum("n").alias("n"))


def first_seen(queues: list[DataFrame], key: list[str], order: str) -> DataFrame:
    """Rows of several queues, one after the other, each key where it first comes. order: place in its queue."""
    rows = None
    for number, q in enumerate(queues):
        q = q.withColumn("queue", F.lit(number))
        rows = q if rows is None else rows.unionByName(q)
    first = Window.partitionBy(*key).orderBy("queue", order)
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def mean_ranks(hist: DataFrame, by: list[str], score: str, name: str) -> DataFrame:
    """by, score, name: the mean rank (from 1) of equal scores."""
    up = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, 0)
    return hist.select(*by, score, (F.sum("n").over(up) - (F.col("n") - 1) / 2).alias(name))


def spearman(rows: DataFrame, by: list[str], a: str, b: str, weight: str | None = None) -> DataFrame:
    """by, n, rho: rank correlation of two columns with ties at mean ranks, from their joint histogram. weight: how often rows count.

    As in SQL, rho is not a number where one of the columns has a single value.
    """
    joint = rows.groupBy(*by, a, b).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n"))
    for c, name in ((a, "ra"), (b, "rb")):
        # Over the joint histogram, which is small, so that the rows are made once.
        upto = F.sum("n").over(Window.partitionBy(*by).orderBy(c).rangeBetween(Window.unboundedPreceding, Window.currentRow))
        joint = joint.withColumn(name, upto - (F.sum("n").over(Window.partitionBy(*by, c)) - 1) / 2)
    n, mean_a, mean_b = F.sum("n"), F.sum(F.col("n") * F.col("ra")) / F.sum("n"), F.sum(F.col("n") * F.col("rb")) / F.sum("n")
    cov = F.sum(F.col("n") * F.col("ra") * F.col("rb")) / n - mean_a * mean_b
    var_a, var_b = (F.sum(F.col("n") * F.col(r) * F.col(r)) / n - m * m for r, m in (("ra", mean_a), ("rb", mean_b)))
    varied = (F.min("ra") < F.max("ra")) & (F.min("rb") < F.max("rb"))
    return joint.groupBy(*by).agg(n.alias("n"), F.when(varied, F.try_divide(cov, F.sqrt(var_a * var_b))).otherwise(F.lit(float("nan"))).alias("rho"))


def mann_whitney(hist: DataFrame, first: Column, score: str = "score") -> DataFrame:
    """One row: sizes of the group `first` and the rest, U, AUC, Cliff's delta, and ties (the sum of t^3 - t over equal scores),
    from a histogram (score, n, group columns)."""
    both = hist.groupBy(score).agg(F.sum(F.when(first, F.col("n")).otherwise(0)).alias("n1"), F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy(score).rowsBetween(Window.unboundedPreceding, 0))
    sums = both.withColumn("r", upto - (F.col("n") - 1) / 2).agg(F.sum("n1").alias("n1"), (F.sum("n") - F.sum("n1")).alias("n2"), F.sum(F.col("n1") * F.col("r")).alias("r1"), F.sum(F.col("n").cast("double") ** 3 - F.col("n")).alias("ties"))
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    auc = u / (F.col("n1") * F.col("n2"))
    return sums.select("n1", "n2", u.alias("u"), auc.alias("auc"), (2 * auc - 1).alias("delta"), "ties")


def mann_whitney_z(hist: DataFrame, first: Column, score: str = "score") -> DataFrame:
    """One row: n1, n2, u and its normal deviates, one-sided (the group is greater) and two-sided, corrected for ties and continuity."""
    both = mann_whitney(hist, first, score)
    n, area = F.col("n1") + F.col("n2"), F.col("n1").cast("double") * F.col("n2")
    sd = F.sqrt(area / 12 * (n + 1 - F.col("ties") / (n.cast("double") * (n - 1))))
    z = lambda u: (u - area / 2 - 0.5) / sd
    return both.select("n1", "n2", "u", z(F.col("u")).alias("z_greater"), z(F.greatest(F.col("u"), area - F.col("u"))).alias("z_two"))


def mann_whitney_p(hist: DataFrame, first: Column, score: str = "score") -> DataFrame:
    """One row: u, p_greater and p_two."""
    from pairloom.functions.intervals import mann_whitney_p as p_value

    both = mann_whitney(hist, first, score)

    def run(batches):
        for pdf in batches:
            rows = list(zip(pdf["u"], pdf["n1"], pdf["n2"], pdf["ties"]))
            yield pdf[["u"]].assign(p_greater=[p_value(float(u), int(a), int(b), t, "greater") for u, a, b, t in rows], p_two=[p_value(float(u), int(a), int(b), t) for u, a, b, t in rows])

    return both.select(F.col("u").cast("double").alias("u"), "n1", "n2", "ties").mapInPandas(run, "u double, p_greater double, p_two double")


def cohens_d(hist: DataFrame, first: Column, value: str, weight: str = "n") -> DataFrame:
    """One row: sizes of the group `first` and the rest, and the difference of their means over the pooled sample deviation, from a histogram."""
    w, x, parts = F.col(weight), F.col(value).cast("decimal(38,0)"), []
    for k, own in ((1, first), (2, ~first)):
        of = lambda c, own=own: F.sum(F.when(own, c).otherwise(0))
        parts += [of(w).alias(f"n{k}"), of(w * x).alias(f"s{k}"), of(w * x * x).alias(f"q{k}")]
    d = lambda c: F.col(c).cast("double")
    spread = lambda k: d(f"q{k}") - d(f"s{k}") * d(f"s{k}") / d(f"n{k}")
    pooled = F.sqrt((spread(1) + spread(2)) / (F.col("n1") + F.col("n2") - 2))
    return hist.agg(*parts).select("n1", "n2", ((d("s1") / d("n1") - d("s2") / d("n2")) / pooled).alias("d"))


def growth_of_maximum(index: DataFrame, scorer, sizes: list[int], repeats: int, order, key: str = "person") -> DataFrame:
    """(k, reps, mean_top, std_top): the greatest score of items of different people among k people, over random samples.

    order(rep, person): the random key. A size that takes everybody has one sample. Tiles keep only their greatest score for each sample.
    """
    from pairloom.operators.pairs import best_of_samples

    people = index.select(key).distinct()
    everybody = people.count()
    smaller = [k for k in sizes if k < everybody]
    whole = best_of_samples(index.withColumn("_places", F.array(F.lit(1))), scorer, key, "_places", [1])
    tops = whole.select(F.lit(everybody).cast("int").alias("k"), "rep", "top")
    if smaller:
        # A sample's people are the first by a random order; Spark limits them in each task before they meet.
        dealt = people.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
        dealt = dealt.withColumn("place", F.row_number().over(Window.partitionBy("rep").orderBy(order(F.col("rep"), F.col(key)), key))).where(F.col("place") <= max(smaller))
        held = dealt.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("rep", "place"))).alias("_m"))
        places = F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), lambda r: F.coalesce(F.try_element_at("_m", r), F.lit(0)))
        # Only items of people in a sample make pairs.
        tops = tops.unionByName(best_of_samples(index.join(held, key).withColumn("_places", places), scorer, key, "_places", smaller))
    return tops.groupBy("k").agg(F.count(F.lit(1)).alias("reps"), F.avg("top").alias("mean_top"), F.stddev_pop("top").alias("std_top"))
