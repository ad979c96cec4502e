"""Ranks, copulas, correlations and information between positions of long observation tables.

Tables are long: a row per person and position (and whatever keys come before). Correlations come
from one shuffle by person, in which each person's few positions meet, and combinable sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.columns import gaussian_mi
from pairloom.functions.normal import normal_quantile
from pairloom.sources.files import cached
from pairloom.sources.scratch import scratch

POSITIONS = 10
#: Least eigenvalue of a correlation matrix whose determinant is taken.
LEAST_EIGENVALUE = 1e-8


#: Buckets that values are ranked in, and what the sketch that cuts them may be off by, as a share of a group.
BUCKETS, SKETCH = 64, 1000


def average_ranks(df: DataFrame, by: list[str], value: str, name: str = "rank", buckets: int = BUCKETS) -> DataFrame:
    """df with the mean rank (from 1) of value among the rows of its group, and the size of the group as name_n.

    Groups are cut by value into so many ranges, each with about as many different values, ranked each for itself and offset by
    what is below, so that a group of any size and any distribution is no single task's work. A missing value has no rank.
    """
    ranks = _counted(df, by, value, buckets).select(*by, value, (F.col("_below") + (F.col("_n") + 1) / 2).alias(name), F.col("_all").alias(f"{name}_n"))
    return df.join(ranks, [*by, value])


def bucketed(counts: DataFrame, by: list[str], value: str, buckets: int) -> DataFrame:
    """counts with _b, the range of its group that a value is in. Splitters come from a mergeable quantile sketch of the different values."""
    if buckets <= 1:
        return counts.withColumn("_b", F.lit(0))
    shares = F.array(*(F.lit(k / buckets) for k in range(1, buckets)))
    cuts = counts.groupBy(*by).agg(F.array_distinct(F.percentile_approx(value, shares, max(SKETCH, 10 * buckets))).alias("_cuts"))
    return counts.join(F.broadcast(cuts), by).withColumn("_b", F.size(F.filter("_cuts", lambda c: F.col(value) > c))).drop("_cuts")


def _counted(df: DataFrame, by: list[str], value: str, buckets: int) -> DataFrame:
    """by, value, _n, _below, _all: how often each value occurs in its group, how many rows are below it, and the group's size.

    Copies of a value are counted before they meet, and only sums of buckets meet in one task.
    """
    # A group is named by its columns, or all rows are one.
    key = by or ["_g"]
    counts = (df if by else df.withColumn("_g", F.lit(0))).where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count(F.lit(1)).alias("_n"))
    counts = bucketed(counts, key, value, buckets)
    group = Window.partitionBy(*key)
    sums = counts.groupBy(*key, "_b").agg(F.sum("_n").alias("_s"))
    before = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*key, "_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_off"), F.sum("_s").over(group).alias("_all"))
    inside = F.coalesce(F.sum("_n").over(Window.partitionBy(*key, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.join(sums, [*key, "_b"]).select(*by, value, "_n", (F.col("_off") + inside).alias("_below"), "_all")


def percentiles(df: DataFrame, by: list[str], value: str, shares: list[float], name: str = "cuts", buckets: int = BUCKETS) -> DataFrame:
    """by, name: the interpolated percentiles of value at the shares, in order. No group's values meet in one task."""
    counts = _counted(df, by, value, buckets)
    asked = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(float(p)).alias("p")) for k, p in enumerate(shares))))
    rows = counts.withColumn("_q", asked).withColumn("_at", (F.col("_all") - 1) * F.col("_q.p"))
    low, high = F.floor("_at"), F.ceil("_at")
    holds = lambda place: (place >= F.col("_below")) & (place < F.col("_below") + F.col("_n"))
    rows = rows.where(holds(low) | holds(high))
    found = rows.groupBy(*by, "_q.k").agg(F.max(F.when(holds(low), F.col(value))).alias("_a"), F.max(F.when(holds(high), F.col(value))).alias("_c"), F.first(F.col("_at") - low).alias("_f"))
    cut = F.col("_a") + (F.col("_c") - F.col("_a")) * F.col("_f")
    return found.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", cut.alias("v")))), lambda x: x["v"]).alias(name))


def numbered(df: DataFrame, key: str, name: str, buckets: int = BUCKETS) -> DataFrame:
    """df with its place from 0 in the order of a number that no two rows share."""
    return df.join(_counted(df, [], key, buckets).select(key, F.col("_below").alias(name)), key)


def copula(df: DataFrame, by: list[str], value: str = "value", buckets: int = BUCKETS) -> DataFrame:
    """df with z, the normal score of value within its group."""
    ranked = average_ranks(df, by, value, "_r", buckets).withColumn("_u", F.col("_r") / (F.col("_r_n") + 1))
    return ranked.withColumn("z", normal_quantile("_u")).drop("_r", "_r_n", "_u")


def position_pairs(df: DataFrame, by: list[str], value: str = "z") -> DataFrame:
    """by, pa < pb, za, zb: the values of each person at every pair of positions."""
    people = df.groupBy(*by, "person").agg(F.sort_array(F.collect_list(F.struct("position", F.col(value).alias("v")))).alias("x"))
    pairs = F.transform("x", lambda a: F.transform(F.filter("x", lambda b: b["position"] > a["position"]), lambda b: F.struct(a["position"].alias("pa"), b["position"].alias("pb"), a["v"].alias("za"), b["v"].alias("zb"))))
    return people.select(*by, F.explode(F.flatten(pairs)).alias("p")).select(*by, "p.*")


def correlations(df: DataFrame, by: list[str], value: str = "z") -> DataFrame:
    """by, pa, pb, n, rho; null where all values of a position are equal."""
    rho = F.try_divide(F.covar_pop("za", "zb"), F.stddev_pop("za") * F.stddev_pop("zb"))
    return position_pairs(df, by, value).groupBy(*by, "pa", "pb").agg(F.count(F.lit(1)).alias("n"), rho.alias("rho"))


def information(rhos: DataFrame) -> DataFrame:
    return rhos.withColumn("mi", gaussian_mi(F.col("rho")))


def position_pair_class():
    """homologous: the same finger of both hands; cross: other fingers of different hands; same_hand."""
    hand = lambda p: F.floor(F.col(p) / 5)
    return F.when(hand("pa") == hand("pb"), "same_hand").when(F.col("pa") % 5 == F.col("pb") % 5, "homologous").otherwise("cross")


def class_means(mi: DataFrame, by: list[str]) -> DataFrame:
    """by, homologous, cross, same_hand (means of mi), s, hand_effect, delta_mi."""
    kind = position_pair_class()
    named = {k: F.avg(F.when(kind == k, F.col("mi"))) for k in ("homologous", "cross", "same_hand")}
    rows = mi.groupBy(*by).agg(*(c.alias(k) for k, c in named.items()), F.avg(F.when(kind != "homologous", F.col("mi"))).alias("others"))
    return rows.select(
        *by,
        *named,
        (F.col("homologous") - F.col("cross")).alias("s"),
        (F.col("same_hand") - F.col("cross")).alias("hand_effect"),
        (F.col("homologous") - F.col("others")).alias("delta_mi"),
    )


def s_statistic(df: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """class_means of the copula of value; ranks are taken within by and position."""
    return class_means(information(correlations(copula(df, [*by, "position"], value), by)), by)


def complete(df: DataFrame, by: list[str], positions: int = POSITIONS) -> DataFrame:
    """The rows of people that have every position."""
    whole = df.groupBy(*by, "person").agg(F.countDistinct("position").alias("_k")).where(F.col("_k") == positions).drop("_k")
    return df.join(whole, [*by, "person"], "left_semi")


def across(df: DataFrame, ordered: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows of pairs of captures c1, c2: hand 0 as in c1 and hand 1 as in c2, of people complete in both, within by.

    ordered: both directions and each capture with itself; otherwise c1 < c2.
    """
    key = ["person", *by]
    has = df.select(*key, "capture").distinct()
    both = has.select(*key, F.col("capture").alias("c1")).join(has.select(*key, F.col("capture").alias("c2")), key)
    both = both if ordered else both.where("c1 < c2")
    sides = []
    for hand, own in ((0, "c1"), (1, "c2")):
        rows = df.where(F.floor(F.col("position") / 5) == hand).withColumnRenamed("capture", own)
        sides.append(both.join(rows, [*key, own]))
    return sides[0].unionByName(sides[1])


def s_between(df: DataFrame, value: str = "value", least: int = 2, by: tuple[str, ...] = ()) -> DataFrame:
    """by, c1, c2, n, s of complete rows; null where fewer than `least` people have both captures."""
    key = [*by, "c1", "c2"]
    # Ranks and rows both read what the joins made, so it is written once.
    rows = cached(df.sparkSession, scratch(df.sparkSession), lambda: across(df, by=by))
    n = rows.groupBy(*key).agg(F.countDistinct("person").alias("n"))
    return s_statistic(rows, key, value).join(n, key).select(*key, "n", F.when(F.col("n") >= least, F.col("s")).alias("s"))


def crossed_and_auto(pairs: DataFrame, by: tuple[str, ...] = (), middle=F.median) -> DataFrame:
    """by, crossed, auto, ratio of what s_between gives: the middle over different captures and over each with itself."""
    same = F.col("c1") == F.col("c2")
    crossed, auto = middle(F.when(~same, F.col("s"))), middle(F.when(same, F.col("s")))
    return pairs.groupBy(*by).agg(crossed.alias("crossed"), auto.alias("auto"), (crossed / auto).alias("ratio"))


def reliability(df: DataFrame, value: str = "value") -> DataFrame:
    """c1 < c2, n, r: the mean over positions of the information between the same position in two captures."""
    a = df.select("person", "position", F.col("capture").alias("c1"), F.col(value).alias("va"))
    b = df.select("person", "position", F.col("capture").alias("c2"), F.col(value).alias("vb"))
    key = ["c1", "c2", "position"]
    side = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("va").alias("v")), F.struct(F.lit(1).alias("side"), F.col("vb").alias("v"))))
    both = cached(df.sparkSession, scratch(df.sparkSession), lambda: a.join(b, ["person", "position"]).where("c1 < c2").select(*key, "person", side.alias("x")).select(*key, "person", "x.*"))
    scored = copula(both, [*key, "side"], "v").groupBy(*key, "person").agg(*(F.max(F.when(F.col("side") == k, F.col("z"))).alias(f"z{k}") for k in (0, 1)))
    rho = scored.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.corr("z0", "z1").alias("rho"))
    return information(rho).groupBy("c1", "c2").agg(F.max("n").alias("n"), F.avg("mi").alias("r"))


def log_determinant(r: np.ndarray) -> float:
    """Of a correlation matrix, its eigenvalues not below LEAST_EIGENVALUE."""
    if not len(r):
        return 0.0
    r = (r + r.T) / 2
    np.fill_diagonal(r, 1.0)
    return float(np.log(np.maximum(np.linalg.eigvalsh(r), LEAST_EIGENVALUE)).sum())


def total_correlation(r: np.ndarray) -> float:
    return max(0.0, -0.5 * log_determinant(r)) if len(r) > 1 else 0.0


def o_information(r: np.ndarray) -> float:
    k = len(r)
    if k <= 2:
        return 0.0
    without = sum(log_determinant(np.delete(np.delete(r, j, 0), j, 1)) for j in range(k))
    return 0.5 * (k - 2) * log_determinant(r) - 0.5 * without


#: A stack whose least eigenvalues are above this needs no floor, and its minors need none either.
WELL_CONDITIONED = 1e-6


def stacked_information(r: np.ndarray) -> tuple[np.ndarray, ...]:
    """tc, oinfo, logdet and inverse of a stack of correlation matrices of one size.

    The minors come from the inverse's diagonal, as their determinants are cofactors. Where a matrix is nearly singular the floor of
    the eigenvalues counts, and each of its minors is looked at for itself.
    """
    n, k = len(r), r.shape[1]
    values = np.linalg.eigvalsh(r)
    logdet = np.log(np.maximum(values, LEAST_EIGENVALUE)).sum(1)
    good = values[:, 0] > WELL_CONDITIONED
    inverse, minors = np.empty_like(r), np.empty(n)
    if good.any():
        inverse[good] = np.linalg.inv(r[good])
        minors[good] = k * logdet[good] + np.log(np.diagonal(inverse[good], axis1=1, axis2=2)).sum(1)
    if not good.all():
        inverse[~good] = np.linalg.pinv(r[~good], hermitian=True)
        minors[~good] = [sum(log_determinant(np.delete(np.delete(m, j, 0), j, 1)) for j in range(k)) for m in r[~good]]
    tc = np.maximum(0.0, -0.5 * logdet) if k > 1 else np.zeros(n)
    oinfo = 0.5 * (k - 2) * logdet - 0.5 * minors if k > 2 else np.zeros(n)
    return tc, oinfo, logdet, inverse


def matrix_information(rhos: DataFrame, by: list[str]) -> DataFrame:
    """by, k, tc, oinfo, logdet, inverse (rows of the inverse matrix, or of its pseudo-inverse with fewer people than positions) of each group's correlation matrix.

    A matrix is one row of at most 45 numbers; a task takes many rows as a stack.
    """
    kinds = dict(rhos.dtypes)
    rows = rhos.groupBy(*by).agg(F.collect_list(F.struct(F.col("pa").cast("int").alias("pa"), F.col("pb").cast("int").alias("pb"), F.col("rho").cast("double").alias("rho"))).alias("cells"))
    schema = ", ".join([*(f"`{b}` {kinds[b]}" for b in by), "k int, tc double, oinfo double, logdet double, inverse array<array<double>>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column("cells")
            cell, row = column.flatten(), np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
            a, b, rho = (cell.field(f).to_numpy(zero_copy_only=False) for f in ("pa", "pb", "rho"))
            sizes = np.zeros(len(column), int)
            np.maximum.at(sizes, row, np.maximum(a, b) + 1)
            found: list = [None] * len(column)
            for k in np.unique(sizes):
                at = np.flatnonzero(sizes == k)
                place = np.full(len(column), -1)
                place[at] = np.arange(len(at))
                own = place[row] >= 0
                r = np.tile(np.eye(k), (len(at), 1, 1))
                i = place[row[own]]
                r[i, a[own], b[own]] = r[i, b[own], a[own]] = np.nan_to_num(rho[own])
                for j, *values in zip(at, *stacked_information(r)):
                    found[j] = [int(k), *map(float, values[:3]), values[3].tolist()]
            columns = list(zip(*found))
            kinds_of = (pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in by), *(pa.array(c, t) for c, t in zip(columns, kinds_of))], names=[*by, "k", "tc", "oinfo", "logdet", "inverse"])

    return rows.mapInArrow(run, schema)


def pointwise_total_correlation(df: DataFrame, by: list[str], value: str = "z") -> DataFrame:
    """by, person, tc: what each person adds; the mean over people is the total correlation."""
    info = matrix_information(correlations(df, by, value), by)
    people = df.groupBy(*by, "person").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", F.col(value).alias("v")))), lambda x: x["v"]).alias("z"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    form = dot(F.transform("inverse", lambda row: dot(row, F.col("z"))), F.col("z")) - dot(F.col("z"), F.col("z"))
    return people.join(info, by).select(*by, "person", (-0.5 * F.col("logdet") - 0.5 * form).alias("tc"))


def standardised(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """df with z: value less its group's mean, over its population deviation."""
    w = Window.partitionBy(*by)
    return df.withColumn("z", (F.col(value) - F.avg(value).over(w)) / F.stddev_pop(value).over(w))


def total_correlation_of_three(rhos: DataFrame, by: list[str], positions=(0, 1, 2)) -> DataFrame:
    """by, tc of three positions, from the closed form of the determinant."""
    a, b, c = ((F.max(F.when((F.col("pa") == x) & (F.col("pb") == y), F.col("rho")))) for x, y in ((positions[0], positions[1]), (positions[0], positions[2]), (positions[1], positions[2])))
    det = 1 + 2 * F.col("a") * F.col("b") * F.col("c") - F.col("a") ** 2 - F.col("b") ** 2 - F.col("c") ** 2
    return rhos.groupBy(*by).agg(a.alias("a"), b.alias("b"), c.alias("c")).select(*by, F.greatest(F.lit(0.0), -0.5 * F.ln(det)).alias("tc"))
