"""Entropies of discrete variables with the Miller-Madow correction.

All the entropies that a statistic needs are one pass over the data, by grouping sets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def entropies(df: DataFrame, sets: list[list[str]]) -> DataFrame:
    """set_no, n, m (distinct values), h (nats, corrected, not below 0; 0 for a single row) of each set of columns."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    cells = df.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("k"))
    bits = {sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in s): number for number, s in enumerate(sets)}
    named = F.element_at(F.create_map(*(F.lit(x) for pair in bits.items() for x in pair)), F.col("gid").cast("int"))
    sums = cells.groupBy(named.alias("set_no")).agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("m"), F.sum(F.col("k") * F.ln("k")).alias("s"))
    h = F.ln("n") - F.col("s") / F.col("n") + (F.col("m") - 1) / (2 * F.col("n"))
    return sums.select("set_no", "n", "m", F.when(F.col("n") <= 1, 0.0).otherwise(F.greatest(F.lit(0.0), h)).alias("h"))


def _weighted(df: DataFrame, weighted: list[tuple[list[str], float]], name: str, floor: bool) -> DataFrame:
    sets = [s for s, _ in weighted]
    weights = F.element_at(F.array(*(F.lit(float(w)) for _, w in weighted)), F.col("set_no") + 1)
    total = F.sum(F.col("h") * weights)
    return entropies(df, sets).agg((F.greatest(F.lit(0.0), total) if floor else total).alias(name))


def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    if a == b:
        return _weighted(df, [([a], 1)], "mi", True)
    return _weighted(df, [([a], 1), ([b], 1), ([a, b], -1)], "mi", True)


def total_correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    return _weighted(df, [*(([c], 1) for c in columns), (columns, -1)], "tc", True)


def o_information(df: DataFrame, columns: list[str]) -> DataFrame:
    if len(columns) <= 2:
        return df.limit(0).agg(F.lit(0.0).alias("oinfo"))
    k = len(columns)
    without = [([x for x in columns if x != c], -1) for c in columns]
    return _weighted(df, [(columns, k - 2), *(([c], 1) for c in columns), *without], "oinfo", False)


def pointwise(df: DataFrame, columns: list[str], least: float = 1e-12) -> DataFrame:
    """Each distinct row of columns with its count n and the log ratio tc of its share to the product of its values' shares."""
    cells = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    total = cells.agg(F.sum("n").alias("_total"))
    out = cells.crossJoin(F.broadcast(total))
    log = F.ln(F.greatest(F.col("n") / F.col("_total"), F.lit(least)))
    for c in columns:
        shares = cells.groupBy(c).agg(F.sum("n").alias(f"_n_{c}"))
        out = out.join(shares, c)
        log = log - F.ln(F.greatest(F.col(f"_n_{c}") / F.col("_total"), F.lit(least)))
    return out.select(*columns, "n", log.alias("tc"))
