"""Row-wise cleaning, subsets, tallies and formats that analyses share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_defaults(df: DataFrame, defaults: dict[str, tuple]) -> DataFrame:
    """df with missing values replaced. defaults: column -> columns to fall back to, in order, and last a constant."""
    kinds = dict(df.dtypes)
    filled = {c: F.coalesce(F.col(c), *map(F.col, others), F.lit(constant)).cast(kinds[c]) for c, (*others, constant) in defaults.items()}
    return df.withColumns(filled)


def measured(df: DataFrame, *columns: str) -> DataFrame:
    """The rows in which none of the columns is missing."""
    return df.dropna(subset=list(columns))


def without_captures(df: DataFrame, captures: list[str], column: str = "capture") -> DataFrame:
    return df.where(~F.col(column).isin(captures)) if captures else df


def natural_items(index: DataFrame, synthetic: str = "DB4", source: str = "source") -> DataFrame:
    """Items that do not come from a synthetic source; left out before any pair is made."""
    return index.where(~F.col(source).contains(synthetic))


def indicator(column: str, value) -> Column:
    """1.0 where the column has the value, 0.0 elsewhere, where it is missing too."""
    return F.coalesce((F.col(column) == F.lit(value)).cast("double"), F.lit(0.0))


def whole_number(column: str, default: int = 0) -> Column:
    return F.coalesce(F.expr(f"try_cast(`{column}` AS int)"), F.lit(default))


def half_even(column: Column, places: int = 0) -> Column:
    """Rounded to places, ties to the even neighbour."""
    return F.bround(column, places)


def clock(seconds: Column) -> Column:
    """A duration as hours, minutes and seconds."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%dh%02dm%02ds", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def status_tally(df: DataFrame, status: str = "status", flags: tuple[str, ...] = ()) -> DataFrame:
    """By status: rows, and how many of them carry each flag."""
    return df.groupBy(status).agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col(f).cast("long")).alias(f) for f in flags))


def throughput(df: DataFrame, by: list[str], seconds: str, done: Column) -> DataFrame:
    """By group: runs, mean seconds, and what is done in a second over all runs."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("runs"), F.avg(seconds).alias("mean_seconds"), (F.sum(done) / F.sum(seconds)).alias("per_second"))


def few_summary(df: DataFrame, by: list[str], value: str, few: int = 10) -> DataFrame:
    """By group: n, median, 5th and 95th percentile, and how many are below `few`."""
    p = F.percentile(value, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), p.alias("_p"), F.count_if(F.col(value) < few).alias(f"n_below_{few}"))
    return out.select(*by, "n", *(F.col("_p")[k].alias(c) for k, c in enumerate(("p5", "median", "p95"))), f"n_below_{few}")


def copies(df: DataFrame, content: str, key: str) -> DataFrame:
    """key, keep, n of the rows whose content others have as well: the least key of them, and how many there are.

    Contents are compared whole. Counting combines before the shuffle, and no row holds the members of a group.
    """
    groups = df.groupBy(F.col(content).alias("_c")).agg(F.min(key).alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return df.join(groups, F.col(content).eqNullSafe(F.col("_c"))).select(key, "keep", "n")
