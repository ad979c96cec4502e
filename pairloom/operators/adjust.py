"""Adjustment for covariates: least squares by combinable sums, strata and splines.

A regression is solved from its normal equations, which are sums, so groups of any size cost one
row at the solver. The residuals are then arithmetic on the long table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.columns import positive_cube
from pairloom.operators.dependence import percentiles


def least_squares(df: DataFrame, by: list[str], y: str, xs: list[str]) -> DataFrame:
    """by, n, beta (intercept first), r2. Covariates are centred before the sums are taken."""
    kinds = dict(df.dtypes)
    every = [*xs, y]
    means = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"_m_{c}") for c in every))
    centred = df.join(means, by).select(*by, *(F.col(f"_m_{c}") for c in every), "n", *((F.col(c) - F.col(f"_m_{c}")).alias(f"_c_{c}") for c in every))
    products = [(i, j) for i in range(len(every)) for j in range(i, len(every))]
    sums = centred.groupBy(*by).agg(F.first("n").alias("n"), F.array(*(F.first(f"_m_{c}") for c in every)).alias("means"), F.array(*(F.sum(F.col(f"_c_{every[i]}") * F.col(f"_c_{every[j]}")) for i, j in products)).alias("products"))

    def solve(batches):
        for pdf in batches:
            betas, fits = [], []
            for means_, sums_ in zip(pdf["means"], pdf["products"]):
                s = np.zeros((len(every), len(every)))
                for (i, j), v in zip(products, sums_):
                    s[i, j] = s[j, i] = v
                slope = np.linalg.lstsq(s[:-1, :-1], s[:-1, -1], rcond=None)[0]
                betas.append([means_[-1] - float(np.dot(slope, means_[:-1])), *slope.tolist()])
                fits.append(float(slope @ s[:-1, -1] / s[-1, -1]) if s[-1, -1] else None)
            yield pd.DataFrame({**{b: pdf[b] for b in by}, "n": pdf["n"], "beta": betas, "r2": fits})

    return sums.mapInPandas(solve, ", ".join([*(f"`{b}` {kinds[b]}" for b in by), "n long, beta array<double>, r2 double"]))


def residuals(df: DataFrame, by: list[str], y: str, xs: list[str], name: str = "residual") -> DataFrame:
    """df with what y is above its fit on xs within its group."""
    fit = least_squares(df, by, y, xs).select(*by, F.col("beta").alias("_beta"))
    pred = F.element_at("_beta", 1)
    for k, x in enumerate(xs, 2):
        pred = pred + F.element_at("_beta", k) * F.col(x)
    return df.join(fit, by).withColumn(name, F.col(y) - pred).drop("_beta")


def residuals_of_one(df: DataFrame, by: list[str], y: str, x: str, name: str = "residual") -> DataFrame:
    """residuals for one covariate, without Python."""
    fit = df.groupBy(*by).agg(F.regr_slope(y, x).alias("_b"), F.regr_intercept(y, x).alias("_a"))
    return df.join(fit, by).withColumn(name, F.col(y) - F.col("_a") - F.col("_b") * F.col(x)).drop("_a", "_b")


def stratum_residuals(df: DataFrame, by: list[str], y: str, x: str, strata: int = 10, name: str = "residual") -> DataFrame:
    """y less its mean in its stratum of x; strata are cut at interpolated quantiles, a cut belongs to the stratum above it."""
    cuts = percentiles(df, by, x, [k / strata for k in range(1, strata)], "_cuts")
    df = df.join(cuts, by).withColumn("_s", F.size(F.filter("_cuts", lambda c: F.col(x) >= c)))
    means = df.groupBy(*by, "_s").agg(F.avg(y).alias("_m"))
    return df.join(means, [*by, "_s"]).withColumn(name, F.col(y) - F.col("_m")).withColumnRenamed("_s", "stratum").drop("_cuts", "_m")


def spline_basis(df: DataFrame, by: list[str], x: str, percents=(5, 35, 65, 95)) -> DataFrame:
    """df with b1, b2, ...: the terms of a restricted cubic spline of x besides x itself, knots at percentiles of each group."""
    k = len(percents)
    df = df.join(percentiles(df, by, x, [p / 100 for p in percents], "_t"), by)
    t = [F.element_at("_t", i + 1) for i in range(k)]
    cube = lambda i: positive_cube(F.col(x) - t[i])
    for j in range(k - 2):
        last = t[k - 1] - t[k - 2]
        term = cube(j) - cube(k - 2) * (t[k - 1] - t[j]) / last + cube(k - 1) * (t[k - 2] - t[j]) / last
        df = df.withColumn(f"b{j + 1}", term / (t[k - 1] - t[0]) ** 2)
    return df.drop("_t")


def median_by(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.median(value).alias("median"))


def demeaned(df: DataFrame, by: list[str], value: str, name: str = "residual") -> DataFrame:
    return df.withColumn(name, F.col(value) - F.avg(value).over(Window.partitionBy(*by)))
