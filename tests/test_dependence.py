"""Analytic truths of the dependence estimators, on generated data."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairloom.functions.intervals import binomial_interval, clopper_pearson, mann_whitney_p
from pairloom.functions.normal import normal_quantile
from pairloom.operators import adjust, dependence, discrete, resample


def long_table(spark, matrix, **keys):
    n, k = matrix.shape
    pdf = pd.DataFrame({"person": np.repeat(np.arange(n), k), "position": np.tile(np.arange(k), n), "value": matrix.ravel()})
    return spark.createDataFrame(pdf.assign(**keys)).withColumn("position", F.col("position").cast("int"))


def equicorrelated(n, k, rho, seed=0):
    rng = np.random.default_rng(seed)
    return np.sqrt(rho) * rng.standard_normal((n, 1)) + np.sqrt(1 - rho) * rng.standard_normal((n, k))


def info(spark, matrix):
    z = dependence.copula(long_table(spark, matrix, g=0), ["g", "position"])
    return dependence.matrix_information(dependence.correlations(z, ["g"]), ["g"]).first(), z


def test_normal_quantile(spark):
    from statistics import NormalDist

    us = [1e-12, 1e-6, 0.001, 0.07, 0.3, 0.5, 0.77, 0.93, 0.9999, 1 - 1e-9]
    got = spark.createDataFrame([(u,) for u in us], "u double").select(normal_quantile("u").alias("z")).collect()
    assert np.allclose([r.z for r in got], [NormalDist().inv_cdf(u) for u in us], atol=1e-12)


def test_total_correlation_of_equicorrelated(spark):
    k, rho = 6, 0.35
    row, _ = info(spark, equicorrelated(20_000, k, rho))
    truth = -0.5 * np.log((1 - rho) ** (k - 1) * (1 + (k - 1) * rho))
    assert abs(row.tc - truth) < 0.03
    assert row.oinfo > 0


def test_independent(spark):
    row, _ = info(spark, np.random.default_rng(1).standard_normal((20_000, 6)))
    assert row.tc < 0.005 and abs(row.oinfo) < 0.005


def test_mean_of_pointwise_is_total(spark):
    row, z = info(spark, equicorrelated(3_000, 4, 0.4))
    z = dependence.standardised(z.drop("z").withColumn("value", F.col("value")), ["g", "position"], "value")
    whole = dependence.matrix_information(dependence.correlations(z, ["g"]), ["g"]).first()
    mean = dependence.pointwise_total_correlation(z, ["g"]).agg(F.avg("tc")).first()[0]
    assert mean == pytest.approx(whole.tc, abs=1e-8)


def test_pair_information(spark):
    x = equicorrelated(30_000, 2, 0.7)
    z = dependence.copula(long_table(spark, x), ["position"])
    mi = dependence.information(dependence.correlations(z, [])).first().mi
    assert abs(mi + 0.5 * np.log(1 - 0.49)) < 0.02
    assert dependence.o_information(np.eye(2)) == 0.0


@pytest.mark.parametrize("tail", ["one outlier", "powers", "copies"])
def test_buckets_are_even(spark, tail):
    """Whatever the distribution, no range has more than twice the mean of the different values."""
    n = 20_000
    x = {"one outlier": np.append(np.arange(n - 1.0), 1e15), "powers": 1.001 ** np.arange(n), "copies": np.append(np.arange(n / 2), np.zeros(n // 2))}[tail]
    counts = spark.createDataFrame(pd.DataFrame({"g": "a", "v": x})).groupBy("g", "v").agg(F.count(F.lit(1)).alias("_n"))
    sizes = [r["count"] for r in dependence.bucketed(counts, ["g"], "v", 64).groupBy("_b").count().collect()]
    assert sum(sizes) == len(np.unique(x)) and max(sizes) < 2 * len(np.unique(x)) / 64
    ranks = dependence.average_ranks(spark.createDataFrame(pd.DataFrame({"g": "a", "v": x})), ["g"], "v").toPandas().sort_values("v")
    assert np.allclose(ranks["rank"], pd.Series(np.sort(x)).rank())


def test_no_rank_without_a_value(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 2.0), ("b", None)], "g string, v double")
    assert sorted((r.g, r.v, r["rank"]) for r in dependence.average_ranks(df, ["g"], "v").collect()) == [("a", 1.0, 1.0), ("a", 2.0, 2.0)]


@pytest.mark.parametrize("buckets", [1, 7, 64])
def test_ranks_with_ties(spark, buckets):
    values = [5.0, 1.0, 1.0, 3.0, 5.0, 5.0, -2.0]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 4.0)], "g string, v double")
    got = {(r.g, r.v): (r["rank"], r.rank_n) for r in dependence.average_ranks(df, ["g"], "v", buckets=buckets).collect()}
    want = pd.Series(values).rank()
    assert all(got["a", v] == (want[k], 7) for k, v in enumerate(values))
    assert got["b", 4.0] == (1.0, 1)


def captures(spark, body: bool, n=600, noise=0.3, seed=2):
    rng = np.random.default_rng(seed)
    shared = rng.standard_normal((n, 5))
    out = None
    for c in ("U", "V"):
        trait = shared if body else rng.standard_normal((n, 5))
        rows = long_table(spark, np.hstack([trait, trait]) + noise * rng.standard_normal((n, 10)), capture=c)
        out = rows if out is None else out.unionByName(rows)
    return out


def test_body_symmetry_crosses_captures(spark):
    s = {(r.c1, r.c2): r.s for r in dependence.s_between(captures(spark, True)).collect()}
    assert s["U", "V"] > 0.1 and s["U", "V"] / s["U", "U"] > 0.7


def test_capture_symmetry_does_not(spark):
    s = {(r.c1, r.c2): r.s for r in dependence.s_between(captures(spark, False)).collect()}
    assert s["U", "U"] > 0.1 and abs(s["U", "V"]) < 0.05


def test_finger_order_matters(spark):
    rng = np.random.default_rng(3)
    trait = rng.standard_normal((600, 5))
    right = long_table(spark, np.hstack([trait, trait]) + 0.1 * rng.standard_normal((600, 10)))
    wrong = long_table(spark, np.hstack([trait, trait[:, ::-1]]) + 0.1 * rng.standard_normal((600, 10)))
    assert dependence.s_statistic(right, []).first().s > 0.5
    assert dependence.s_statistic(wrong, []).first().s < 0.1


def test_discrete_copies(spark):
    x = np.random.default_rng(4).choice(4, 3000, p=[0.1, 0.4, 0.3, 0.2])
    df = spark.createDataFrame(pd.DataFrame({c: x for c in "abcd"}))
    h = discrete.entropies(df, [["a"]]).first().h
    p = np.bincount(x) / len(x)
    assert h == pytest.approx(-(p * np.log(p)).sum() + 3 / (2 * len(x)), abs=1e-10)
    joint = discrete.entropies(df, [list("abcd")]).first().h
    assert discrete.total_correlation(df, list("abcd")).first().tc == pytest.approx(4 * h - joint, abs=1e-10)
    assert discrete.mutual_information(df, "a", "a").first().mi == pytest.approx(h, abs=1e-10)
    assert discrete.o_information(df, ["a", "b"]).first().oinfo == 0.0


def test_discrete_independent(spark):
    x = np.random.default_rng(5).integers(0, 3, (20_000, 4))
    assert discrete.total_correlation(spark.createDataFrame(pd.DataFrame(x, columns=list("abcd"))), list("abcd")).first().tc < 0.01


def test_least_squares(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((500, 3)) + 100
    y = 2 + x @ [1.0, -3.0, 0.5] + rng.standard_normal(500)
    df = spark.createDataFrame(pd.DataFrame({"g": 1, "y": y, "a": x[:, 0], "b": x[:, 1], "c": x[:, 2]}))
    want = np.linalg.lstsq(np.column_stack([np.ones(500), x]), y, rcond=None)[0]
    assert np.allclose(adjust.least_squares(df, ["g"], "y", ["a", "b", "c"]).first().beta, want, atol=1e-6)
    res = adjust.residuals(df, ["g"], "y", ["a", "b", "c"]).select("residual").toPandas().residual
    assert abs(res.mean()) < 1e-6


def test_permutation_keeps_values_and_breaks_dependence(spark):
    df = long_table(spark, np.hstack([equicorrelated(300, 5, 0.5)] * 2))
    dealt = resample.shuffled_positions(df, [], "s")
    same = lambda d: sorted((r.position, r.value) for r in d.collect())
    assert same(dealt) == same(df)
    p = resample.empirical_p(resample.permutation_null(df, 19), dependence.s_statistic(df, []), [], "s").first()
    assert p.p == pytest.approx(0.05) and p.n == 19
    assert resample.s_of(df, blind=False).first().s > 1 > resample.s_of(df).first().s


def test_reading_rule(spark):
    df = spark.createDataFrame([(0.6, 0.9), (0.1, 0.4), (0.44, 0.81)], "low double, high double")
    assert [r.r for r in df.select(resample.reading().alias("r")).collect()] == ["body", "capture", "inconclusive"]


def test_intervals():
    assert binomial_interval(0.95, 200, 0.05) == (4, 16)
    low, high = clopper_pearson(0, 10)
    assert low == 0 and high == pytest.approx(1 - 0.025 ** (1 / 10), abs=1e-9)
    assert mann_whitney_p(50.0, 10, 10) == pytest.approx(1.0)


@pytest.mark.parametrize("buckets", [1, 5, 64])
def test_percentiles_and_numbers(spark, buckets):
    rng = np.random.default_rng(2)
    groups = {"a": rng.integers(0, 9, 40).astype(float), "b": rng.standard_normal(101), "c": np.array([3.0])}
    df = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x] + [("a", None)], "g string, v double")
    shares = [0.0, 0.05, 0.5, 0.77, 1.0]
    got = {r.g: r.cuts for r in dependence.percentiles(df, ["g"], "v", shares, buckets=buckets).collect()}
    assert all(np.allclose(got[g], np.percentile(x, [100 * s for s in shares])) for g, x in groups.items())
    ids = rng.permutation(1000)[:200].tolist()
    rows = dependence.numbered(spark.createDataFrame([(i,) for i in ids], "id long"), "id", "k", buckets).collect()
    assert {r.id: r.k for r in rows} == {i: k for k, i in enumerate(sorted(ids))}
