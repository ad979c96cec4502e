"""Queries of observations have rows of every capture, and as many draws as the survey's fast tests."""

import pytest
from pyspark.sql import functions as F

from pairloom.plans import catalog
from pairloom.plans.dependence_queries import ITER, whole

BY_CAPTURE = "person_pivot avg_ranks copula mi_matrix delta_mi ols_residual_1cov ols_residual_k decile_residual spline_basis sensitivity perm_null_s blind_mode spline_residual_versions perm_null_information".split()


@pytest.mark.parametrize("name", BY_CAPTURE)
def test_every_capture(spark, sf_dir, name):
    found = {r.capture for r in whole(spark, sf_dir).select("capture").distinct().collect()}
    assert len(found) > 1
    assert {r.capture for r in catalog.QUERIES[name].build(spark, sf_dir).select("capture").distinct().collect()} == found


def test_p_against_its_null(spark, sf_dir):
    """p is counted by hand over 199 permutations, so it can reach 1 / 200."""
    null = [(r.capture, r.s) for r in catalog.QUERIES["perm_null_s"].build(spark, sf_dir).collect()]
    got = catalog.QUERIES["empirical_p"].build(spark, sf_dir).collect()
    assert got and ITER == 199
    for r in got:
        values = [s for c, s in null if c == r.capture]
        assert len(values) == r.n == 199
        assert r.p == pytest.approx((sum(s >= r.observed for s in values) + 1) / 200, abs=0.011)


@pytest.mark.parametrize("name", ["bootstrap_ratio", "two_capture_null", "perm_null_information"])
def test_draws(spark, sf_dir, name):
    rows = catalog.QUERIES[name].build(spark, sf_dir).agg(F.countDistinct("iter").alias("n")).first()
    assert rows.n == 199
