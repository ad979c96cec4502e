"""Queries of observations, dependence, adjustment and resampling, with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from pairloom.functions.intervals import binomial_interval
from pairloom.functions.normal import normal_quantile_sql
from pairloom.operators import adjust, dependence, resample
from pairloom.plans.catalog import query
from pairloom.sources.analogues import observations, read
from pairloom.sources.files import cached
from pairloom.sources.scratch import scratch

OBS = """obs AS (SELECT l_suppkey AS person, l_returnflag || l_linestatus AS capture, CAST(day(l_shipdate) % 2 * 5 + month(l_shipdate) % 5 AS INTEGER) AS position,
    sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / count(*) / 100 AS value, sum(CAST(round(l_quantity * 100) AS BIGINT)) / count(*) / 100 AS quality,
    count(*) AS area, sum(CAST(round(l_discount * 100) AS BIGINT)) / count(*) / 100 AS contrast FROM lineitem GROUP BY 1, 2, 3),
    whole AS (SELECT obs.* FROM obs JOIN (SELECT person, capture FROM obs GROUP BY 1, 2 HAVING count(*) = 10) USING (person, capture))"""


def z_sql(source: str, by: str, value: str = "value", name: str = "z") -> str:
    """A subquery: source with the normal score of value within by."""
    u = f"(rank() OVER (PARTITION BY {by} ORDER BY {value}) + (count(*) OVER (PARTITION BY {by}, {value}) - 1) / 2) / (count(*) OVER (PARTITION BY {by}) + 1)"
    return f"(SELECT *, {normal_quantile_sql('u__')} AS {name} FROM (SELECT *, {u} AS u__ FROM {source}))"


MI = "-0.5 * ln(1 - least(1 - 1e-8, greatest(-1 + 1e-8, rho)) * least(1 - 1e-8, greatest(-1 + 1e-8, rho)))"
KIND = "CASE WHEN pa // 5 = pb // 5 THEN 'same_hand' WHEN pa % 5 = pb % 5 THEN 'homologous' ELSE 'cross' END"


def rho_sql(z: str, by: list[str], value: str = "z") -> str:
    keys = ", ".join(f"x.{b}" for b in by)
    same = " AND ".join(f"x.{b} = y.{b}" for b in ["person", *by])
    head = f"{keys}, " if by else ""
    return f"(SELECT {head}x.position AS pa, y.position AS pb, corr(x.{value}, y.{value}) AS rho FROM {z} x JOIN {z} y ON {same} AND x.position < y.position GROUP BY ALL)"


def means_sql(z: str, by: list[str], value: str = "z") -> str:
    """A subquery: by, homologous, cross_, same_hand, others of the copula table z."""
    head = "".join(f"{b}, " for b in by)
    return f"""(SELECT {head}avg(mi) FILTER (kind = 'homologous') AS homologous, avg(mi) FILTER (kind = 'cross') AS cross_, avg(mi) FILTER (kind = 'same_hand') AS same_hand,
        avg(mi) FILTER (kind <> 'homologous') AS others FROM (SELECT *, {MI} AS mi, {KIND} AS kind FROM {rho_sql(z, by, value)}) GROUP BY ALL)"""


BY, KEY = ["capture", "position"], ["capture", "person", "position"]


def whole(spark, sf_dir):
    return dependence.complete(observations(spark, sf_dir), ["capture"])


@query(f"WITH {OBS} SELECT capture, person, {', '.join(f'round(max(value) FILTER (position = {k}), 6) AS p{k}' for k in range(10))} FROM whole GROUP BY 1, 2")
def person_pivot(spark, sf_dir):
    wide = whole(spark, sf_dir).groupBy("capture", "person").pivot("position", list(range(10))).agg(F.first("value"))
    return wide.select("capture", "person", *(F.round(str(k), 6).alias(f"p{k}") for k in range(10)))


EVENTS = "ev AS (SELECT user_id AS person, event_type || '/' || event_id % 2 AS position FROM events)"


@query(f"WITH {EVENTS} SELECT person, count(*) AS n FROM ev WHERE person IN (SELECT person FROM ev GROUP BY 1 HAVING count(DISTINCT position) = 10) GROUP BY 1")
def complete_cases(spark, sf_dir):
    ev = read(spark, sf_dir, "events").select(F.col("user_id").alias("person"), F.concat_ws("/", "event_type", (F.col("event_id") % 2)).alias("position"))
    return dependence.complete(ev, []).groupBy("person").agg(F.count(F.lit(1)).alias("n"))


RANK = "rank() OVER (PARTITION BY capture, position ORDER BY area) + (count(*) OVER (PARTITION BY capture, position, area) - 1) / 2"


@query(f"WITH {OBS} SELECT capture, person, position, {RANK} AS rank FROM whole")
def avg_ranks(spark, sf_dir):
    return dependence.average_ranks(whole(spark, sf_dir), BY, "area", "rank").select(*KEY, "rank")


Z = f"{OBS}, z AS {z_sql('whole', 'capture, position')}"


@query(f"WITH {Z} SELECT capture, person, position, round(z, 9) AS z FROM z")
def copula(spark, sf_dir):
    return dependence.copula(whole(spark, sf_dir), BY).select(*KEY, F.round("z", 9).alias("z"))


@query(f"WITH {Z} SELECT capture, pa, pb, round(rho, 9) AS rho, round({MI}, 9) AS mi FROM {rho_sql('z', ['capture'])}")
def mi_matrix(spark, sf_dir):
    rhos = dependence.information(dependence.correlations(dependence.copula(whole(spark, sf_dir), BY), ["capture"]))
    return rhos.select("capture", "pa", "pb", F.round("rho", 9).alias("rho"), F.round("mi", 9).alias("mi"))


@query(f"WITH {Z} SELECT capture, round(homologous - others, 9) AS delta_mi FROM {means_sql('z', ['capture'])}")
def delta_mi(spark, sf_dir):
    return dependence.s_statistic(whole(spark, sf_dir), ["capture"]).select("capture", F.round("delta_mi", 9).alias("delta_mi"))


@query(f"WITH {OBS}, z AS {z_sql('whole', 'capture, position')} SELECT capture, round(homologous, 9) AS homologous, round(cross_, 9) AS crossed, round(same_hand, 9) AS same_hand, round(homologous - cross_, 9) AS s, round(same_hand - cross_, 9) AS hand_effect FROM {means_sql('z', ['capture'])}")
def s_statistic(spark, sf_dir):
    s = dependence.s_statistic(whole(spark, sf_dir), ["capture"])
    return s.select("capture", *(F.round(a, 9).alias(b) for a, b in (("homologous", "homologous"), ("cross", "crossed"), ("same_hand", "same_hand"), ("s", "s"), ("hand_effect", "hand_effect"))))


PAIRED = f"""{OBS}, has AS (SELECT DISTINCT person, capture FROM whole), both_ AS (SELECT a.person, a.capture AS c1, b.capture AS c2 FROM has a JOIN has b USING (person)),
    rows_ AS (SELECT b.c1, b.c2, person, position, value FROM both_ b JOIN whole w USING (person) WHERE w.capture = CASE WHEN position < 5 THEN b.c1 ELSE b.c2 END),
    zz AS {z_sql('rows_', 'c1, c2, position')}, m AS {means_sql('zz', ['c1', 'c2'])}"""


@query(f"WITH {PAIRED} SELECT c1, c2, n, round(homologous - cross_, 9) AS s FROM m JOIN (SELECT c1, c2, count(*) AS n FROM both_ GROUP BY 1, 2) USING (c1, c2)")
def s_cross_capture(spark, sf_dir):
    return dependence.s_between(whole(spark, sf_dir)).withColumn("s", F.round("s", 9))


@query(f"WITH {PAIRED} SELECT round(median(homologous - cross_) FILTER (c1 <> c2), 9) AS crossed, round(median(homologous - cross_) FILTER (c1 = c2), 9) AS auto, round(median(homologous - cross_) FILTER (c1 <> c2) / median(homologous - cross_) FILTER (c1 = c2), 6) AS ratio FROM m")
def capture_pair_median(spark, sf_dir):
    s = dependence.crossed_and_auto(dependence.s_between(whole(spark, sf_dir)))
    return s.select(F.round("crossed", 9).alias("crossed"), F.round("auto", 9).alias("auto"), F.round("ratio", 6).alias("ratio"))


@query(f"""WITH {OBS}, two AS (SELECT a.capture AS c1, b.capture AS c2, person, position, a.value AS va, b.value AS vb FROM whole a JOIN whole b USING (person, position) WHERE a.capture < b.capture),
    za AS {z_sql('two', 'c1, c2, position', 'va', 'za')}, zb AS {z_sql('(SELECT * EXCLUDE (u__) FROM za)', 'c1, c2, position', 'vb', 'zb')},
    r AS (SELECT c1, c2, position, count(*) AS n, corr(za, zb) AS rho FROM zb GROUP BY 1, 2, 3) SELECT c1, c2, max(n) AS n, round(avg({MI}), 9) AS r FROM r GROUP BY 1, 2""")
def reliability(spark, sf_dir):
    return dependence.reliability(whole(spark, sf_dir)).withColumn("r", F.round("r", 9))


@query(f"""WITH {OBS}, z AS {z_sql('whole', 'capture, position')}, r AS {rho_sql('z', ['capture'])},
    t AS (SELECT capture, max(rho) FILTER (pa = 0 AND pb = 1) AS a, max(rho) FILTER (pa = 0 AND pb = 2) AS b, max(rho) FILTER (pa = 1 AND pb = 2) AS c FROM r GROUP BY 1)
    SELECT capture, round(greatest(0, -0.5 * ln(1 + 2 * a * b * c - a * a - b * b - c * c)), 9) AS tc FROM t""")
def tc_k3(spark, sf_dir):
    rhos = dependence.correlations(dependence.copula(whole(spark, sf_dir), ["capture", "position"]), ["capture"])
    return dependence.total_correlation_of_three(rhos, ["capture"]).select("capture", F.round("tc", 9).alias("tc"))


def matrix_sql(rhos: str, by: str, k: int = 10, name: str = "") -> str:
    """Tables of SQL, their names ending in name: inv (by, i, j, v), the inverse of each correlation matrix, and det (by, ld), the logarithm of its determinant.

    Gauss and Jordan: each step takes one column out of the matrix beside the identity; the pivots multiply to the determinant.
    """
    side = f"(SELECT {by}, pa AS i, pb AS j, rho AS v FROM {rhos} UNION ALL SELECT {by}, pb, pa, rho FROM {rhos} UNION ALL SELECT {by}, d, d, 1.0 FROM (SELECT DISTINCT {by} FROM {rhos}), (SELECT unnest(range({k})) AS d))"
    out = [f"g0{name} AS MATERIALIZED (SELECT {by}, i, j, v FROM {side} UNION ALL SELECT {by}, a, b + {k}, CASE WHEN a = b THEN 1.0 ELSE 0.0 END FROM (SELECT DISTINCT {by} FROM {rhos}), (SELECT unnest(range({k})) AS a), (SELECT unnest(range({k})) AS b))"]
    for c in range(k):
        out.append(f"r{c}{name} AS MATERIALIZED (SELECT {by}, g.j, g.v / p.v AS v FROM g{c}{name} g JOIN (SELECT {by}, v FROM g{c}{name} WHERE i = {c} AND j = {c}) p USING ({by}) WHERE g.i = {c})")
        out.append(f"g{c + 1}{name} AS MATERIALIZED (SELECT {by}, g.i, g.j, CASE WHEN g.i = {c} THEN r.v ELSE g.v - f.v * r.v END AS v FROM g{c}{name} g JOIN r{c}{name} r USING ({by}, j) JOIN (SELECT {by}, i, v FROM g{c}{name} WHERE j = {c}) f USING ({by}, i))")
    pivots = " UNION ALL ".join(f"SELECT {by}, v FROM g{c}{name} WHERE i = {c} AND j = {c}" for c in range(k))
    return ", ".join([*out, f"inv{name} AS (SELECT {by}, i, j - {k} AS j, v FROM g{k}{name} WHERE j >= {k})", f"det{name} AS (SELECT {by}, sum(ln(v)) AS ld FROM ({pivots}) GROUP BY ALL)"])


#: A determinant without one position is that of all times the place of the inverse on the diagonal.
INFORMATION = "greatest(0, -0.5 * ld) AS tc, 4 * ld - 0.5 * (10 * ld + side) AS oinfo"
MATRICES = f"{Z}, rho_ AS MATERIALIZED {rho_sql('z', ['capture'])}, {matrix_sql('rho_', 'capture')}, side AS (SELECT capture, sum(ln(v)) AS side FROM inv WHERE i = j GROUP BY 1)"


@query(f"WITH {MATRICES} SELECT capture, 10 AS k, round(tc, 9) AS tc FROM (SELECT capture, {INFORMATION} FROM det JOIN side USING (capture))")
def tc_k10(spark, sf_dir):
    rhos = dependence.correlations(dependence.copula(whole(spark, sf_dir), ["capture", "position"]), ["capture"])
    return dependence.matrix_information(rhos, ["capture"]).select("capture", "k", F.round("tc", 9).alias("tc"))


@query(f"WITH {MATRICES} SELECT capture, 10 AS k, round(oinfo, 9) AS oinfo FROM (SELECT capture, {INFORMATION} FROM det JOIN side USING (capture))")
def oinfo(spark, sf_dir):
    rhos = dependence.correlations(dependence.copula(whole(spark, sf_dir), ["capture", "position"]), ["capture"])
    return dependence.matrix_information(rhos, ["capture"]).select("capture", "k", F.round("oinfo", 9).alias("oinfo"))


@query(f"""WITH {MATRICES}, form AS (SELECT a.capture, a.person, sum(a.z * v * b.z) AS q FROM z a JOIN z b USING (capture, person) JOIN inv ON inv.capture = a.capture AND i = a.position AND j = b.position GROUP BY 1, 2),
    own AS (SELECT capture, person, sum(z * z) AS q0 FROM z GROUP BY 1, 2)
    SELECT capture, person, round(-0.5 * ld - 0.5 * (q - q0), 6) AS tc FROM form JOIN own USING (capture, person) JOIN det USING (capture)""")
def pointwise_tc(spark, sf_dir):
    z = dependence.copula(whole(spark, sf_dir), ["capture", "position"]).select("capture", "person", "position", "z")
    return dependence.pointwise_total_correlation(z, ["capture"]).select("capture", "person", F.round("tc", 6).alias("tc"))


@query(f"WITH {OBS}, f AS (SELECT capture, position, regr_slope(value, quality) AS b, regr_intercept(value, quality) AS a FROM whole GROUP BY 1, 2) SELECT capture, person, position, round(value - a - b * quality, 4) AS residual FROM whole JOIN f USING (capture, position)")
def ols_residual_1cov(spark, sf_dir):
    return adjust.residuals_of_one(whole(spark, sf_dir), BY, "value", "quality").select(*KEY, F.round("residual", 4).alias("residual"))


@query(f"WITH {OBS} SELECT capture, position, count(*) AS n, round(regr_r2(value, quality), 9) AS r2 FROM whole GROUP BY 1, 2")
def r2_by_position(spark, sf_dir):
    fit = adjust.least_squares(whole(spark, sf_dir), ["capture", "position"], "value", ["quality"])
    return fit.select("capture", "position", "n", F.round("r2", 9).alias("r2"))


@query(f"""WITH {OBS}, c AS (SELECT capture, position, covar_pop(value, quality) AS y1, covar_pop(value, contrast) AS y2, var_pop(quality) AS s11, var_pop(contrast) AS s22, covar_pop(quality, contrast) AS s12,
        avg(value) AS my, avg(quality) AS m1, avg(contrast) AS m2 FROM whole GROUP BY 1, 2),
    b AS (SELECT *, (y1 * s22 - y2 * s12) / (s11 * s22 - s12 * s12) AS b1, (y2 * s11 - y1 * s12) / (s11 * s22 - s12 * s12) AS b2 FROM c)
    SELECT capture, person, position, round(value - my - b1 * (quality - m1) - b2 * (contrast - m2), 4) AS residual FROM whole JOIN b USING (capture, position)""")
def ols_residual_k(spark, sf_dir):
    return adjust.residuals(whole(spark, sf_dir), BY, "value", ["quality", "contrast"]).select(*KEY, F.round("residual", 4).alias("residual"))


@query(f"""WITH {OBS}, c AS (SELECT capture, position, quantile_cont(quality, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS cuts FROM whole GROUP BY 1, 2),
    s AS (SELECT whole.*, CAST(len(list_filter(cuts, lambda x: quality >= x)) AS INTEGER) AS stratum FROM whole JOIN c USING (capture, position))
    SELECT capture, person, position, stratum, round(value - avg(value) OVER (PARTITION BY capture, position, stratum), 4) AS residual FROM s""")
def decile_residual(spark, sf_dir):
    return adjust.stratum_residuals(whole(spark, sf_dir), BY, "value", "quality").select(*KEY, "stratum", F.round("residual", 4).alias("residual"))


def _term(j: int) -> str:
    cube = lambda k: f"power(greatest(quality - t[{k}], 0), 3)"
    return f"round(({cube(j)} - {cube(3)} * (t[4] - t[{j}]) / (t[4] - t[3]) + {cube(4)} * (t[3] - t[{j}]) / (t[4] - t[3])) / power(t[4] - t[1], 2), 6) AS b{j}"


@query(f"WITH {OBS}, k AS (SELECT capture, position, quantile_cont(quality, [0.05, 0.35, 0.65, 0.95]) AS t FROM whole GROUP BY 1, 2) SELECT capture, person, position, {_term(1)}, {_term(2)} FROM whole JOIN k USING (capture, position)")
def spline_basis(spark, sf_dir):
    return adjust.spline_basis(whole(spark, sf_dir), BY, "quality").select(*KEY, F.round("b1", 6).alias("b1"), F.round("b2", 6).alias("b2"))


def fit_sql(rows: str, name: str, xs: list[str], y: str = "value", by: str = "capture, position") -> str:
    """Tables of SQL: res_name (by, person, value), what y is above its least-squares fit on xs. Gauss and Jordan on the covariances."""
    k, every = len(xs), [*xs, y]
    cells = " UNION ALL ".join(f"SELECT {by}, {i} AS i, {j} AS j, covar_pop({every[i]}, {every[j]}) AS v FROM {rows} GROUP BY ALL" for i in range(k) for j in range(k + 1))
    out = [f"m0_{name} AS MATERIALIZED ({cells})"]
    for c in range(k):
        m = f"m{c}_{name}"
        out.append(f"p{c}_{name} AS MATERIALIZED (SELECT {by}, g.j, g.v / p.v AS v FROM {m} g JOIN (SELECT {by}, v FROM {m} WHERE i = {c} AND j = {c}) p USING ({by}) WHERE g.i = {c})")
        out.append(f"m{c + 1}_{name} AS MATERIALIZED (SELECT {by}, g.i, g.j, CASE WHEN g.i = {c} THEN r.v ELSE g.v - f.v * r.v END AS v FROM {m} g JOIN p{c}_{name} r USING ({by}, j) JOIN (SELECT {by}, i, v FROM {m} WHERE j = {c}) f USING ({by}, i))")
    slopes = ", ".join(f"max(v) FILTER (i = {i}) AS s{i}" for i in range(k))
    means = ", ".join(f"avg({c}) AS a{i}" for i, c in enumerate(every))
    fitted = " - ".join([f"{y} - a{k}", *(f"s{i} * ({c} - a{i})" for i, c in enumerate(xs))])
    out.append(f"res_{name} AS (SELECT {by}, person, {fitted} AS value FROM {rows} JOIN (SELECT {by}, {slopes} FROM m{k}_{name} WHERE j = {k} GROUP BY ALL) USING ({by}) JOIN (SELECT {by}, {means} FROM {rows} GROUP BY ALL) USING ({by}))")
    return ", ".join(out)


BASIS = "basis AS MATERIALIZED (SELECT capture, person, position, value, quality, contrast, {}, {} FROM whole JOIN (SELECT capture, position, quantile_cont(quality, [0.05, 0.35, 0.65, 0.95]) AS t FROM whole GROUP BY 1, 2) USING (capture, position))".format(*(re.sub(r"^round\((.*), 6\) AS", r"\1 AS", _term(j)) for j in (1, 2)))
FITS = {"linear": ["quality"], "spline": ["quality", "b1", "b2"], "spline_contrast": ["quality", "b1", "b2", "contrast"]}
VERSIONS = f"""{OBS}, {BASIS}, {', '.join(fit_sql('basis', n, xs) for n, xs in FITS.items())},
    cuts AS (SELECT capture, position, quantile_cont(quality, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS cuts FROM whole GROUP BY 1, 2),
    strata AS (SELECT capture, position, person, value, len(list_filter(cuts, lambda x: quality >= x)) AS stratum FROM whole JOIN cuts USING (capture, position)),
    v AS MATERIALIZED (SELECT 'raw' AS version, capture, position, person, value FROM whole {' '.join(f"UNION ALL SELECT '{n}', capture, position, person, value FROM res_{n}" for n in FITS)}
        UNION ALL SELECT 'strata', capture, position, person, value - avg(value) OVER (PARTITION BY capture, position, stratum) FROM strata),
    vary AS (SELECT version, capture, bool_and(varies) AS varies FROM (SELECT version, capture, position, min(value) < max(value) AS varies FROM v GROUP BY 1, 2, 3) GROUP BY 1, 2), zv AS {z_sql('v', 'version, capture, position')}"""


@query(f"WITH {VERSIONS} SELECT version, capture, CASE WHEN varies THEN round(homologous - cross_, 6) END AS s FROM vary JOIN {means_sql('zv', ['version', 'capture'])} USING (version, capture)")
def spline_residual_versions(spark, sf_dir):
    """S of the raw values, of linear, spline, stratum, and spline with contrast residuals, by capture; null where a position's residuals are all equal."""
    by = ["capture", "position"]
    # Five fits read it, so it is written once.
    df = cached(spark, scratch(spark), lambda: adjust.spline_basis(whole(spark, sf_dir), by, "quality"))
    versions = {"linear": ["quality"], "spline": ["quality", "b1", "b2"], "spline_contrast": ["quality", "b1", "b2", "contrast"]}
    out = df.select(F.lit("raw").alias("version"), "capture", "person", "position", "value")
    for name, xs in versions.items():
        out = out.unionByName(adjust.residuals(df, by, "value", xs, "res").select(F.lit(name).alias("version"), "capture", "person", "position", F.col("res").alias("value")))
    strata = adjust.stratum_residuals(df, by, "value", "quality", name="res")
    out = out.unionByName(strata.select(F.lit("strata").alias("version"), "capture", "person", "position", F.col("res").alias("value")))
    key = ["version", "capture"]
    vary = out.groupBy(*key, "position").agg((F.min("value") < F.max("value")).alias("varies")).groupBy(*key).agg(F.bool_and("varies").alias("varies"))
    s = dependence.s_statistic(out.join(vary.where("varies"), key, "left_semi"), key)
    return vary.join(s, key, "left").select(*key, F.round("s", 6).alias("s"))


@query(f"WITH {OBS} SELECT person % 2 AS sex, count(*) AS n, round(median(value), 6) AS median FROM whole GROUP BY 1")
def median_by_sex(spark, sf_dir):
    df = whole(spark, sf_dir).withColumn("sex", F.col("person") % 2)
    return adjust.median_by(df, ["sex"], "value").withColumn("median", F.round("median", 6))


# Resampling

#: The survey's count for fast tests (R4), by which p can be below 0.01.
ITER = 199
#: All ordered pairs of captures, and all pairs of items, are made anew for each of these.
CAPTURE_ITER, LABEL_ITER = 99, 99


def dealt_sql(z: str, by: str, seed: str) -> str:
    keys = "".join(f" || ':' || {b.strip()}" for b in by.split(",")) if by else ""
    part = f"{by}, position" if by else "position"
    return f"(SELECT * EXCLUDE (person), row_number() OVER (PARTITION BY {part} ORDER BY md5('{seed}'{keys} || ':' || position || ':' || person), person) AS person FROM {z})"


def null_sql(z: str, by: list[str], n: int, seed: str) -> str:
    head = "".join(f"{b}, " for b in by)
    rows = f"(SELECT {head}person, position, z, iter FROM {z}, (SELECT unnest(range({n})) AS iter))"
    return means_sql(dealt_sql(rows, ", ".join([*by, "iter"]), seed), [*by, "iter"])


@query(f"WITH {Z} SELECT capture, CAST(iter AS INTEGER) AS iter, round(homologous - cross_, 9) AS s FROM {null_sql('z', ['capture'], ITER, 'null')}")
def perm_null_s(spark, sf_dir):
    null = resample.permutation_null(whole(spark, sf_dir), ITER, by=("capture",))
    return null.select("capture", "iter", F.round("s", 9).alias("s"))


@query(f"""WITH {Z}, dealt AS MATERIALIZED {dealt_sql(f"(SELECT capture, person, position, z, iter FROM z, (SELECT unnest(range({ITER})) AS iter))", 'capture, iter', 'null')},
    rho_ AS MATERIALIZED {rho_sql('dealt', ['capture', 'iter'])}, {matrix_sql('rho_', 'capture, iter')}, side AS (SELECT capture, iter, sum(ln(v)) AS side FROM inv WHERE i = j GROUP BY 1, 2)
    SELECT capture, CAST(iter AS INTEGER) AS iter, round(tc, 9) AS tc, round(oinfo, 9) AS oinfo FROM (SELECT capture, iter, {INFORMATION} FROM det JOIN side USING (capture, iter))""")
def perm_null_information(spark, sf_dir):
    null = resample.information_null(whole(spark, sf_dir), ITER, by=("capture",))
    return null.select("capture", "iter", F.round("tc", 9).alias("tc"), F.round("oinfo", 9).alias("oinfo"))


def _two_sql() -> str:
    """both_N, det_N, point_N of two variables N, observed (iter -1) and dealt anew, and agreement: iter, n, rho."""
    out, key = [OBS], "capture, iter"
    for n, value, seed in ((1, "value", "a"), (2, "quality", "b")):
        dealt = dealt_sql(f"(SELECT capture, person, position, z, iter FROM z{n}, (SELECT unnest(range({ITER})) AS iter))", key, seed)
        out.append(f"z{n} AS MATERIALIZED (SELECT capture, person, position, z FROM {z_sql('whole', 'capture, position', value)})")
        out.append(f"both{n} AS MATERIALIZED (SELECT capture, -1 AS iter, person, position, z FROM z{n} UNION ALL SELECT capture, iter, person, position, z FROM {dealt})")
        out.append(f"rho{n} AS MATERIALIZED {rho_sql(f'both{n}', ['capture', 'iter'])}, {matrix_sql(f'rho{n}', key, name=f'_{n}')}")
        out.append(f"""point{n} AS MATERIALIZED (SELECT capture, iter, person, -0.5 * ld - 0.5 * (q - q0) AS tc FROM
            (SELECT a.capture, a.iter, a.person, sum(a.z * v * b.z) AS q FROM both{n} a JOIN both{n} b ON a.capture = b.capture AND a.iter = b.iter AND a.person = b.person
                JOIN inv_{n} m ON m.capture = a.capture AND m.iter = a.iter AND m.i = a.position AND m.j = b.position GROUP BY 1, 2, 3)
            JOIN (SELECT capture, iter, person, sum(z * z) AS q0 FROM both{n} GROUP BY 1, 2, 3) USING (capture, iter, person) JOIN det_{n} USING (capture, iter))""")
    rank = lambda c: f"rank() OVER (PARTITION BY x.capture, x.iter ORDER BY {c}) AS r_{c[0]}"
    out.append(f"agreement AS (SELECT capture, iter, count(*) AS n, corr(r_x, r_y) AS rho FROM (SELECT x.capture, x.iter, {rank('x.tc')}, {rank('y.tc')} FROM point1 x JOIN point2 y ON x.capture = y.capture AND x.iter = y.iter AND x.person = y.person) GROUP BY 1, 2)")
    return ", ".join(out)


TWO_VARIABLES = _two_sql()


@query(f"WITH {TWO_VARIABLES} SELECT capture, CAST(iter AS INTEGER) AS iter, n, round(rho, 9) AS rho FROM agreement")
def pointwise_agreement(spark, sf_dir):
    """Rank agreement between the value's and the quality's pointwise total correlation, observed and permuted."""
    df = whole(spark, sf_dir)
    tables = [dependence.copula(df, ["capture", "position"], v) for v in ("value", "quality")]
    return resample.agreement_null(*tables, ITER, ["capture"]).select("capture", "iter", "n", F.round("rho", 9).alias("rho"))


@query(f"""WITH {OBS}, z AS {z_sql('whole', 'capture, position')}, o AS (SELECT capture, homologous - cross_ AS s FROM {means_sql('z', ['capture'])}),
    n AS (SELECT capture, homologous - cross_ AS s FROM {null_sql('z', ['capture'], ITER, 'null')})
    SELECT capture, round(o.s, 9) AS observed, count(*) AS n, round((count_if(n.s >= o.s) + 1) / (count(*) + 1), 9) AS p, (count_if(n.s >= o.s) + 1) / (count(*) + 1) < 0.01 AS significant FROM o JOIN n USING (capture) GROUP BY 1, o.s""")
def empirical_p(spark, sf_dir):
    df = whole(spark, sf_dir)
    p = resample.empirical_p(resample.permutation_null(df, ITER, by=("capture",)), dependence.s_statistic(df, ["capture"]), ["capture"], "s")
    return p.select("capture", F.round("observed", 9).alias("observed"), "n", F.round("p", 9).alias("p"), (F.col("p") < 0.01).alias("significant"))


@query(f"WITH {Z} SELECT capture, false AS blind, round(homologous - cross_, 9) AS s FROM {means_sql('z', ['capture'])} UNION ALL SELECT capture, true, round(homologous - cross_, 9) FROM {means_sql(dealt_sql('z', 'capture', 'blind'), ['capture'])}")
def blind_mode(spark, sf_dir):
    df = whole(spark, sf_dir)
    seen, blind = (resample.s_of(df, blind=b, by=("capture",)).select("capture", F.lit(b).alias("blind"), F.round("s", 9).alias("s")) for b in (False, True))
    return seen.unionByName(blind)


BOOT = f"""{OBS}, two AS (SELECT * FROM whole WHERE capture IN ('AF', 'RF')), b AS (SELECT person FROM two GROUP BY 1 HAVING count(DISTINCT capture) = 2), k AS (SELECT person, row_number() OVER (ORDER BY person) - 1 AS k FROM b),
    d AS (SELECT iter, k AS draw, CAST('0x' || substring(md5('boot:' || iter || ':' || k), 1, 8) AS BIGINT) % (SELECT count(*) FROM b) AS pick FROM k, (SELECT unnest(range({ITER})) AS iter)),
    w AS (SELECT d.iter, p.c1, p.c2, d.draw AS person, position, value FROM d JOIN k ON k.k = d.pick JOIN two USING (person), (SELECT a AS c1, b AS c2 FROM (SELECT unnest(['AF', 'RF']) AS a), (SELECT unnest(['AF', 'RF']) AS b)) p
        WHERE two.capture = CASE WHEN position < 5 THEN p.c1 ELSE p.c2 END),
    zw AS {z_sql('w', 'iter, c1, c2, position')}, m AS (SELECT *, homologous - cross_ AS s FROM {means_sql('zw', ['iter', 'c1', 'c2'])}),
    r AS (SELECT iter, avg(s) FILTER (c1 = c2) AS auto, avg(s) FILTER (c1 <> c2) AS crossed FROM m GROUP BY 1)"""


@query(f"WITH {BOOT} SELECT CAST(iter AS INTEGER) AS iter, round(auto, 9) AS auto, round(crossed, 9) AS crossed, round(crossed / auto, 6) AS ratio FROM r")
def bootstrap_ratio(spark, sf_dir):
    r = resample.bootstrap_between(whole(spark, sf_dir), "AF", "RF", ITER)
    return r.select("iter", F.round("auto", 9).alias("auto"), F.round("crossed", 9).alias("crossed"), F.round("ratio", 6).alias("ratio"))


@query(f"""WITH {BOOT}, q AS (SELECT quantile_cont(crossed / auto, 0.025) AS low, quantile_cont(crossed / auto, 0.5) AS middle, quantile_cont(crossed / auto, 0.975) AS high FROM r)
    SELECT round(low, 6) AS low, round(middle, 6) AS middle, round(high, 6) AS high, CASE WHEN low > 0.5 THEN 'body' WHEN high < 0.5 THEN 'capture' ELSE 'inconclusive' END AS reading FROM q""")
def bootstrap_interval(spark, sf_dir):
    i = resample.interval(resample.bootstrap_between(whole(spark, sf_dir), "AF", "RF", ITER), "ratio")
    return i.select(*(F.round(c, 6).alias(c) for c in ("low", "middle", "high")), "reading")


def between_sql(rows: str) -> str:
    """A subquery: iter, c1, c2, s of a table (iter, capture, person, position, v)."""
    both = f"(SELECT DISTINCT a.iter, a.person, a.capture AS c1, b.capture AS c2 FROM {rows} a JOIN {rows} b ON a.iter = b.iter AND a.person = b.person)"
    w = f"(SELECT b.iter, b.c1, b.c2, b.person, position, v FROM {both} b JOIN {rows} w ON w.iter = b.iter AND w.person = b.person AND w.capture = CASE WHEN position < 5 THEN b.c1 ELSE b.c2 END)"
    return f"(SELECT iter, c1, c2, homologous - cross_ AS s FROM {means_sql(z_sql(w, 'iter, c1, c2, position', 'v'), ['iter', 'c1', 'c2'])})"


def _summary_sql(middle: str) -> str:
    crossed, auto = f"{middle}(s) FILTER (c1 <> c2)", f"{middle}(s) FILTER (c1 = c2)"
    return f"SELECT CAST(iter AS INTEGER) AS iter, round({crossed}, 9) AS crossed, round({auto}, 9) AS auto, round({crossed} / {auto}, 6) AS ratio"


def _rounded(rows):
    return rows.select("iter", F.round("crossed", 9).alias("crossed"), F.round("auto", 9).alias("auto"), F.round("ratio", 6).alias("ratio"))


def _captures_sql(where: str, n: int) -> str:
    return f"""{OBS}, z AS {z_sql(f'(SELECT * FROM whole WHERE {where})', 'capture, position')}, d AS MATERIALIZED (SELECT iter, capture, position, z AS v,
        row_number() OVER (PARTITION BY iter, capture, position ORDER BY md5('captures:' || iter || ':' || capture || ':' || position || ':' || person), person) AS person
        FROM z, (SELECT unnest(range({n})) AS iter)), s AS MATERIALIZED {between_sql('d')}"""


@query(f"WITH {_captures_sql("capture IN ('AF', 'RF')", ITER)} {_summary_sql('avg')} FROM s GROUP BY iter")
def two_capture_null(spark, sf_dir):
    return _rounded(resample.capture_null(whole(spark, sf_dir), ITER, ["AF", "RF"], middle=F.avg))


@query(f"WITH {_captures_sql('true', CAPTURE_ITER)} {_summary_sql('median')} FROM s GROUP BY iter")
def all_captures_null(spark, sf_dir):
    return _rounded(resample.capture_null(whole(spark, sf_dir), CAPTURE_ITER))


@query(f"""WITH {OBS}, b AS (SELECT DISTINCT person FROM whole), k AS (SELECT person, row_number() OVER (ORDER BY person) - 1 AS k FROM b),
    p AS (SELECT iter, k AS draw, CAST('0x' || substring(md5('joint:' || iter || ':' || k), 1, 8) AS BIGINT) % (SELECT count(*) FROM b) AS pick FROM k, (SELECT unnest(range({CAPTURE_ITER})) AS iter)),
    d AS MATERIALIZED (SELECT iter, draw AS person, capture, position, value AS v FROM p JOIN k ON k.k = p.pick JOIN whole USING (person)), s AS MATERIALIZED {between_sql('d')} {_summary_sql('median')} FROM s GROUP BY iter""")
def joint_bootstrap(spark, sf_dir):
    return _rounded(resample.joint_bootstrap(whole(spark, sf_dir), CAPTURE_ITER))


@query(f"WITH {OBS}, k AS (SELECT 'all' AS state, * FROM whole UNION ALL SELECT 'kept', * FROM whole WHERE person NOT IN (3, 7)), z AS {z_sql('k', 'state, capture, position')} SELECT state, capture, round(homologous - cross_, 9) AS s FROM {means_sql('z', ['state', 'capture'])}")
def sensitivity(spark, sf_dir):
    out = resample.sensitivity(whole(spark, sf_dir), spark.createDataFrame([(3,), (7,)], "person long"), lambda df: dependence.s_statistic(df, ["capture"]))
    return out.select("state", "capture", F.round("s", 9).alias("s"))


#: As many sets as the survey has (R14).
SETS, LEVEL = 200, 0.05
LOW, HIGH = binomial_interval(0.95, SETS, LEVEL)


@query(f"""WITH {Z}, d AS {dealt_sql(f'(SELECT capture, person, position, z, set_no FROM z, (SELECT unnest(range({SETS})) AS set_no))', 'capture, set_no', 'set')},
    o AS (SELECT capture, set_no, homologous - cross_ AS s FROM {means_sql('d', ['capture', 'set_no'])}), zd AS {z_sql('(SELECT capture, set_no, person, position, z AS v FROM d)', 'capture, set_no, position', 'v')},
    n AS (SELECT capture, set_no, homologous - cross_ AS s FROM {null_sql('zd', ['capture', 'set_no'], ITER, 'calibrate')}),
    p AS (SELECT capture, set_no, (count_if(n.s >= o.s) + 1) / (count(*) + 1) AS p FROM o JOIN n USING (capture, set_no) GROUP BY 1, 2)
    SELECT capture, count(*) AS sets, CAST(count_if(p <= {LEVEL}) AS BIGINT) AS rejected, count_if(p <= {LEVEL}) BETWEEN {LOW} AND {HIGH} AS calibrated FROM p GROUP BY 1""")
def calibration(spark, sf_dir):
    p = resample.calibration(whole(spark, sf_dir), SETS, ITER, LEVEL, by=("capture",))
    rejected = F.count_if(F.col("p") <= LEVEL)
    return p.groupBy("capture").agg(F.count(F.lit(1)).alias("sets"), rejected.alias("rejected"), rejected.between(LOW, HIGH).alias("calibrated"))


RHOS, REPS, POWER_LEVEL = [0.0, 0.3, 0.7], 3, 0.01


POWER_SQL = f"""{Z}, g AS (SELECT capture, person, position, z, effect, rep FROM z, (SELECT unnest([{', '.join(map(str, RHOS))}]::DOUBLE[]) AS effect), (SELECT unnest(range({REPS})) AS rep)),
    dealt AS (SELECT * EXCLUDE (person), row_number() OVER (PARTITION BY capture, effect, rep, position ORDER BY md5('base:' || capture || ':' || rep || ':' || position || ':' || person), person) AS person FROM g),
    f AS (SELECT *, (CAST('0x' || substring(md5('factor:' || capture || ':' || rep || ':' || position % 5 || ':' || person), 1, 8) AS BIGINT) + 0.5) / 4294967296.0::DOUBLE AS uf FROM dealt),
    mixed AS (SELECT capture, effect, rep, person, position, sqrt(effect) * {normal_quantile_sql('uf')} + sqrt(1 - effect) * z AS v FROM f),
    zd AS {z_sql('mixed', 'capture, effect, rep, position', 'v')}, o AS (SELECT capture, effect, rep, homologous - cross_ AS s FROM {means_sql('zd', ['capture', 'effect', 'rep'])}),
    n AS (SELECT capture, effect, rep, homologous - cross_ AS s FROM {null_sql('zd', ['capture', 'effect', 'rep'], ITER, 'power')}),
    p AS (SELECT capture, effect, rep, (count_if(n.s >= o.s) + 1) / (count(*) + 1) AS p FROM o JOIN n USING (capture, effect, rep) GROUP BY 1, 2, 3),
    curve AS (SELECT capture, effect AS rho, count(*) AS reps, round(avg(CASE WHEN p <= {POWER_LEVEL} THEN 1.0 ELSE 0.0 END), 9) AS detected, round(avg(p), 9) AS mean_p FROM p GROUP BY 1, 2)"""


@query(f"WITH {POWER_SQL} SELECT * FROM curve")
def power_curve(spark, sf_dir):
    p = resample.power(whole(spark, sf_dir), RHOS, REPS, ITER, POWER_LEVEL, by=("capture",))
    return p.select("capture", "rho", "reps", F.round("detected", 9).alias("detected"), F.round("mean_p", 9).alias("mean_p"))


@query(f"WITH {POWER_SQL} SELECT capture, coalesce(CAST(min(rho) FILTER (detected >= 0.8) AS VARCHAR), '> ' || CAST(max(rho) AS VARCHAR)) AS rho FROM curve GROUP BY 1")
def power_threshold(spark, sf_dir):
    return resample.first_detected(resample.power(whole(spark, sf_dir), RHOS, REPS, ITER, POWER_LEVEL, by=("capture",)), by=("capture",))


@query("SELECT doc_id, place FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS place FROM documents) WHERE place <= 100")
def random_sample(spark, sf_dir):
    from pairloom.functions.columns import hash_order

    key = hash_order(F.lit("42"), "doc_id")
    picked = read(spark, sf_dir, "documents").select("doc_id", key.alias("key")).orderBy("key", "doc_id").limit(100)
    return picked.select("doc_id", F.row_number().over(Window.orderBy("key", "doc_id")).alias("place"))


def _label_sql() -> str:
    from pairloom.plans.pair_queries import ONE

    return f"""WITH {ONE}, grand AS (SELECT sum(similarity) AS total, count(*) AS n FROM e), same AS (SELECT i, j FROM e WHERE person_i = person_j),
    named AS (SELECT idx, row_number() OVER (ORDER BY idx) AS place FROM idx),
    m AS (SELECT iter, idx, row_number() OVER (PARTITION BY iter ORDER BY md5('label:' || iter || ':' || idx), idx) AS to_ FROM idx, (SELECT unnest(range({LABEL_ITER})) AS iter)),
    map_ AS (SELECT m.iter, m.idx, n.idx AS new FROM m JOIN named n ON n.place = m.to_),
    sums AS (SELECT a.iter, sum(similarity) AS total FROM same JOIN map_ a ON a.idx = same.i JOIN map_ b ON b.idx = same.j AND b.iter = a.iter JOIN e ON e.i = least(a.new, b.new) AND e.j = greatest(a.new, b.new) GROUP BY 1)
    SELECT CAST(iter AS INTEGER) AS iter, round(sums.total / (SELECT count(*) FROM same) - (grand.total - sums.total) / (grand.n - (SELECT count(*) FROM same)), 9) AS diff FROM sums, grand"""


@query(_label_sql())
def label_perm_null(spark, sf_dir):
    from pairloom.operators.scorers import similarity
    from pairloom.sources.analogues import impressions

    null = resample.label_null(impressions(spark, sf_dir), similarity, "person", LABEL_ITER)
    return null.select("iter", F.round("diff", 9).alias("diff"))
