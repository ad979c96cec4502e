"""Queries of block maps and of discrete information, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pairloom.operators import discrete, fields
from pairloom.plans.catalog import query
from pairloom.sources.analogues import blocks, read

BLOCKS = """cells AS (SELECT vec_id AS image, unnest(range(64)) AS spot, unnest(list_transform(embedding, lambda x: CAST(abs(floor(CAST(x AS DOUBLE) * 1000 + 0.5)) AS BIGINT))) AS size FROM embeddings),
    b AS (SELECT image, CAST(spot // 8 AS INTEGER) AS r, CAST(spot % 8 AS INTEGER) AS c, CAST(CASE WHEN size % 7 = 0 THEN -1 ELSE size % 16 END AS INTEGER) AS dir, CAST(size % 5 AS INTEGER) AS quality, CAST(size % 3 = 1 AS INTEGER) AS curved, size FROM cells),
    v AS (SELECT * FROM b WHERE dir >= 0 AND quality > 0)"""
WHOLE = "CAST(round({f}(dir * (pi() / 8)) * 1000000000000) AS BIGINT)"
COS, SIN = WHOLE.format(f="cos"), WHOLE.format(f="sin")


@query(f"WITH {BLOCKS}, k AS (SELECT image, dir, count(*) AS k FROM v GROUP BY 1, 2) SELECT image, CAST(sum(k) AS BIGINT) AS n, CASE WHEN sum(k) >= 10 THEN round(ln(sum(k)) - sum(k * ln(k)) / sum(k), 9) END AS entropy FROM k GROUP BY 1")
def orientation_entropy(spark, sf_dir):
    return fields.orientation_entropy(blocks(spark, sf_dir)).withColumn("entropy", F.round("entropy", 9))


@query(f"""WITH {BLOCKS}, s AS (SELECT image, count(*) AS n, sum({COS}) / 1e12 / count(*) AS c, sum({SIN}) / 1e12 / count(*) AS s, avg(curved) AS curved FROM v GROUP BY 1)
    SELECT image, n, CASE WHEN n >= 10 THEN round(0.5 * atan2(s, c) - pi() * floor(0.5 * atan2(s, c) / pi()), 6) END AS direction, CASE WHEN n >= 10 THEN round(sqrt(c * c + s * s), 9) END AS coherence, CASE WHEN n >= 10 THEN round(curved, 9) END AS curved FROM s""")
def axial_mean(spark, sf_dir):
    m = fields.axial_mean(blocks(spark, sf_dir))
    return m.select("image", "n", F.round("direction", 6).alias("direction"), F.round("coherence", 9).alias("coherence"), F.round("curved", 9).alias("curved"))


@query(f"""WITH {BLOCKS} SELECT image, CAST(count_if(dir >= 0 AND quality > 0) AS BIGINT) AS area, CAST(count_if(curved = 1) AS BIGINT) AS minutiae, CAST(count_if(curved = 1 AND quality * 7 >= 20) AS BIGINT) AS good,
    CASE WHEN count_if(dir >= 0 AND quality > 0) > 0 THEN round(count_if(curved = 1 AND quality * 7 >= 20) / count_if(dir >= 0 AND quality > 0), 9) END AS density FROM b GROUP BY 1""")
def density(spark, sf_dir):
    b = blocks(spark, sf_dir)
    minutiae = b.where("curved = 1").select("image", (F.col("quality") * 7).alias("quality"))
    return fields.density(b, minutiae).withColumn("density", F.round("density", 9))


@query(f"""WITH {BLOCKS}, p AS (SELECT image, r, c, (r * 31 + c * 17 + dir * 7 + k * 5) % 256 AS grey FROM v, (SELECT unnest(range(4)) AS k))
    SELECT b.image, CAST(count_if(dir >= 0 AND quality > 0) AS BIGINT) AS n, round(avg(quality) FILTER (dir >= 0 AND quality > 0), 9) AS quality, round(coalesce(max(g.contrast), 0), 6) AS contrast
    FROM b LEFT JOIN (SELECT image, stddev_pop(grey) AS contrast FROM p GROUP BY 1) g ON g.image = b.image GROUP BY 1""")
def contrast(spark, sf_dir):
    b = blocks(spark, sf_dir)
    four = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")
    pixels = b.select("*", four).select("image", (F.col("c") * 8 + F.col("k") * 2).alias("x"), (F.col("r") * 8 + F.col("k")).alias("y"), F.pmod(F.col("r") * 31 + F.col("c") * 17 + F.col("dir") * 7 + F.col("k") * 5, F.lit(256)).alias("grey"))
    out = fields.contrast(b, pixels)
    return out.select("image", "n", F.round("quality", 9).alias("quality"), F.round("contrast", 6).alias("contrast"))


SMOOTH = f"""{BLOCKS}, w AS (SELECT image, r, c, dir >= 0 AS ok, CAST(dir >= 0 AS BIGINT) AS k, CASE WHEN dir >= 0 THEN {COS} ELSE 0 END AS u, CASE WHEN dir >= 0 THEN {SIN} ELSE 0 END AS v FROM b),
    s AS (SELECT x.image, x.r, x.c, x.ok, sum(y.k) AS k, CAST(sum(y.u) AS DOUBLE) AS u, CAST(sum(y.v) AS DOUBLE) AS v FROM w x JOIN w y ON x.image = y.image AND abs(x.r - y.r) <= 1 AND abs(x.c - y.c) <= 1 GROUP BY 1, 2, 3, 4),
    t AS (SELECT image, r, c, ok AND k >= 3 AND k = 9 AS ok, CASE WHEN NOT (ok AND k >= 3) OR (u = 0 AND v = 0) THEN 0.0 ELSE round(0.5 * atan2(v, u) - pi() * floor(0.5 * atan2(v, u) / pi()), 9) END AS th FROM s),
    q AS (SELECT tl.image, tl.r, tl.c, tl.th AS a, tr.th AS b, bl.th AS c_, br.th AS d FROM t tl JOIN t tr ON tr.image = tl.image AND tr.r = tl.r AND tr.c = tl.c + 1 JOIN t bl ON bl.image = tl.image AND bl.r = tl.r + 1 AND bl.c = tl.c
        JOIN t br ON br.image = tl.image AND br.r = tl.r + 1 AND br.c = tl.c + 1 WHERE tl.ok AND tr.ok AND bl.ok AND br.ok)"""


def _turn(d: str) -> str:
    return f"(({d}) + pi() / 2 - pi() * floor((({d}) + pi() / 2) / pi()) - pi() / 2)"


TURNS = f"({_turn('d - c_')} + {_turn('b - d')} + {_turn('a - b')} + {_turn('c_ - a')}) / (2 * pi())"


@query(f"WITH {SMOOTH} SELECT image, r, c, round({TURNS}, 6) + 0.0 AS turns FROM q")
def poincare_index(spark, sf_dir):
    return fields.poincare_index(blocks(spark, sf_dir)).select("image", "r", "c", (F.round("turns", 6) + 0.0).alias("turns"))


@query(f"WITH {SMOOTH}, p AS (SELECT image, {TURNS} AS turns FROM q), k AS (SELECT image, CASE WHEN abs(turns - 0.5) < 0.2 THEN 'core' WHEN abs(turns + 0.5) < 0.2 THEN 'delta' END AS kind FROM p) SELECT kind, count(*) AS n FROM k WHERE kind IS NOT NULL AND image IN (SELECT image FROM b WHERE dir >= 0 GROUP BY 1 HAVING count(*) >= 10) GROUP BY 1")
def singular_points(spark, sf_dir):
    return fields.singular_points(blocks(spark, sf_dir)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


FAR = "sqrt(power({0}, 2) + power({1}, 2)) <= 2.5"
#: Clusters and dipoles go point by point, so each is a recursion with a list as its state.
CLASSES = f"""WITH RECURSIVE {SMOOTH}, enough AS (SELECT image, count_if(dir >= 0) >= 10 AS enough FROM b GROUP BY 1),
    kinds AS (SELECT image, r + 0.5 AS r, c + 0.5 AS c, CASE WHEN abs(turns - 0.5) < 0.2 THEN 'core' WHEN abs(turns + 0.5) < 0.2 THEN 'delta' END AS kind FROM (SELECT image, r, c, {TURNS} AS turns FROM q)),
    points AS (SELECT image, kind, CAST(r AS DOUBLE) AS r, CAST(c AS DOUBLE) AS c, row_number() OVER (PARTITION BY image, kind ORDER BY r, c) AS seq FROM kinds WHERE kind IS NOT NULL AND image IN (SELECT image FROM enough WHERE enough)),
    grown AS (SELECT DISTINCT image, kind, CAST(0 AS BIGINT) AS step, CAST([] AS STRUCT(sr DOUBLE, sc DOUBLE, n BIGINT)[]) AS cl FROM points
        UNION ALL SELECT image, kind, step, CASE WHEN coalesce(near, 0) = 0 THEN list_append(cl, {{'sr': r, 'sc': c, 'n': CAST(1 AS BIGINT)}})
            ELSE list_transform(cl, lambda x, i: CASE WHEN i = near THEN {{'sr': x.sr + r, 'sc': x.sc + c, 'n': x.n + 1}} ELSE x END) END
        FROM (SELECT g.image, g.kind, p.seq AS step, g.cl, p.r, p.c, list_position(list_transform(g.cl, lambda x: {FAR.format('p.r - x.sr / x.n', 'p.c - x.sc / x.n')}), true) AS near
            FROM grown g JOIN points p ON p.image = g.image AND p.kind = g.kind AND p.seq = g.step + 1)),
    centres AS (SELECT image, kind, list_transform(cl, lambda x: {{'r': x.sr / x.n, 'c': x.sc / x.n}}) AS m FROM grown QUALIFY step = max(step) OVER (PARTITION BY image, kind)),
    sides AS (SELECT image, coalesce(max(m) FILTER (kind = 'core'), []) AS cores, coalesce(max(m) FILTER (kind = 'delta'), []) AS deltas FROM centres GROUP BY 1),
    dipoles AS (SELECT image, cores, deltas AS left_, CAST([] AS STRUCT(r DOUBLE, c DOUBLE)[]) AS kept, CAST(0 AS BIGINT) AS step FROM sides
        UNION ALL SELECT image, cores, CASE WHEN coalesce(near, 0) = 0 THEN left_ ELSE list_concat(left_[1 : near - 1], left_[near + 1 : len(left_)]) END, CASE WHEN coalesce(near, 0) = 0 THEN list_append(kept, core) ELSE kept END, step
        FROM (SELECT image, cores, left_, kept, step + 1 AS step, cores[step + 1] AS core, list_position(list_transform(left_, lambda x: {FAR.format('cores[step + 1].r - x.r', 'cores[step + 1].c - x.c')}), true) AS near FROM dipoles WHERE step < len(cores))),
    ends AS (SELECT image, kept, left_, len(kept) AS nc, len(left_) AS nd FROM dipoles WHERE step = len(cores)),
    classes AS (SELECT e.image, CASE WHEN NOT enough THEN 'undetermined' WHEN nc >= 2 OR nc = 1 AND nd >= 2 THEN 'whorl' WHEN nc = 1 AND nd = 1 THEN CASE WHEN left_[1].c < kept[1].c THEN 'left_loop' ELSE 'right_loop' END
        WHEN coalesce(nc, 0) = 0 AND coalesce(nd, 0) = 0 THEN 'arch' ELSE 'undetermined' END AS pattern, CAST(coalesce(nc, 0) AS INTEGER) AS cores, CAST(coalesce(nd, 0) AS INTEGER) AS deltas FROM enough e LEFT JOIN ends USING (image))"""


@query(f"{CLASSES} SELECT image, pattern, cores, deltas FROM classes")
def singular_class(spark, sf_dir):
    return fields.classes(blocks(spark, sf_dir))


@query(f"{CLASSES} SELECT pattern, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM classes GROUP BY 1")
def singular_class_frequency(spark, sf_dir):
    found = fields.classes(blocks(spark, sf_dir)).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    return found.select("pattern", "n", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 6).alias("percent"))


VARS = "x AS (SELECT p_brand AS a, p_size % 4 AS b, length(p_name) % 3 AS c, p_size % 4 * 2 + p_partkey % 2 AS d FROM part)"


def variables(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return p.select(F.col("p_brand").alias("a"), (F.col("p_size") % 4).alias("b"), (F.length("p_name") % 3).alias("c"), (F.col("p_size") % 4 * 2 + F.col("p_partkey") % 2).alias("d"))


def h_sql(columns: str) -> str:
    """A scalar subquery: the corrected entropy of the columns of x."""
    return f"(SELECT CASE WHEN sum(k) <= 1 THEN 0 ELSE greatest(0, ln(sum(k)) - sum(k * ln(k)) / sum(k) + (count(*) - 1) / (2 * sum(k))) END FROM (SELECT count(*) AS k FROM x GROUP BY {columns}))"


@query(f"WITH {VARS} SELECT round({h_sql('a')}, 9) AS a, round({h_sql('b')}, 9) AS b, round({h_sql('a, b, c, d')}, 9) AS joint")
def entropy_mm(spark, sf_dir):
    h = discrete.entropies(variables(spark, sf_dir), [["a"], ["b"], ["a", "b", "c", "d"]])
    return h.agg(*(F.round(F.max(F.when(F.col("set_no") == k, F.col("h"))), 9).alias(n) for k, n in enumerate(("a", "b", "joint"))))


@query(f"WITH {VARS} SELECT round(greatest(0, {h_sql('b')} + {h_sql('d')} - {h_sql('b, d')}), 9) AS mi")
def mi_discrete(spark, sf_dir):
    return discrete.mutual_information(variables(spark, sf_dir), "b", "d").select(F.round("mi", 9).alias("mi"))


@query(f"WITH {VARS} SELECT round(greatest(0, {' + '.join(h_sql(c) for c in 'abcd')} - {h_sql('a, b, c, d')}), 9) AS tc")
def tc_discrete(spark, sf_dir):
    return discrete.total_correlation(variables(spark, sf_dir), list("abcd")).select(F.round("tc", 9).alias("tc"))


@query(f"WITH {VARS} SELECT round(2 * {h_sql('a, b, c, d')} + {' + '.join(h_sql(c) for c in 'abcd')} - {' - '.join(h_sql(', '.join(x for x in 'abcd' if x != c)) for c in 'abcd')}, 9) AS oinfo")
def oinfo_discrete(spark, sf_dir):
    return discrete.o_information(variables(spark, sf_dir), list("abcd")).select(F.round("oinfo", 9).alias("oinfo"))


@query(f"""WITH {VARS}, n AS (SELECT b, c, d, count(*) AS n FROM x GROUP BY 1, 2, 3)
    SELECT b, c, d, n, round(ln(n / sum(n) OVER ()) - ln(sum(n) OVER (PARTITION BY b) / sum(n) OVER ()) - ln(sum(n) OVER (PARTITION BY c) / sum(n) OVER ()) - ln(sum(n) OVER (PARTITION BY d) / sum(n) OVER ()), 9) AS tc FROM n""")
def pointwise_discrete(spark, sf_dir):
    return discrete.pointwise(variables(spark, sf_dir), ["b", "c", "d"]).withColumn("tc", F.round("tc", 9))
