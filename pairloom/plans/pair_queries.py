"""Queries of pair scoring, tails and agreement, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.columns import fold, hash_order
from pairloom.operators import pairs, tails
from pairloom.operators.item_pairs import item_pairs
from pairloom.operators.scorers import closeness, mirrored, one_sided, similarity
from pairloom.plans.catalog import query
from pairloom.sources.analogues import impressions, read
from pairloom.sources.files import cached
from pairloom.sources.scratch import scratch

IDX = """idx AS (
    SELECT vec_id AS idx, CAST(label AS BIGINT) AS finger_id, vec_id % 4 AS source, (vec_id % 4) || '/' || label AS key,
           vec_id // 10 AS person, (vec_id % 10) // 5 AS hand, vec_id % 5 AS finger,
           list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 1000 + 0.5)) AS q
    FROM embeddings)"""
S1 = "CAST(floor(list_dot_product(a.q, b.q) / 10000.0) + 60 AS BIGINT)"
S2 = "CAST(floor((12000 - list_sum(list_transform(list_zip(a.q, b.q), lambda p: abs(p[1] - p[2])))) / 100.0) AS BIGINT)"
BOTH = f"""{IDX}, e AS (
    SELECT a.idx AS i, b.idx AS j, a.source AS source_i, b.source AS source_j, a.finger_id AS finger_id_i, b.finger_id AS finger_id_j,
           a.key AS key_i, b.key AS key_j, a.person AS person_i, b.person AS person_j, a.hand AS hand_i, b.hand AS hand_j,
           a.finger AS finger_i, b.finger AS finger_j, {S1} AS similarity, {S2} AS closeness
    FROM idx a JOIN idx b ON a.idx < b.idx)"""
ONE = BOTH.replace(f", {S2} AS closeness", "")
TWO_WAY = "CASE WHEN source_i = source_j AND finger_id_i = finger_id_j THEN 'genuine' ELSE 'impostor' END"
THREE_WAY = "CASE WHEN finger_id_i <> finger_id_j THEN 'impostor' WHEN source_i = source_j THEN 'genuine' ELSE 'artefact' END"
CLASSED = f"{BOTH}, p AS (SELECT *, {THREE_WAY} AS pair_class FROM e)"


def edges(spark, sf_dir, scorers=(similarity, closeness), columns=("source", "finger_id")) -> DataFrame:
    return pairs.all_pairs(impressions(spark, sf_dir), list(scorers), attributes=tuple(columns))


def counted(spark, sf_dir, scorers=(similarity,), classes=pairs.THREE_WAY) -> DataFrame:
    """Histogram of the scores by class, made in the tiles."""
    return pairs.class_histogram(impressions(spark, sf_dir), list(scorers), classes)


def best(spark, sf_dir, k: int, scorers=(similarity, closeness)) -> DataFrame:
    """Impostors among which the k best by each scorer are."""
    return pairs.best_pairs(impressions(spark, sf_dir), list(scorers), k, pairs.THREE_WAY, "impostor")


@query(f"WITH {ONE} SELECT {TWO_WAY} AS pair_class, similarity AS score, count(*) AS n FROM e GROUP BY 1, 2")
def allvsall_hist(spark, sf_dir):
    return counted(spark, sf_dir, classes=pairs.TWO_WAY).withColumnRenamed("similarity", "score")


@query(f"WITH {ONE} SELECT CAST(sum(similarity) AS BIGINT) AS total, count(*) AS n FROM e")
def allvsall_native(spark, sf_dir):
    return pairs.all_pairs_native(impressions(spark, sf_dir), [similarity]).agg(F.sum("similarity").alias("total"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {ONE}, h AS (SELECT similarity AS score, count(*) AS n FROM e WHERE {TWO_WAY} = 'impostor' GROUP BY 1) SELECT s.score, coalesce(n, 0) AS n FROM (SELECT unnest(range(0, (SELECT max(score) + 1 FROM h))) AS score) s LEFT JOIN h ON h.score = s.score")
def hist_zero_filled(spark, sf_dir):
    h = counted(spark, sf_dir, classes=pairs.TWO_WAY).where("pair_class = 'impostor'")
    return tails.zero_filled(h.select(F.col("similarity").alias("score"), "n"))


@query(f"WITH {ONE} SELECT {THREE_WAY} AS pair_class, count(*) AS n FROM e GROUP BY 1")
def pair_class3_counts(spark, sf_dir):
    return counted(spark, sf_dir).groupBy("pair_class").agg(F.sum("n").alias("n"))


@query(f"WITH {CLASSED} SELECT count(*) AS n, CAST(count_if(similarity >= 70) AS BIGINT) AS similar, CAST(count_if(closeness >= 35) AS BIGINT) AS close FROM p WHERE pair_class = 'artefact' AND least(source_i, source_j) = 0 AND greatest(source_i, source_j) = 1")
def source_pair_artefacts(spark, sf_dir):
    index = impressions(spark, sf_dir)
    # Only the two sources make pairs, each item of one with each of the other.
    both = pairs.class_histogram(index.where("source = 0"), [similarity, closeness], pairs.THREE_WAY, against=index.where("source = 1")).where("pair_class = 'artefact'")
    reached = lambda c: F.coalesce(F.sum(F.when(F.expr(c), F.col("n"))), F.lit(0))
    return both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), reached("similarity >= 70").alias("similar"), reached("closeness >= 35").alias("close"))


RECTANGLE = f"{IDX}, r AS (SELECT a.idx AS i, b.idx AS j, a.finger_id AS own, b.finger_id AS other, {S1} AS similarity FROM idx a JOIN idx b ON a.idx <> b.idx)"


@query(f"WITH {RECTANGLE} SELECT i, count(*) AS n, min(similarity) AS low, max(similarity) AS high FROM r GROUP BY 1")
def probe_gallery(spark, sf_dir):
    return pairs.per_probe(impressions(spark, sf_dir), similarity).select("i", "n", "low", "high")


@query(f"WITH {RECTANGLE}, b AS (SELECT i, own, arg_max(other, similarity * 1000000 - j) AS found FROM r GROUP BY 1, 2) SELECT count(*) AS probes, avg(CASE WHEN own = found THEN 1.0 ELSE 0.0 END) AS rate FROM b")
def rank1_identification(spark, sf_dir):
    index = impressions(spark, sf_dir)
    named = [index.select(F.col("idx").alias(at), F.col("finger_id").alias(name)) for at, name in (("i", "own"), ("best", "found"))]
    best = pairs.per_probe(index, similarity).select("i", "best").join(named[0], "i").join(named[1], "best")
    return best.agg(F.count(F.lit(1)).alias("probes"), F.avg((F.col("own") == F.col("found")).cast("double")).alias("rate"))


@query(f"""WITH {IDX}, d AS (SELECT a.idx AS i, b.idx AS j, CAST(floor(list_dot_product(a.q[1:32], b.q[33:64]) / 10000.0) AS BIGINT) AS score FROM idx a, idx b),
    s AS (SELECT least(i, j) AS i, greatest(i, j) AS j, max(score) AS score FROM d WHERE i <> j GROUP BY 1, 2)
    SELECT score, count(*) AS n FROM s GROUP BY 1""")
def directed_symmetrise(spark, sf_dir):
    hist = pairs.class_histogram(impressions(spark, sf_dir), [mirrored(one_sided)], pairs.EVERY)
    return hist.select(F.col("one_sided").alias("score"), "n")


PERCENT_LIST = ", ".join(str(float(p)) for p in tails.PERCENTS)


@query(f"""WITH {ONE}, p AS (SELECT {TWO_WAY} AS pair_class, similarity FROM e)
    SELECT pair_class, percent, quantile_disc(similarity, percent / 100) AS value FROM p, (SELECT unnest([{PERCENT_LIST}]::DOUBLE[]) AS percent) GROUP BY 1, 2""".replace("quantile_disc(similarity, percent / 100)", "list_sort(list(similarity))[CAST(ceil(count(*) * percent / 100 - 1e-9) AS BIGINT)]"))
def percentile_disc_by_class(spark, sf_dir):
    return tails.discrete_percentiles(counted(spark, sf_dir, classes=pairs.TWO_WAY).withColumnRenamed("similarity", "score"), ["pair_class"])


@query(f"WITH {CLASSED} SELECT pair_class, count(*) AS n, round(quantile_cont(similarity, 0.5), 6) AS p50, round(quantile_cont(similarity, 0.9), 6) AS p90, round(quantile_cont(similarity, 0.99), 6) AS p99, round(quantile_cont(similarity, 0.999), 6) AS p99_9, max(similarity) AS top FROM p GROUP BY 1")
def percentile_cont_by_class(spark, sf_dir):
    s = tails.summary(counted(spark, sf_dir), ["pair_class"], "similarity", (), weight="n")
    return s.select("pair_class", "n", *(F.round(c, 6).alias(c) for c in ("p50", "p90", "p99", "p99_9")), "top")


@query(f"""WITH {CLASSED} SELECT pair_class, count(*) AS n, CAST(count_if(closeness >= 30) AS BIGINT) AS n_ge_30, round(count_if(closeness >= 30) / count(*), 9) AS share_ge_30,
    CAST(count_if(closeness >= 40) AS BIGINT) AS n_ge_40, round(count_if(closeness >= 40) / count(*), 9) AS share_ge_40, round(avg(CASE WHEN closeness < 30 THEN 1.0 ELSE 0.0 END), 9) AS missed FROM p GROUP BY 1""")
def tail_counts(spark, sf_dir):
    s = tails.summary(counted(spark, sf_dir, [closeness]), ["pair_class"], "closeness", (30, 40), weight="n")
    return s.select("pair_class", "n", "n_ge_30", F.round("share_ge_30", 9).alias("share_ge_30"), "n_ge_40", F.round("share_ge_40", 9).alias("share_ge_40"), F.round(1 - F.col("share_ge_30"), 9).alias("missed"))


@query(f"WITH {CLASSED} SELECT i, j, similarity AS score FROM p WHERE pair_class = 'impostor' ORDER BY score DESC, i, j LIMIT 100")
def top_impostors(spark, sf_dir):
    return tails.top(best(spark, sf_dir, 100, [similarity]).withColumnRenamed("similarity", "score"), 100)


@query(f"""WITH {CLASSED}, m AS (SELECT * FROM p WHERE pair_class = 'impostor'), t AS (SELECT i, j, similarity, closeness FROM m ORDER BY similarity DESC, i, j LIMIT 20)
    SELECT t.i, t.j, t.similarity, t.closeness, round((SELECT count(*) FROM m WHERE m.closeness >= t.closeness) / (SELECT count(*) FROM m), 9) AS rate FROM t""")
def fmr_of_top(spark, sf_dir):
    hist = counted(spark, sf_dir, [closeness]).where("pair_class = 'impostor'")
    rates = tails.match_rates(hist, "closeness").select("closeness", F.round("rate", 9).alias("rate"))
    return tails.top(best(spark, sf_dir, 20), 20, "similarity").join(rates, "closeness").select("i", "j", "similarity", "closeness", "rate")


@query(f"WITH {CLASSED}, m AS (SELECT similarity AS score, count(*) AS n FROM p WHERE pair_class = 'impostor' GROUP BY 1) SELECT score, n, round(sum(n) OVER (ORDER BY score DESC) / sum(n) OVER (), 9) AS rate FROM m")
def fmr_all(spark, sf_dir):
    hist = counted(spark, sf_dir).where("pair_class = 'impostor'").withColumnRenamed("similarity", "score")
    return tails.match_rates(hist).select("score", "n", F.round("rate", 9).alias("rate"))


RANKED = f"""{CLASSED}, r AS (SELECT i, j, similarity, closeness, row_number() OVER (ORDER BY similarity DESC, i, j) - 1 AS ra, row_number() OVER (ORDER BY closeness DESC, i, j) - 1 AS rb FROM p WHERE pair_class = 'impostor')"""


def _ranked(spark, sf_dir, most):
    """Both tables are cut from the same best pairs of the tiles, which are written once."""
    e = cached(spark, scratch(spark), lambda: best(spark, sf_dir, most))
    return tails.ranked(e, "similarity", "ra", most), tails.ranked(e, "closeness", "rb", most)


@query(f"WITH {RANKED} SELECT k, (SELECT count(*) FROM r WHERE greatest(ra, rb) < k) AS common FROM (SELECT unnest([10, 100, 1000, 5000]) AS k)")
def topk_overlap(spark, sf_dir):
    return tails.overlap(*_ranked(spark, sf_dir, 5000), "ra", "rb", (10, 100, 1000, 5000))


@query(f"WITH {RANKED} SELECT i, j, ra, rb FROM r WHERE ra < 1000 AND rb < 1000")
def joint_extreme(spark, sf_dir):
    a, b = _ranked(spark, sf_dir, 1000)
    return a.select("i", "j", "ra").join(b.select("i", "j", "rb"), ["i", "j"])


@query(f"""WITH {RANKED}, q AS (SELECT i, j, 0 AS queue, ra AS place FROM r WHERE ra < 25 UNION ALL SELECT i, j, 1, rb FROM r WHERE rb < 25)
    SELECT i, j, queue, place FROM q QUALIFY row_number() OVER (PARTITION BY i, j ORDER BY queue, place) = 1""")
def review_queue(spark, sf_dir):
    a, b = _ranked(spark, sf_dir, 25)
    return tails.first_seen([a.select("i", "j", F.col("ra").alias("place")), b.select("i", "j", F.col("rb").alias("place"))], ["i", "j"], "place")


@query(f"""WITH {CLASSED}, r AS (SELECT pair_class, rank() OVER (PARTITION BY pair_class ORDER BY similarity) + (count(*) OVER (PARTITION BY pair_class, similarity) - 1) / 2 AS a,
    rank() OVER (PARTITION BY pair_class ORDER BY closeness) + (count(*) OVER (PARTITION BY pair_class, closeness) - 1) / 2 AS b FROM p)
    SELECT pair_class, count(*) AS n, round(corr(a, b), 6) AS rho FROM r GROUP BY 1""")
def spearman_scorers(spark, sf_dir):
    return tails.spearman(counted(spark, sf_dir, [similarity, closeness]), ["pair_class"], "similarity", "closeness", "n").select("pair_class", "n", F.round("rho", 6).alias("rho"))


FINGERS = f"""{BOTH}, f AS (SELECT least(key_i, key_j) AS key_a, greatest(key_i, key_j) AS key_b,
    CASE WHEN finger_id_i = finger_id_j THEN 'artefact' ELSE 'impostor' END AS pair_class, count(*) AS n, median(similarity) AS median_a, median(closeness) AS median_b,
    round(avg(CASE WHEN similarity >= 70 THEN 1.0 ELSE 0.0 END), 9) AS share_a, round(avg(CASE WHEN closeness >= 35 THEN 1.0 ELSE 0.0 END), 9) AS share_b
    FROM e WHERE key_i <> key_j GROUP BY 1, 2, 3)"""


def _finger_blocks(spark, sf_dir):
    blocks = item_pairs(impressions(spark, sf_dir), [similarity, closeness], pairs.THREE_WAY, {"similarity": 70, "closeness": 35})
    share = lambda c: F.round(F.col(f"reached_{c}") / F.col("n"), 9)
    return blocks.select("key_a", "key_b", "pair_class", "n", F.col("median_similarity").alias("median_a"), F.col("median_closeness").alias("median_b"), share("similarity").alias("share_a"), share("closeness").alias("share_b"))


@query(f"WITH {FINGERS} SELECT * FROM f")
def finger_pair_blocks(spark, sf_dir):
    return _finger_blocks(spark, sf_dir)


@query(f"""WITH {FINGERS}, r AS (SELECT rank() OVER (ORDER BY median_a) + (count(*) OVER (PARTITION BY median_a) - 1) / 2 AS a, rank() OVER (ORDER BY median_b) + (count(*) OVER (PARTITION BY median_b) - 1) / 2 AS b FROM f)
    SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM r""")
def spearman_finger_level(spark, sf_dir):
    return tails.spearman(_finger_blocks(spark, sf_dir), [], "median_a", "median_b").select("n", F.round("rho", 6).alias("rho"))


@query(f"""WITH {FINGERS}, r AS (SELECT key_a, key_b, row_number() OVER (ORDER BY median_a DESC, key_a, key_b) + row_number() OVER (ORDER BY median_b DESC, key_a, key_b) AS rank_sum FROM f)
    SELECT key_a, key_b, rank_sum FROM r ORDER BY rank_sum, key_a, key_b LIMIT 10""")
def finger_pair_rank_sum(spark, sf_dir):
    blocks = cached(spark, scratch(spark), lambda: _finger_blocks(spark, sf_dir).select("key_a", "key_b", "median_a", "median_b"))
    ranked = tails.places(tails.places(blocks, "median_a", ["key_a", "key_b"], "ra"), "median_b", ["key_a", "key_b"], "rb")
    return ranked.select("key_a", "key_b", (F.col("ra") + F.col("rb")).alias("rank_sum")).orderBy("rank_sum", "key_a", "key_b").limit(10)


@query(f"""WITH {BOTH}, c AS (SELECT least(key_i, key_j) AS key_a, greatest(key_i, key_j) AS key_b, i, j, similarity * 54 + closeness * 59 AS both_scores FROM e WHERE key_i <> key_j)
    SELECT key_a, key_b, i, j, both_scores FROM c QUALIFY row_number() OVER (PARTITION BY key_a, key_b ORDER BY both_scores DESC, i DESC, j DESC) = 1""")
def finger_pair_peak(spark, sf_dir):
    best = item_pairs(impressions(spark, sf_dir), [similarity, closeness], pairs.EVERY, {}, {"similarity": 54, "closeness": 59})
    return best.select("key_a", "key_b", "peak.i", "peak.j", F.col("peak.sum").alias("both_scores"))


@query(f"""WITH {BOTH} SELECT a.idx AS i, b.idx AS j, e.similarity, e.closeness FROM idx a JOIN idx b ON a.key = '0/1' AND b.key = '1/1'
    LEFT JOIN (SELECT * FROM e WHERE similarity >= 60) e ON e.i = least(a.idx, b.idx) AND e.j = greatest(a.idx, b.idx)""".replace("a.idx AS i, b.idx AS j", "least(a.idx, b.idx) AS i, greatest(a.idx, b.idx) AS j"))
def named_finger_pairs(spark, sf_dir):
    index = impressions(spark, sf_dir)
    return pairs.named_pairs(index.where("key = '0/1'"), index.where("key = '1/1'"), [similarity, closeness], {"similarity": 60})


BODIES = f"""{BOTH}, bc AS (SELECT similarity, person_i = person_j AS same, finger_i = finger_j AND hand_i <> hand_j AS homologous FROM e),
    g AS (SELECT 'different_bodies' AS body_class, similarity FROM bc WHERE NOT same UNION ALL SELECT 'same_body', similarity FROM bc WHERE same
    UNION ALL SELECT 'same_body_homologous', similarity FROM bc WHERE same AND homologous UNION ALL SELECT 'same_body_other', similarity FROM bc WHERE same AND NOT homologous)"""
#: Of the disjoint classes, those that they are part of.
PARTS = {"different_bodies": ["different_bodies"], "same_body_other": ["same_body", "same_body_other"], "same_body_homologous": ["same_body", "same_body_homologous"]}


@query(f"WITH {BODIES} SELECT body_class, count(*) AS n, round(avg(similarity), 6) AS mean, round(stddev_pop(similarity), 6) AS std, round(median(similarity), 6) AS p50, max(similarity) AS top FROM g GROUP BY 1")
def body_class_distribution(spark, sf_dir):
    classes = fold(F.col("pair_class"), *((k, v) for k, v in PARTS.items()))
    s = tails.summary(counted(spark, sf_dir, classes=pairs.BODIES).withColumn("body_class", F.explode(classes)), ["body_class"], "similarity", (), weight="n")
    return s.select("body_class", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), F.round("p50", 6).alias("p50"), "top")


@query(f"""WITH {BODIES}, r AS (SELECT same, rank() OVER (ORDER BY similarity) + (count(*) OVER (PARTITION BY similarity) - 1) / 2 AS r FROM bc),
    t AS (SELECT CAST(count_if(same) AS BIGINT) AS n1, CAST(count_if(NOT same) AS BIGINT) AS n2, sum(CASE WHEN same THEN r ELSE 0 END) AS r1 FROM r)
    SELECT n1, n2, r1 - n1 * (n1 + 1) / 2 AS u, round((r1 - n1 * (n1 + 1) / 2) / n1 / n2, 9) AS auc, round(2 * (r1 - n1 * (n1 + 1) / 2) / n1 / n2 - 1, 9) AS delta FROM t""")
def mann_whitney_auc(spark, sf_dir):
    hist = counted(spark, sf_dir, classes=pairs.SAME_PERSON).withColumnRenamed("similarity", "score")
    return tails.mann_whitney(hist, F.col("pair_class") == "same").select("n1", "n2", "u", F.round("auc", 9).alias("auc"), F.round("delta", 9).alias("delta"))


@query(f"""WITH {BODIES} SELECT CAST(count_if(same) AS BIGINT) AS n1, CAST(count_if(NOT same) AS BIGINT) AS n2, round((avg(similarity) FILTER (same) - avg(similarity) FILTER (NOT same)) /
    sqrt(((count_if(same) - 1) * var_samp(similarity) FILTER (same) + (count_if(NOT same) - 1) * var_samp(similarity) FILTER (NOT same)) / (count(*) - 2)), 6) AS d FROM bc""")
def cohens_d(spark, sf_dir):
    hist = counted(spark, sf_dir, classes=pairs.SAME_PERSON)
    return tails.cohens_d(hist, F.col("pair_class") == "same", "similarity").select("n1", "n2", F.round("d", 6).alias("d"))


@query(f"""WITH {ONE}, people AS (SELECT DISTINCT person FROM idx), total AS (SELECT count(*) AS n FROM people),
    asked AS (SELECT k, rep FROM (SELECT unnest([5, 10, 20, 40]) AS k) CROSS JOIN (SELECT unnest(range(10)) AS rep) WHERE k < (SELECT n FROM total) UNION ALL SELECT n, 0 FROM total),
    places AS (SELECT rep, person, row_number() OVER (PARTITION BY rep ORDER BY md5('growth:' || rep || ':' || person), person) AS place FROM people, (SELECT unnest(range(10)) AS rep)),
    best AS (SELECT least(person_i, person_j) AS a, greatest(person_i, person_j) AS b, max(similarity) AS score FROM e WHERE person_i <> person_j GROUP BY 1, 2),
    chosen AS (SELECT k, asked.rep, person FROM asked JOIN places ON places.rep = asked.rep AND place <= k),
    tops AS (SELECT x.k, x.rep, max(score) AS top FROM best JOIN chosen x ON x.person = a JOIN chosen y ON y.person = b AND x.k = y.k AND x.rep = y.rep GROUP BY 1, 2)
    SELECT CAST(k AS INTEGER) AS k, count(*) AS reps, round(avg(top), 6) AS mean_top, round(stddev_pop(top), 6) AS std_top FROM tops GROUP BY 1""")
def growth_of_maximum(spark, sf_dir):
    g = tails.growth_of_maximum(impressions(spark, sf_dir), similarity, [5, 10, 20, 40], 10, lambda rep, person: hash_order(F.lit("growth"), rep, person))
    return g.select("k", "reps", F.round("mean_top", 6).alias("mean_top"), F.round("std_top", 6).alias("std_top"))


@query("SELECT lang, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM documents GROUP BY 1")
def class_frequency(spark, sf_dir):
    counts = read(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("lang", "n", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 6).alias("percent"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY ROLLUP (source)")
def source_counts_with_total(spark, sf_dir):
    return read(spark, sf_dir, "documents").rollup("source").agg(F.count(F.lit(1)).alias("n"))
