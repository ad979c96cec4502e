"""Permutations, bootstraps, calibration and power with reproducible randomness.

Randomness is the order of md5(seed:iteration:...): the same on every run, cluster and SQL engine. An
iteration is a key of the data, so all iterations run side by side and every statistic of the
dependence module applies to them with the iteration among its `by` columns. Nulls and bootstraps whose
groups fit into a task are made by `kernels`, range by range; larger ones by shuffles of rows, with equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.columns import hash_number, hash_order
from pairloom.operators import dependence, kernels
from pairloom.sources.files import cached
from pairloom.sources.scratch import scratch


def iterations(df: DataFrame, n: int, name: str = "iter") -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def shuffled_positions(df: DataFrame, by: list[str], seed: str) -> DataFrame:
    """df with people dealt anew at every position, independently: person becomes a number from 1."""
    order = hash_order(F.lit(seed), *by, "position", "person")
    return df.withColumn("person", F.row_number().over(Window.partitionBy(*by, "position").orderBy(order, "person")))


def _scored(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, person, position, z, written once. Permuting does not change ranks, so normal scores are taken before it."""
    scored = dependence.copula(df, [*by, "position"], value).select(*by, "person", "position", "z")
    return cached(df.sparkSession, scratch(df.sparkSession), lambda: scored)


def null_correlations(df: DataFrame, n: int, seed: str, by: list[str], value: str) -> DataFrame:
    """by, iter, pa, pb, n, rho under n independent permutations of people at every position."""
    return dealt_correlations(_scored(df, by, value), n, seed, by)


def dealt_correlations(scored: DataFrame, n: int, seed: str, by: list[str]) -> DataFrame:
    """null_correlations of a table that has z, which is read more than once."""
    if kernels.fits(scored, by):
        return kernels.permuted_correlations(scored, by, n, seed)
    key = [*by, "iter"]
    return dependence.correlations(shuffled_positions(iterations(scored, n), key, seed), key)


def permutation_null(df: DataFrame, n: int, seed: str = "null", by: tuple[str, ...] = (), value: str = "value") -> DataFrame:
    """by, iter, s and what else class_means has, under independent permutations."""
    return dependence.class_means(dependence.information(null_correlations(df, n, seed, [*by], value)), [*by, "iter"])


def information_null(df: DataFrame, n: int, seed: str = "null", value: str = "value", by: tuple[str, ...] = ()) -> DataFrame:
    """by, iter, tc, oinfo under independent permutations."""
    key = [*by, "iter"]
    return dependence.matrix_information(null_correlations(df, n, seed, [*by], value), key).select(*key, "tc", "oinfo")


def pointwise_agreement(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """by, n, rho: rank correlation over people of the pointwise total correlation of two copula tables (z)."""
    from pairloom.operators.tails import spearman

    first, second = (dependence.pointwise_total_correlation(x, by).withColumnRenamed("tc", n) for x, n in ((a, "ta"), (b, "tb")))
    return spearman(first.join(second, [*by, "person"]), by, "ta", "tb")


def agreement_null(first: DataFrame, second: DataFrame, n: int, by: list[str], seeds: tuple[str, str] = ("a", "b")) -> DataFrame:
    """by, iter, n, rho of two copula tables: as they are (iter -1), and with people of each dealt anew at every position."""
    both = [cached(z.sparkSession, scratch(z.sparkSession), lambda z=z: z.select(*by, F.col("person").cast("long").alias("person"), "position", "z")) for z in (first, second)]
    key, seen = [*by, "iter"], [z.withColumn("iter", F.lit(-1)) for z in both]
    observed = pointwise_agreement(*seen, key).select(*key, "n", "rho")
    if all(kernels.fits(z, by) and kernels.whole(z, by) for z in both):
        dealt = kernels.permuted_agreement(*both, by, n, seeds)
    else:
        dealt = pointwise_agreement(*(shuffled_positions(iterations(z, n), key, s) for z, s in zip(both, seeds)), key)
    return observed.unionByName(dealt.select(*key, "n", "rho"))


def empirical_p(null: DataFrame, observed: DataFrame, by: list[str], statistic: str, two_sided: bool = False) -> DataFrame:
    """by, observed, n, p: (null values at least as great + 1) / (n + 1)."""
    size = (lambda c: F.abs(c)) if two_sided else (lambda c: c)
    obs = observed.select(*by, F.col(statistic).alias("observed"))
    both = null.join(obs, by) if by else null.crossJoin(F.broadcast(obs))
    hits = F.count_if(size(F.col(statistic)) >= size(F.col("observed")))
    return both.groupBy(*by, "observed").agg(F.count(F.lit(1)).alias("n"), ((hits + 1) / (F.count(F.lit(1)) + 1)).alias("p"))


def bonferroni(p: DataFrame, tests: int | None = None, level: float = 0.05) -> DataFrame:
    """p with flags: below one percent, and below the level shared by all tests (their number, or that of the rows)."""
    n = F.lit(tests) if tests else F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    return p.withColumns({"at_one_percent": F.col("p") < 0.01, "of_all": F.col("p") < F.lit(level) / n})


def five_tests(df: DataFrame, first: str, second: str, n: int, by: tuple[str, ...] = (), seeds: tuple[str, str] = ("a", "b")) -> DataFrame:
    """by, test, observed, n, p of five statistics against the same n independent permutations of two variables.

    information and difference of either variable (total correlation; homologous pairs less all others) and agreement, the
    rank correlation of their pointwise total correlations.
    """
    key, rows, tables = [*by, "iter"], None, []
    for name, value, seed in (("first", first, seeds[0]), ("second", second, seeds[1])):
        z = _scored(df, [*by], value)
        tables.append(z)
        seen = dependence.correlations(z.withColumn("iter", F.lit(-1)), key)
        columns = [*key, "pa", "pb", "rho"]
        rhos = seen.select(columns).unionByName(dealt_correlations(z, n, seed, [*by]).select(columns))
        found = [dependence.matrix_information(rhos, key).select(*key, F.lit(f"information_{name}").alias("test"), F.col("tc").alias("x"))]
        found.append(dependence.class_means(dependence.information(rhos), key).select(*key, F.lit(f"difference_{name}").alias("test"), F.col("delta_mi").alias("x")))
        for f in found:
            rows = f if rows is None else rows.unionByName(f)
    rows = rows.unionByName(agreement_null(*tables, n, [*by], seeds).select(*key, F.lit("agreement").alias("test"), F.col("rho").alias("x")))
    seen = rows.where("iter < 0").select(*by, "test", "x")
    return empirical_p(rows.where("iter >= 0"), seen, [*by, "test"], "x")


def s_of(df: DataFrame, blind: bool = True, seed: str = "blind", value: str = "value", by: tuple[str, ...] = ()) -> DataFrame:
    """class_means of df; unless unblinded, of data whose people were dealt anew at every position."""
    return dependence.s_statistic(shuffled_positions(df, [*by], seed) if blind else df, [*by], value)


def draws(people: DataFrame, n: int, seed: str) -> DataFrame:
    """iter, draw, person: as many draws with replacement in each iteration as there are people."""
    numbered = dependence.numbered(people.select("person"), "person", "k")
    size = people.count()
    picks = iterations(numbered.select(F.col("k").alias("draw")), n)
    picks = picks.withColumn("k", hash_number(F.lit(seed), "iter", "draw") % F.lit(max(1, size)))
    return picks.join(numbered, "k").select("iter", "draw", "person")


def _people(df: DataFrame, value: str) -> DataFrame:
    """person, capture, position and value, written once; rows without a value have no rank and go."""
    return cached(df.sparkSession, scratch(df.sparkSession), lambda: df.where(F.col(value).isNotNull()).select("person", "capture", "position", value))


def bootstrap_between(df: DataFrame, c1: str, c2: str, n: int, seed: str = "boot", value: str = "value") -> DataFrame:
    """iter, auto, crossed, ratio of S over bootstrap draws of people; a person drawn twice counts twice, in ranks too."""
    two = df.where(F.col("capture").isin(c1, c2))
    both = two.groupBy("person").agg(F.countDistinct("capture").alias("k")).where("k = 2").select("person")
    two = _people(two.join(both, "person", "left_semi"), value)
    s = kernels.bootstrapped(two, n, seed, value) if kernels.fits(two, []) else _drawn_between(two, n, seed, value)
    auto, crossed = F.avg(F.when(F.col("c1") == F.col("c2"), F.col("s"))), F.avg(F.when(F.col("c1") != F.col("c2"), F.col("s")))
    return s.groupBy("iter").agg(auto.alias("auto"), crossed.alias("crossed"), (crossed / auto).alias("ratio"))


def _drawn_between(df: DataFrame, n: int, seed: str, value: str) -> DataFrame:
    """iter, c1, c2, n, s of draws, a row for each time that a person is drawn."""
    drawn = draws(df.select("person").distinct(), n, seed).join(df, "person").drop("person").withColumnRenamed("draw", "person")
    return dependence.s_between(drawn, value, by=("iter",))


def capture_null(df: DataFrame, n: int, captures: list[str] | None = None, seed: str = "captures", value: str = "value", middle=F.median) -> DataFrame:
    """iter, crossed, auto, ratio when every capture's people are dealt anew at every position, once per iteration for all its pairs."""
    df = df.where(F.col("capture").isin(captures)) if captures else df
    scored = _scored(df, ["capture"], value)
    if kernels.fits(scored, []):
        pairs = kernels.permuted_captures(scored, n, seed)
    else:
        pairs = dependence.s_between(shuffled_positions(iterations(scored, n), ["iter", "capture"], seed), "z", by=("iter",))
    return dependence.crossed_and_auto(pairs, ("iter",), middle)


def joint_bootstrap(df: DataFrame, n: int, seed: str = "joint", value: str = "value", middle=F.median) -> DataFrame:
    """iter, crossed, auto, ratio: one draw of people with replacement serves all captures and their pairs."""
    rows = _people(df, value)
    pairs = kernels.bootstrapped(rows, n, seed, value) if kernels.fits(rows, []) else _drawn_between(rows, n, seed, value)
    return dependence.crossed_and_auto(pairs, ("iter",), middle)


def sensitivity(df: DataFrame, without: DataFrame, statistic, key: str = "person") -> DataFrame:
    """The same statistic of all people and without some: rows of statistic(df), with state all or kept."""
    kept = df.join(without.select(key).distinct(), key, "left_anti")
    return statistic(df).withColumn("state", F.lit("all")).unionByName(statistic(kept).withColumn("state", F.lit("kept")))


def interval(rows: DataFrame, value: str) -> DataFrame:
    """low, middle, high: the 2.5, 50 and 97.5 percentiles, and what they say of one half."""
    q = F.percentile(value, F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    out = rows.agg(q.alias("q")).select(*(F.element_at("q", k + 1).alias(x) for k, x in enumerate(("low", "middle", "high"))))
    return out.withColumn("reading", reading())


def reading(half: float = 0.5) -> Column:
    return F.when(F.col("low") > half, "body").when(F.col("high") < half, "capture").otherwise("inconclusive")


def relabelled(listed: DataFrame, items: DataFrame, n: int, seed: str) -> DataFrame:
    """iter, i, j: the pairs (i, j) after the items are relabelled at random, n times."""
    order = Window.partitionBy("iter").orderBy(hash_order(F.lit(seed), "iter", "idx"), "idx")
    named = dependence.numbered(items.select("idx"), "idx", "place").withColumn("place", F.col("place") + 1)
    dealt = iterations(named, n).withColumn("to", F.row_number().over(order))
    mapping = dealt.join(named.select(F.col("place").alias("to"), F.col("idx").alias("new")), "to").select("iter", "idx", "new")
    moved = listed.join(mapping.select("iter", F.col("idx").alias("i"), F.col("new").alias("a")), "i").join(mapping.select("iter", F.col("idx").alias("j"), F.col("new").alias("b")), ["iter", "j"])
    return moved.select("iter", F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"))


def label_null(index: DataFrame, scorer, key: str, n: int, seed: str = "label") -> DataFrame:
    """iter, diff: mean score of the relabelled pairs of one key less the mean of all others.

    The grand total comes from the tiles' histograms; of the pairs only those of one key are listed, relabelled and summed in their tiles.
    """
    from pairloom.operators.pairs import EVERY, class_histogram, listed_totals

    spark = index.sparkSession
    score = F.col(scorer.name)
    grand = class_histogram(index, [scorer], EVERY).agg(F.sum(score * F.col("n")).alias("all"), F.sum("n").alias("pairs"))
    ends = [index.select(key, F.col("idx").alias(end)) for end in ("i", "j")]
    same = cached(spark, scratch(spark), lambda: ends[0].join(ends[1], key).where("i < j").select("i", "j"))
    k = same.count()
    sums = listed_totals(relabelled(same, index, n, seed), index, scorer, "iter").crossJoin(F.broadcast(grand))
    return sums.select("iter", (F.col("total") / k - (F.col("all") - F.col("total")) / (F.col("pairs") - k)).alias("diff"))


def injected(z: DataFrame, by: list[str], rho: str, seed: str) -> DataFrame:
    """z with a factor common to the two homologous positions of a person mixed in: sqrt(rho) f + sqrt(1 - rho) z."""
    from pairloom.functions.normal import normal_quantile

    u = (hash_number(F.lit(seed), *by, F.col("position") % 5, "person") + 0.5) / float(16**8)
    mixed = z.withColumn("_u", u).withColumn("_f", normal_quantile("_u"))
    return mixed.withColumn("z", F.sqrt(rho) * F.col("_f") + F.sqrt(1 - F.col(rho)) * F.col("z")).drop("_u", "_f")


def power(df: DataFrame, rhos: list[float], repeats: int, null: int, level: float, value: str = "value", by: tuple[str, ...] = ()) -> DataFrame:
    """by, rho, reps, detected (share of repeats with p <= level), mean_p."""
    z = _scored(df, [*by], value)
    p = kernels.powered(z, [*by], rhos, repeats, null) if kernels.fits(z, [*by]) else _powered(z, [*by], rhos, repeats, null)
    return p.groupBy(*by, F.col("effect").alias("rho")).agg(F.count(F.lit(1)).alias("reps"), F.avg((F.col("p") <= level).cast("double")).alias("detected"), F.avg("p").alias("mean_p"))


def _powered(z: DataFrame, by: list[str], rhos: list[float], repeats: int, null: int) -> DataFrame:
    """by, effect, rep, p of sets that are rows."""
    dealt = shuffled_positions(iterations(z, repeats, "rep"), [*by, "rep"], "base")
    data = dealt.withColumn("effect", F.explode(F.array(*(F.lit(float(r)) for r in rhos))))
    data = injected(data, [*by, "rep"], "effect", "factor")
    key = [*by, "effect", "rep"]
    observed = dependence.s_statistic(data, key, "z")
    return empirical_p(permutation_null(data, null, "power", tuple(key), "z"), observed, key, "s")


def first_detected(curve: DataFrame, least: float = 0.8, by: tuple[str, ...] = ()) -> DataFrame:
    """The least rho with enough power, as text, or that it is beyond all."""
    found = F.min(F.when(F.col("detected") >= least, F.col("rho")))
    return curve.groupBy(*by).agg(F.coalesce(found.cast("string"), F.concat(F.lit("> "), F.max("rho").cast("string"))).alias("rho"))


def calibration(df: DataFrame, sets: int, null: int, level: float, value: str = "value", by: tuple[str, ...] = ()) -> DataFrame:
    """by, set_no, p of data without any dependence: people dealt anew at every position."""
    z = _scored(df, [*by], value)
    if kernels.fits(z, [*by]):
        return kernels.calibrated(z, [*by], sets, null)
    key = [*by, "set_no"]
    data = shuffled_positions(iterations(z, sets, "set_no"), key, "set")
    observed = dependence.class_means(dependence.information(dependence.correlations(data, key)), key)
    return empirical_p(permutation_null(data, null, "calibrate", tuple(key), "z"), observed, key, "s")
