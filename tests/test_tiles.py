"""Tiles of bounded number that are compared in parts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.operators import pairs, tails
from pairloom.operators.item_pairs import item_pairs
from pairloom.operators.scorers import closeness, similarity

N = 1300


@pytest.fixture(scope="module")
def items(spark):
    x = np.random.default_rng(5).integers(-300, 300, (N, 6))
    rows = [(k, k % 7, k % 2, f"{k % 2}/{k % 7}", row.tolist()) for k, row in enumerate(x)]
    return x.astype(float), spark.createDataFrame(rows, "idx long, finger_id long, source long, key string, q array<long>").localCheckpoint()


@pytest.fixture(scope="module")
def scores(items):
    x = items[0]
    i, j = np.triu_indices(N, 1)
    s, c = np.floor(x @ x.T / 10000.0) + 60, np.floor((12000 - np.abs(x[:, None] - x[None]).sum(2)) / 100.0)
    return i, j, s[i, j].astype(int), c[i, j].astype(int)


def test_blocks_are_bounded_and_never_broadcast(items, monkeypatch):
    monkeypatch.setattr(pairs, "MOST_BLOCKS", 5)
    for found in (pairs._tiles(items[1], None, "q", 8, ()), pairs._tiles(items[1].where("idx < 900"), items[1].where("idx >= 900"), "q", 8, ())):
        assert found.count() in (15, 25)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    native = pairs.all_pairs_native(items[1].where("idx < 40"), [similarity], tile_rows=2)
    assert "Broadcast" not in native._jdf.queryExecution().executedPlan().toString() and native.count() == 780


def test_parts_of_a_tile_make_the_whole(items, scores):
    i, j, s, c = scores
    index = items[1]
    hist = {(r.similarity, r.closeness): r.n for r in pairs.class_histogram(index, [similarity, closeness], pairs.EVERY, tile_rows=4000).collect()}
    values, counts = np.unique(np.column_stack([s, c]), axis=0, return_counts=True)
    assert hist == {(a, b): n for (a, b), n in zip(values.tolist(), counts.tolist())}
    best = tails.top(pairs.best_pairs(index, [similarity, closeness], 40, pairs.EVERY, "every", tile_rows=4000), 40, "closeness").collect()
    order = np.lexsort((j, i, -c))[:40]
    assert [(r.i, r.j, r.closeness) for r in best] == list(zip(i[order].tolist(), j[order].tolist(), c[order].tolist()))
    probes = {r.i: (r.n, r.low, r.high, r.best) for r in pairs.per_probe(index, similarity, tile_rows=4000).collect()}
    own = (i == 17) | (j == 17)
    other, held = np.where(i == 17, j, i)[own], s[own]
    assert len(probes) == N and probes[17] == (N - 1, held.min(), held.max(), other[held == held.max()].min())
    edges = pairs.all_pairs(index, [similarity], tile_rows=4000).agg(F.count(F.lit(1)), F.sum("similarity"), F.countDistinct("i", "j")).first()
    assert tuple(edges) == (len(i), s.sum(), len(i))


@pytest.mark.parametrize("item_rows", [50, 5000])
def test_items_in_parts(items, scores, item_rows):
    i, j, s, c = scores
    key = np.array([f"{k % 2}/{k % 7}" for k in range(N)])
    got = {(r.key_a, r.key_b): r for r in item_pairs(items[1], [similarity, closeness], pairs.EVERY, {"similarity": 60}, {"similarity": 2, "closeness": 1}, tile_rows=4000, item_rows=item_rows).collect()}
    assert len(got) == 91
    own = ((key[i] == "0/2") & (key[j] == "1/3")) | ((key[i] == "1/3") & (key[j] == "0/2"))
    a, b, r = s[own], c[own], got["0/2", "1/3"]
    top = max(zip((2 * a + b).tolist(), i[own].tolist(), j[own].tolist()))
    assert (r.n, r.median_similarity, r.median_closeness, r.reached_similarity, tuple(r.peak)) == (own.sum(), np.median(a), np.median(b), (a >= 60).sum(), top)


@pytest.mark.parametrize("scale", [1, 100, 10**8, 0.37])
def test_closeness_of_blocks(scale):
    x, y = (np.random.default_rng(k).integers(-500, 500, (200 + k, 9)) * scale for k in (1, 2))
    want = np.floor((12000 - np.abs(x[:, None] - y[None]).sum(2)) / 100.0)
    assert np.array_equal(closeness.block(x.astype(float), y.astype(float)), want)


def test_correlation_of_a_single_value_is_not_a_number(spark, duck):
    rows = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0), ("b", 1.0, 2.0), ("b", 2.0, 3.0)], "g string, x double, y double")
    got = {r.g: r.rho for r in tails.spearman(rows, ["g"], "x", "y").collect()}
    assert np.isnan(got["a"]) and np.isnan(duck.sql("SELECT corr(a, b) FROM (VALUES (1, 1), (1, 2)) t(a, b)").fetchall()[0][0]) and abs(got["b"] - 1) < 1e-12


@pytest.mark.parametrize("top", [3, 511, 1023, 1024, 33_000, 70_000])
def test_sums_of_few_bits_are_exact(top):
    """Sums of 64 features whose maxima add up to less, just less and more than 16 bits hold."""
    rng = np.random.default_rng(top)
    a, b = (rng.integers(0, top + 1, (n, 64)).astype(float) - top // 2 for n in (130, 70))
    a[0], b[0], a[1], b[1] = top - top // 2, top - top // 2, -(top // 2), top - top // 2
    before = a.copy(), b.copy()
    apart = np.abs(a[:, None] - b[None]).sum(2)
    assert np.array_equal(closeness.block(a, b), np.floor((12000 - apart) / 100.0))
    assert np.array_equal(similarity.block(a, b), np.floor(a @ b.T / 10000.0) + 60)
    assert np.array_equal(a, before[0]) and np.array_equal(b, before[1])


def test_native_scores_are_compiled_over_columns(spark, items):
    """Functions of arrays were interpreted for every pair."""
    own = items[1].where("idx < 60")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    known = lambda df: sorted(map(tuple, df.collect()))
    native = pairs.all_pairs_native(own, [similarity, closeness], tile_rows=16)
    assert "lambdafunction" not in plan(native)
    assert known(native) == known(pairs.all_pairs(own, [similarity, closeness], tile_rows=16).select("i", "j", "similarity", "closeness"))
    odd = spark.createDataFrame([(0, [1, 2]), (1, [3]), (2, [4, None]), (3, [200, 5000])], "idx long, q array<long>")
    assert "lambdafunction" in plan(pairs.all_pairs_native(odd, [similarity]))
    assert {(r.i, r.j): r.similarity for r in pairs.all_pairs_native(odd, [similarity]).collect()} == {(0, 1): None, (0, 2): None, (0, 3): 61, (1, 2): None, (1, 3): None, (2, 3): None}
    assert pairs.all_pairs_native(odd.where("idx > 9"), [similarity]).count() == 0


@pytest.mark.parametrize("top, wide", [(3000, 64), (-32768, 5), (70000, 64), (2**40, 6)])
def test_a_pairs_code_is_short_enough_for_the_jvm(spark, top, wide):
    """A join of more columns is not compiled by Spark, and a method of more than 8 000 bytes not by the JVM."""
    rng = np.random.default_rng(1)
    rows = [(k, [int(x) for x in rng.integers(-min(abs(top), 30000), 30000, wide)] if k else [top, *[1] * (wide - 1)]) for k in range(9)]
    index = spark.createDataFrame(rows, "idx long, q array<long>")
    native = pairs.all_pairs_native(index, [similarity, closeness], tile_rows=3)
    x = dict(rows)
    want = {(i, j): (sum(a * b for a, b in zip(x[i], x[j])) // 10000 + 60, (12000 - sum(abs(a - b) for a, b in zip(x[i], x[j]))) // 100) for i in x for j in x if i < j}
    assert {(r.i, r.j): (r.similarity, r.closeness) for r in native.collect()} == want
    if abs(top) < 2**15 and wide == 64:
        one = pairs.all_pairs_native(index, [similarity], tile_rows=3).agg(F.sum("similarity"))
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            stages = one._jdf.queryExecution().debug().codegenToSeq()
            joins = [s for s in (stages.apply(k) for k in range(stages.size())) if "SortMergeJoin" in s._1()]
            assert any("SortMergeJoin" in s._1().split("Sort [")[0] and s._3().maxMethodCodeSize() < 8000 for s in joins)
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_listed_pairs_are_summed_in_few_tiles(spark, items, monkeypatch):
    """Lists that name pairs of all blocks made a tile of every two small blocks."""
    index = items[1]
    x = {r.idx: list(r.q) for r in index.select("idx", "q").collect()}
    rng, names = np.random.default_rng(2), sorted(x)
    listed = [(int(k), *map(int, rng.choice(names, 2))) for k in rng.integers(0, 20, 400)] + [(3, names[0], names[1])] * 2 + [(4, names[0], 10**6)]
    seen, real = [], pairs._blocks
    monkeypatch.setattr(pairs, "_blocks", lambda *a, **k: seen.append(real(*a, **k)) or seen[-1])
    got = pairs.listed_totals(spark.createDataFrame(listed, "iter int, i long, j long"), index, similarity, "iter", tile_rows=1)
    want: dict = {}
    for k, i, j in listed:
        if j in x:
            want[k] = want.get(k, 0) + sum(a * b for a, b in zip(x[i], x[j])) // 10000 + 60
    assert {r.iter: r.total for r in got.collect()} == want
    assert seen and all(b.count() <= pairs.MOST_BLOCKS for b in seen)


def test_pruned_tiles_are_few(spark, items, monkeypatch):
    """Blocks of a fixed size made items move as often as there are blocks."""
    index, seen, real = items[1], [], pairs.promising_tiles
    monkeypatch.setattr(pairs, "promising_tiles", lambda blocks, *a: seen.append(blocks.count()) or real(blocks, *a))
    found = [sorted(map(tuple, tails.top(build(), 10).select("i", "j").collect())) for build in (
        lambda: pairs.best_pairs_pruned(index, [similarity], 10, pairs.EVERY, "every", tile_rows=1).withColumnRenamed("similarity", "score"),
        lambda: pairs.best_pairs(index, [similarity], 10, pairs.EVERY, "every").withColumnRenamed("similarity", "score"))]
    assert found[0] == found[1] and seen and seen[0] <= pairs.MOST_BLOCKS
