"""Closed-form counts and brute-force checks of pair operators."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairloom.operators import fields, pairs, tails
from pairloom.operators.item_pairs import item_pairs
from pairloom.operators.scorers import Scorer, closeness, external, mirrored, one_sided, similarity


@pytest.fixture(scope="module")
def index(spark):
    rng = np.random.default_rng(0)
    n = 96  # 4 sources, 3 items, 8 impressions
    pdf = pd.DataFrame({"idx": np.arange(n), "source": np.arange(n) // 24, "finger_id": np.arange(n) // 8 % 3})
    pdf["key"] = pdf["source"].astype(str) + "/" + pdf["finger_id"].astype(str)
    pdf["q"] = rng.integers(-200, 200, (n, 64)).tolist()
    return spark.createDataFrame(pdf).cache()


def brute(index, scorer):
    pdf = index.toPandas().sort_values("idx")
    x = np.array(pdf["q"].tolist(), float)
    return scorer.block(x, x)


@pytest.mark.parametrize("tile", [7, 32, 1000])
def test_all_pairs(index, tile):
    got = pairs.all_pairs(index, [similarity, closeness], tile_rows=tile).toPandas()
    assert len(got) == 96 * 95 // 2 and not got.duplicated(["i", "j"]).any() and (got.i < got.j).all()
    for s in (similarity, closeness):
        assert (got[s.name] == brute(index, s)[got.i, got.j]).all()


def test_native_is_the_same(index):
    a = pairs.all_pairs(index, [similarity, closeness], tile_rows=32)
    b = pairs.all_pairs_native(index, [similarity, closeness], tile_rows=16)
    assert a.exceptAll(b).count() == 0 and b.count() == a.count()


def test_classes(index):
    e = pairs.with_attributes(pairs.all_pairs(index, [similarity]), index, ["source", "finger_id", "key"])
    n = {r.c: r["count"] for r in e.groupBy(pairs.three_way_class().alias("c")).count().collect()}
    assert n["genuine"] == 12 * 28
    assert n["artefact"] == 3 * 6 * 64
    assert sum(n.values()) == 96 * 95 // 2
    two = {r.c: r["count"] for r in e.groupBy(pairs.two_way_class().alias("c")).count().collect()}
    assert two["impostor"] == n["artefact"] + n["impostor"]
    blocks = pairs.item_blocks(e).groupBy("key_a", "key_b").count().collect()
    assert len(blocks) == 12 * 11 // 2 and {r["count"] for r in blocks} == {64}


@pytest.mark.parametrize("tile", [7, 1000])
def test_tiles_carry_and_count(spark, index, tile):
    """Attributes from the tiles are those of joins, nulls too; counts and best pairs of tiles are those of all pairs."""
    named = index.withColumn("name", F.when(F.col("idx") % 5 != 0, F.col("key")))
    columns = ["source", "finger_id", "name"]
    joined = pairs.with_attributes(pairs.all_pairs(named, [similarity, closeness], tile_rows=tile), named, columns)
    carried = pairs.all_pairs(named, [similarity, closeness], tile_rows=tile, attributes=tuple(columns))
    assert sorted(carried.columns) == sorted(joined.columns) and carried.select(joined.columns).exceptAll(joined).count() == 0
    for classes in (pairs.TWO_WAY, pairs.THREE_WAY):
        e = joined.withColumn("pair_class", classes.column())
        want = e.groupBy("pair_class", "similarity", "closeness").agg(F.count(F.lit(1)).alias("n"))
        got = pairs.class_histogram(named, [similarity, closeness], classes, tile_rows=tile)
        assert got.exceptAll(want.select(got.columns)).count() == 0 and got.count() == want.count()
    wanted = joined.where(pairs.three_way_class() == "impostor")
    found = pairs.best_pairs(named, [similarity, closeness], 9, pairs.THREE_WAY, "impostor", tile_rows=tile)
    for s in ("similarity", "closeness"):
        assert tails.top(found, 9, s).select("i", "j", s).collect() == tails.top(wanted, 9, s).select("i", "j", s).collect()
    empty = named.limit(0)
    assert pairs.class_histogram(empty, [similarity], pairs.TWO_WAY).count() == 0 and pairs.all_pairs(empty, [similarity], attributes=("name",)).count() == 0


def test_one_pass_over_the_pairs(spark, sf_dir):
    """No query scores the pairs more than once."""
    from pairloom.plans import catalog

    for name in ("allvsall_hist", "spearman_scorers", "mann_whitney_auc", "top_impostors", "percentile_disc_by_class", "directed_symmetrise", "cohens_d", "body_class_distribution", "probe_gallery", "rank1_identification"):
        df = catalog.QUERIES[name].build(spark, sf_dir)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("MapInArrow") == 1, name


def test_directed(index):
    d = pairs.rectangle(index, index, [one_sided], tile_rows=40).withColumnRenamed("one_sided", "score")
    assert d.count() == 96 * 96
    m = brute(index, one_sided)
    got = pairs.symmetrised(d).toPandas()
    assert (got.score == np.maximum(m, m.T)[got.i, got.j]).all()


def test_empty_index(spark, index):
    assert pairs.all_pairs(index.limit(0), [similarity]).count() == 0
    assert pairs.rectangle(index.limit(0), index, [similarity]).count() == 0


def test_external_scorer(spark):
    df = spark.createDataFrame([("a", "bb"), ("ccc", "d")], "path_a string, path_b string")
    got = external(df, lambda a, b: [len(x) + len(y) for x, y in zip(a, b)])
    assert [r.score for r in got.orderBy("path_a").collect()] == [3, 4]
    with pytest.raises(Exception, match="2 pairs asked for|pairs asked for"):
        external(df.coalesce(1), lambda a, b: [1]).collect()


def test_percentiles_and_rates(spark):
    values = [1, 1, 2, 5, 5, 5, 9]
    hist = tails.histogram(spark.createDataFrame([(v, "x") for v in values], "score int, c string"), ["c"])
    got = {r.percent: r.value for r in tails.discrete_percentiles(hist, ["c"], (0, 50, 90, 100)).collect()}
    assert got == {0: 1, 50: 5, 90: 9, 100: 9}
    rates = {r.score: r.rate for r in tails.match_rates(hist.drop("c")).collect()}
    assert rates == {s: pytest.approx(sum(v >= s for v in values) / 7) for s in set(values)}
    assert [r.n for r in tails.zero_filled(hist.drop("c")).orderBy("score").collect()] == [0, 2, 1, 0, 0, 3, 0, 0, 0, 1]


def test_spearman(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 9, 300)
    b = a + rng.integers(0, 9, 300)
    got = tails.spearman(spark.createDataFrame(pd.DataFrame({"a": a, "b": b})), [], "a", "b").first()
    assert got.rho == pytest.approx(pd.Series(a).rank().corr(pd.Series(b).rank())) and got.n == 300


def loops(spark, turn):
    """A field whose axes turn by `turn` half circles around the middle."""
    cells = []
    for r in range(12):
        for c in range(12):
            angle = turn * np.arctan2(-(r - 5.5), c - 5.5) / 2
            cells.append((0, r, c, int(round(angle / (np.pi / 16))) % 16, 1, 0))
    return spark.createDataFrame(cells, "image long, r int, c int, dir int, quality int, curved int")


@pytest.mark.parametrize(("turn", "kind"), [(1, "core"), (-1, "delta")])
def test_singular_points(spark, turn, kind):
    got = fields.singular_points(loops(spark, turn)).toPandas()
    assert set(got.kind) == {kind} and np.hypot(got.r - 5.5, got.c - 5.5).max() < 2


def test_flat_field_is_an_arch(spark):
    flat = loops(spark, 0)
    assert fields.classes(flat).first().pattern == "arch"
    m = fields.axial_mean(flat).first()
    assert m.coherence == pytest.approx(1) and m.direction == pytest.approx(0, abs=1e-9)
    assert fields.orientation_entropy(flat).first().entropy == pytest.approx(0, abs=1e-12)
    few = flat.where("r < 2 and c < 4")
    assert fields.classes(few).first().pattern == "undetermined" and fields.orientation_entropy(few).first().entropy is None


def test_clusters_and_dipoles():
    points = np.array([[0.5, 0.5], [0.5, 1.5], [9.5, 9.5]])
    centres = fields.greedy_clusters(points)
    assert centres.tolist() == [[0.5, 1.0], [9.5, 9.5]]
    cores, deltas = fields.cancel_dipoles(centres, np.array([[0.5, 2.0], [5.0, 5.0]]))
    assert cores.tolist() == [[9.5, 9.5]] and deltas.tolist() == [[5.0, 5.0]]
    assert fields.pattern(cores, deltas) == "left_loop"
    assert fields.pattern(np.zeros((2, 2)), np.zeros((0, 2))) == "whorl"
    assert fields.pattern(np.zeros((0, 2)), np.zeros((1, 2))) == "undetermined"


def test_growth_takes_everybody_once(spark):
    """Scores of numbers are their products, so the greatest of a sample is that of its two greatest people."""
    product = Scorer("product", lambda a, b: (a[0] * b[0]).cast("long"), lambda a, b: a @ b.T)
    rows = [(k, k // 2, [float(3 + k // 2)]) for k in range(12)]
    index = spark.createDataFrame(rows, "idx long, person long, q array<double>")
    order = lambda rep, p: F.md5(F.concat_ws(":", rep, p))
    got = {r.k: r for r in tails.growth_of_maximum(index, product, [2, 4, 9], 5, order).collect()}
    people = [r.person for r in index.select("person").distinct().collect()]
    assert set(got) == {2, 4, 6} and got[6].reps == 1 and got[6].mean_top == 8 * 7 and got[6].std_top == 0
    import hashlib

    for k in (2, 4):
        tops = []
        for rep in range(5):
            first = sorted(people, key=lambda p: hashlib.md5(f"{rep}:{p}".encode()).hexdigest())[:k]
            a, b = sorted(3 + p for p in first)[-2:]
            tops.append(a * b)
        assert got[k].reps == 5 and got[k].mean_top == pytest.approx(np.mean(tops)) and got[k].std_top == pytest.approx(np.std(tops))


@pytest.mark.parametrize("tile", [7, 40, 1000])
def test_probes_and_both_directions(index, tile):
    m = brute(index, similarity)
    got = pairs.per_probe(index, similarity, tile_rows=tile).toPandas().sort_values("i")
    np.fill_diagonal(m, -1000)
    assert got.i.tolist() == list(range(96)) and (got.n == 95).all() and (got.high == m.max(1)).all() and (got.best == m.argmax(1)).all()
    np.fill_diagonal(m, 1000)
    assert (got.low == m.min(1)).all()
    d = brute(index, one_sided)
    both = np.maximum(d, d.T)[np.triu_indices(96, 1)]
    hist = pairs.class_histogram(index, [mirrored(one_sided)], pairs.EVERY, tile_rows=tile).collect()
    assert {r.one_sided: r.n for r in hist} == dict(zip(*np.unique(both, return_counts=True)))
    assert pairs.per_probe(index.limit(0), similarity).count() == 0


@pytest.mark.parametrize(("tile", "item"), [(7, 1000), (30, 1000), (1000, 1000), (20, 3)])
def test_whole_items_and_pieces(index, tile, item):
    """Items of one and of 30 rows, whole or cut into pieces: the same medians, counts and peaks."""
    index = index.withColumn("key", F.when(F.col("idx") < 30, "hot").when(F.col("idx") == 95, "one").otherwise(F.col("key")))
    pdf = index.toPandas().sort_values("idx")
    m = {s.name: brute(index, s) for s in (similarity, closeness)}
    i, j = np.triu_indices(96, 1)
    key = pdf.key.to_numpy()
    e = pd.DataFrame({"a": np.minimum(key[i], key[j]), "b": np.maximum(key[i], key[j]), "c": np.where(pdf.finger_id.to_numpy()[i] == pdf.finger_id.to_numpy()[j], np.where(pdf.source.to_numpy()[i] == pdf.source.to_numpy()[j], "genuine", "artefact"), "impostor"), "i": i, "j": j})
    for n, x in m.items():
        e[n] = x[i, j].astype(int)
    e["sum"] = e.similarity * 2 + e.closeness
    e = e[e.a != e.b]
    got = item_pairs(index, [similarity, closeness], pairs.THREE_WAY, {"similarity": 60}, {"similarity": 2, "closeness": 1}, tile_rows=tile, item_rows=item).collect()
    want = {k: g for k, g in e.groupby(["a", "b", "c"])}
    assert {(r.key_a, r.key_b, r.pair_class) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        g = want[r.key_a, r.key_b, r.pair_class]
        top = g.sort_values(["sum", "i", "j"]).iloc[-1]
        assert (r.n, r.median_similarity, r.median_closeness, r.reached_similarity) == (len(g), g.similarity.median(), g.closeness.median(), (g.similarity >= 60).sum())
        assert (r.peak["sum"], r.peak.i, r.peak.j) == (top["sum"], top.i, top.j)


@pytest.mark.parametrize("ordered", [False, True])
def test_tiles_left_out(spark, ordered):
    """On clustered features at least half of the tiles are not made, and the best pairs are the same."""
    rng = np.random.default_rng(7)
    n, groups = 400, 10
    # With an order, clusters lie all over the index.
    group = np.arange(n) % groups if ordered else np.arange(n) // (n // groups)
    x = rng.integers(-300, 300, (groups, 64))[group] + rng.integers(-20, 20, (n, 64))
    pdf = pd.DataFrame({"idx": np.arange(n), "source": 0, "finger_id": np.arange(n) % 7, "group": group, "q": x.tolist()})
    index = spark.createDataFrame(pdf)
    made = spark.sparkContext.accumulator(0)
    whole = Scorer("similarity", similarity.column, lambda a, b: (made.add(1), similarity.block(a, b))[1], bound=similarity.bound)
    for scorers in ([whole], [closeness], [whole, closeness]):
        want = pairs.best_pairs(index, [similarity if s is whole else s for s in scorers], 100, pairs.THREE_WAY, "impostor", tile_rows=20)
        before = made.value
        got = pairs.best_pairs_pruned(index, scorers, 100, pairs.THREE_WAY, "impostor", tile_rows=20, order=F.col("group") if ordered else None)
        rows = got.collect()
        for s in scorers:
            best = lambda d: sorted(((-r[s.name], r.i, r.j) for r in d))[:100]
            assert best(rows) == best(want.collect())
        if scorers == [whole]:
            # The diagonal's 20 tiles are made twice.
            assert 0 < made.value - before - 20 <= 20 * 21 // 2 / 2
    tight = Scorer("similarity", similarity.column, similarity.block)
    assert len(pairs.best_pairs_pruned(index, [tight], 5, pairs.THREE_WAY, "impostor", tile_rows=50).collect()) > 0
    few = pairs.best_pairs_pruned(index.where("idx < 3"), [similarity], 100, pairs.THREE_WAY, "impostor")
    assert len(few.collect()) == 3 and pairs.best_pairs_pruned(index.limit(0), [similarity], 5, pairs.THREE_WAY, "impostor").count() == 0


def test_listed_and_named_pairs(spark, index):
    m = brute(index, similarity)
    rng = np.random.default_rng(5)
    rows = [(int(k % 3), int(min(a, b)), int(max(a, b))) for k, (a, b) in enumerate(rng.integers(0, 96, (200, 2)).tolist()) if a != b]
    rows += rows[:5] + [(9, 3, 5000)]
    listed = spark.createDataFrame(rows, "tag int, i long, j long")
    got = sorted((r.tag, r.i, r.j, r.similarity) for r in pairs.listed_pairs(listed, index, [similarity], tile_rows=16).collect())
    assert got == sorted((t, i, j, int(m[i, j])) for t, i, j in rows if j < 96)
    two = pairs.named_pairs(index.where("key = '3/2'"), index.where("key = '0/1'"), [similarity], {"similarity": 60}).collect()
    assert len(two) == 64 and all(r.i < r.j and r.similarity == (int(m[r.i, r.j]) if m[r.i, r.j] >= 60 else None) for r in two)


def test_classes_apart_and_against(index):
    """Excluded ends make classes of their own; pairs against another index and within it make the whole."""
    held = index.withColumn("gone", F.col("idx") % 10 == 0)
    whole = {(r.pair_class, r.similarity): r.n for r in pairs.class_histogram(index, [similarity], pairs.THREE_WAY).collect()}
    split: dict = {}
    for r in pairs.class_histogram(held, [similarity], pairs.apart(pairs.THREE_WAY, "gone")).collect():
        k = (r.pair_class.removeprefix("excluded_"), r.similarity)
        split[k] = split.get(k, 0) + r.n
    assert split == whole
    low, high = index.where("idx < 40"), index.where("idx >= 40")
    parts: dict = {}
    for h in (pairs.class_histogram(low, [similarity], pairs.THREE_WAY), pairs.class_histogram(high, [similarity], pairs.THREE_WAY), pairs.class_histogram(low, [similarity], pairs.THREE_WAY, tile_rows=16, against=high)):
        for r in h.collect():
            parts[r.pair_class, r.similarity] = parts.get((r.pair_class, r.similarity), 0) + r.n
    assert parts == whole


def test_cohens_d(spark):
    rng = np.random.default_rng(6)
    x, g = rng.integers(0, 50, 400), rng.integers(0, 2, 400)
    hist = spark.createDataFrame(pd.DataFrame({"x": x, "g": g})).groupBy("x", "g").agg(F.count(F.lit(1)).alias("n"))
    a, b = x[g == 1], x[g == 0]
    d = (a.mean() - b.mean()) / np.sqrt(((len(a) - 1) * a.var(ddof=1) + (len(b) - 1) * b.var(ddof=1)) / 398)
    got = tails.cohens_d(hist, F.col("g") == 1, "x").first()
    assert (got.n1, got.n2) == (len(a), len(b)) and got.d == pytest.approx(d)
