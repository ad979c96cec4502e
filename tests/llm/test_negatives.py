import math
import random

import pytest
from pyspark.sql import functions as F

from pairloom.llm import negatives
from pairloom.llm.negatives import LEAST, MOST, _shards, hard_negatives
from pairloom.llm.queries import QUERIES, SQL

VECTORS = "vec_id long, embedding array<double>, label int"


def plain(rows, every=5, positives=5, negatives_=3, scale=256):
    """All pairs, one by one, in whole numbers of any size."""
    kept = set()
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        c = tuple(math.floor(x * scale) for x in v)
        if sum(x * x for x in c) <= 1 << 56:
            kept.add((i, c, label))
    out = []
    for a, x, label in kept:
        if a % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), b, other) for b, y, other in kept)
        for s, b, _ in [t for t in scored if t[2] == label and t[1] != a][:positives]:
            fits = [t for t in scored if t[2] != label and 50 * -s <= 100 * -t[0] <= 95 * -s][:negatives_]
            out += [(a, b, k + 1, t[1], -s, -t[0]) for k, t in enumerate(fits)]
    return sorted(out)


def result(spark, rows, every=5, **named):
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    return sorted(map(tuple, hard_negatives(df, F.col("id") % every == 0, **named).collect()))


def clustered(n, dim, seed, labels=3):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        rows.append((i, [x + rng.gauss(0, 0.3) for x in c], rng.randrange(labels)))
    return rows


@pytest.mark.parametrize("shard_rows", [7, 40, None])
def test_matches_all_pairs(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(negatives, "BLOCK", 16)
    rows = clustered(240, 5, 1)
    assert result(spark, rows, shard_rows=shard_rows, pivots=4) == plain(rows)


def test_hot_vector_ties_and_repeated_rows(spark):
    """A third of all rows has one vector; many scores are equal; rows repeat."""
    rng = random.Random(2)
    rows = [(i, [1.0, 0.5, 0.0], i % 2) for i in range(60)] + [(i, [rng.choice([0.5, 1.0]) for _ in range(3)], rng.randrange(3)) for i in range(60, 180)]
    rows += rows[:20]
    assert result(spark, rows, shard_rows=11, pivots=5) == plain(rows)


def test_odd_rows_take_no_part(spark):
    rows = clustered(60, 3, 3)
    odd = [(None, [1.0, 1.0, 1.0], 1), (1000, None, 1), (1005, [1.0, 2.0, 3.0], None), (1010, [1.0, None, 2.0], 1), (1015, [1.0, float("nan"), 2.0], 1), (1020, [float("inf"), 0.0, 0.0], 1), (1025, [1e30, 0.0, 0.0], 1)]
    assert result(spark, rows + odd) == plain(rows)
    assert result(spark, []) == result(spark, odd) == []
    assert result(spark, [(0, [1.0], 1)]) == []


def test_short_empty_and_zero_vectors(spark):
    rows = clustered(40, 4, 4) + [(100, [], 1), (105, [0.0, 0.0], 1), (110, [1.0], 2), (111, [2.0, 1.0], 1)]
    assert result(spark, rows) == plain(rows)


def test_large_numbers_stay_exact(spark):
    """Beyond 2^53 products are made of whole numbers."""
    rows = [(i, [x * 40_000 for x in v], label) for i, v, label in clustered(80, 6, 5)]
    assert max(sum(math.floor(256 * x) ** 2 for x in v) for _, v, _ in rows) > 1 << 47
    assert result(spark, rows) == plain(rows)
    rows = [(i, [x * 300_000 for x in v], label) for i, v, label in clustered(80, 3, 6)]
    assert max(sum(math.floor(256 * x) ** 2 for x in v) for _, v, _ in rows) > 1 << 53
    assert result(spark, rows) == plain(rows)


def test_clashing_columns(spark):
    rows = clustered(50, 3, 7)
    df = spark.createDataFrame(rows, VECTORS).withColumnsRenamed({"vec_id": "qid"})
    for name in ("id", "vec", "norm2", "slots", "shard", "pivot", "kind", "ids", "g", "t", "n", "a.b"):
        df = df.withColumn(name, F.lit(1))
    assert sorted(map(tuple, hard_negatives(df, F.col("id") % 5 == 0, id_col="qid").collect())) == plain(rows)


def test_scan_leaves_out_what_it_may(spark):
    """Far clusters are never visited: bounds of the key rule their shards out."""
    rng = random.Random(8)
    rows = [(i, [(50.0 if k == i % 8 else 0.0) + rng.gauss(0, 0.1) for k in range(8)], i // 8 % 2) for i in range(400)]
    seen = spark.sparkContext.accumulator(0)
    scan = negatives._visits

    def counted(queries, keys, home):
        out = scan(queries, keys, home)
        if not home and queries.where("slots[0].hi = %d" % MOST).count():
            seen.add(out.count())
        return out

    negatives._visits = counted
    try:
        got = result(spark, rows, shard_rows=25, pivots=8)
    finally:
        negatives._visits = scan
    assert got == plain(rows)
    # 80 anchors, 16 shards: less than a third of the visits.
    assert 0 < seen.value < 80 * 16 / 3


def test_strips_become_shards():
    assert _shards([(0, 5), (0, 5), (0, 25), (1, 4), (1, 7)], 10) == ([0, 0, 1, 4, 5], [1, 1, 3, 1, 1])
    assert _shards([], 10) == ([], [])
    assert LEAST < -MOST + 1


def test_query_matches_sql(spark, duck, sf_dir):
    got = QUERIES["op11_hard_negatives"](spark, sf_dir)
    want = duck.sql(SQL["op11_hard_negatives"])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(want.fetchall())
