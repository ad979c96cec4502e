"""Hard negatives by one-dimensional distance keys.

Vectors get one more component, so that all lie on one sphere and the greatest inner product is the
least distance. Each is keyed by (pivot, distance): its nearest pivot and how far it is from it. A
fixed number of strips of that key is counted, and strips become shards: neighbours share one while
they fit, a strip with more rows than a shard holds has several. A task holds one shard, sorted by
its key, and the queries that visit it stream past.

A query first scans the shard its own key falls into. What it finds there bounds the distance that can still
matter. It then visits every other shard whose key interval the triangle inequality cannot rule out, and
in a shard widens its scan outwards, block after block by the least distance each can hold, until that distance
passes the last of its best. Positives are the nearest of the same label. Negatives of a positive lie in an
annulus, between the distances of the highest and the lowest score asked for; blocks wholly within its
inner or beyond its outer edge are left out. Bounds only ever leave out what cannot be returned, so results are exact
whatever the pivots, which come from a sample of at most `SAMPLE` vectors.

Rows of the same vector and label are kept as one with their least ids, as many as can be returned; anchors
of the same vector and label are one query. Neither a hot vector nor a hot label makes a task large.

Scores are whole numbers: products are made in float64 while all sums stay below 2^53, else in int64.

Defined cases: a row with a null id, label or vector, with a null or non-finite component, or with a norm beyond
2^28 takes no part; vectors of different lengths are compared as if filled up with zeros, so an empty vector scores 0; rows
that repeat id, vector and label count once; equal scores come by least id, the anchor's own id is none of its positives;
anchors without positives or without negatives in the range have no rows; an empty table gives an empty result; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairloom.llm.common import shuffle_partitions, staged

#: Vectors that pivots are chosen from, pivots, and strips of each pivot's distances.
SAMPLE, PIVOTS, STRIPS = 4096, 32, 256
#: Components that a shard holds at most, and rows that it is filled with at least where all have few.
SHARD_COMPONENTS, SHARD_ROWS = 1 << 24, 1024
#: Rows of one product.
BLOCK = 2048
#: Norms beyond this take no part: 95 times a score must fit a long.
MOST_NORM = 1 << 28
#: Copies of each answer for anchors that share a query.
SALTS = 8

LEAST, MOST = -(1 << 62), 1 << 62


@dataclass(frozen=True)
class Keys:
    """Pivots on the sphere, and what is in each strip: of fixed size, so it goes to every task."""

    dim: int
    top: int
    pivots: np.ndarray
    pivot: np.ndarray
    low: np.ndarray
    high: np.ndarray
    shard: np.ndarray
    parts: np.ndarray

    @property
    def slack(self) -> float:
        """More than rounding can move a distance."""
        return 1e-6 * (1 + self.top**0.5)

    def distances(self, x: np.ndarray, last: np.ndarray) -> np.ndarray:
        """From each vector, with its further component, to all pivots."""
        squares = (x * x).sum(1) + last * last
        near = squares[:, None] + (self.pivots**2).sum(1)[None, :] - 2 * (x @ self.pivots[:, :-1].T + last[:, None] * self.pivots[None, :, -1])
        return np.sqrt(np.maximum(near, 0))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of whole numbers, filled up with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == dim).all():
        return flat.reshape(len(column), dim).astype(np.int64)
    out = np.zeros((len(column), dim), np.int64)
    out[np.arange(dim)[None, :] < lengths[:, None]] = flat
    return out


def _lifted(x: np.ndarray, top: int) -> np.ndarray:
    """The further component that puts a vector on the sphere."""
    return np.sqrt(np.maximum(top - (x * x).sum(1), 0).astype(np.float64))


def _pivots(x: np.ndarray, top: int, count: int) -> np.ndarray:
    """Means of the sample's clusters: farthest first, then a few turns of Lloyd's."""
    full = np.concatenate([x.astype(np.float64), _lifted(x, top)[:, None]], axis=1)
    centres = [full[0]]
    far = ((full - centres[0]) ** 2).sum(1)
    while len(centres) < min(count, len(full)) and far.max() > 0:
        centres.append(full[int(far.argmax())])
        far = np.minimum(far, ((full - centres[-1]) ** 2).sum(1))
    means = np.array(centres)
    for _ in range(5):
        nearest = ((means**2).sum(1)[None, :] - 2 * full @ means.T).argmin(1)
        for k in range(len(means)):
            if (nearest == k).any():
                means[k] = full[nearest == k].mean(0)
    return means


def _shards(counts: list[tuple[int, int]], most: int) -> tuple[list[int], list[int]]:
    """First shard and number of shards of each strip, from (pivot, rows) in the order of the key."""
    first, parts, at, held, last = [], [], -1, most, None
    for pivot, n in counts:
        if n > most:
            first.append(at + 1)
            parts.append(-(-n // most))
            at, held = at + parts[-1], most
            continue
        if held + n > most or (pivot != last and held > most // 2):
            at, held = at + 1, 0
        first.append(at)
        parts.append(1)
        held, last = held + n, pivot
    return first, parts


def _keyed(rows: DataFrame, keys: Keys) -> DataFrame:
    """rows with pivot, dist and strip."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", pivot int, dist double, strip int"
    width = 2 * (keys.top**0.5) / STRIPS + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("vec"), keys.dim)
                d = keys.distances(x.astype(np.float64), _lifted(x, keys.top))
                pivot = d.argmin(1)
                dist = d[np.arange(len(d)), pivot]
                strip = np.minimum(dist / width, STRIPS - 1)
                extra = [pa.array(pivot.astype(np.int32)), pa.array(dist), pa.array(strip.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "pivot", "dist", "strip"])

    return rows.mapInArrow(run, schema)


_VISIT = "shard int, qid string, label long, vec array<int>, slots array<struct<slot:int,lo:bigint,hi:bigint>>"


def _reach(slots: list, square: float, top: int, slack: float) -> tuple[float, float]:
    """Inner and outer distance of what a query can still use."""
    if not slots:
        return np.inf, -np.inf
    inner = min(max(square + top - 2.0 * s["hi"], 0) for s in slots)
    outer = max(max(square + top - 2.0 * s["lo"], 0) for s in slots)
    return inner**0.5 - slack, outer**0.5 + slack


def _visits(queries: DataFrame, keys: Keys, home: bool) -> DataFrame:
    """Each query with each shard it visits: its home, or all others that its slots' distances reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("vec"), keys.dim).astype(np.float64)
            d = keys.distances(x, np.zeros(len(x)))
            squares = (x * x).sum(1)
            turn = batch.column("turn").to_numpy()
            slots = batch.column("slots").to_pylist()
            at, shard = [], []
            for i in range(len(x)):
                mine = d[i, keys.pivot]
                least = np.maximum(np.maximum(keys.low - mine, mine - keys.high), 0)
                own = int(np.lexsort((np.abs((keys.low + keys.high) / 2 - mine), least))[0])
                own = int(keys.shard[own] + turn[i] % keys.parts[own])
                if home:
                    found = [own] if slots[i] else []
                else:
                    inner, outer = _reach(slots[i], squares[i], keys.top, keys.slack)
                    hit = np.nonzero((least <= outer) & (mine + keys.high >= inner))[0]
                    spread = [np.arange(keys.shard[s], keys.shard[s] + keys.parts[s]) for s in hit]
                    found = np.unique(np.concatenate(spread)) if spread else np.zeros(0, int)
                    found = found[found != own].tolist()
                at += [i] * len(found)
                shard += found
            if at:
                picked = batch.select(["qid", "label", "vec", "slots"]).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), *picked.columns], names=["shard", *picked.schema.names])

    return queries.mapInArrow(run, _VISIT)


class Shard:
    """Rows of one shard in the order of their key, and the best of each query among them."""

    def __init__(self, keys: Keys, parts: list[pa.RecordBatch]):
        self.keys = keys
        column = lambda name: np.concatenate([p.column(name).to_numpy(zero_copy_only=False) for p in parts])
        self.x = np.concatenate([_matrix(p.column("vec"), keys.dim).astype(np.int32) for p in parts])
        self.label, pivot, dist = column("label"), column("pivot"), column("dist")
        ids = [p.column("ids") for p in parts]
        self.ids = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in ids])
        self.start = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(c.offsets.to_numpy()) for c in ids]))])
        cuts = {0, len(pivot), *(np.nonzero(np.diff(pivot))[0] + 1).tolist()}
        edges = sorted(cuts)
        self.blocks = [(a, min(a + BLOCK, end)) for begin, end in zip(edges, edges[1:]) for a in range(begin, end, BLOCK)]
        self.pivot = np.array([pivot[a] for a, _ in self.blocks])
        self.low = np.array([dist[a] for a, _ in self.blocks])
        self.high = np.array([dist[b - 1] for _, b in self.blocks])

    def products(self, q: np.ndarray, a: int, b: int) -> np.ndarray:
        kind = np.float64 if self.keys.top < 1 << 53 else np.int64
        return (q.astype(kind) @ self.x[a:b].astype(kind).T).astype(np.int64)

    def search(self, q: np.ndarray, label: np.ndarray, slots: list, k: int, same: bool):
        """(query, slot, score, id) arrays of the k best of each slot."""
        keys, n = self.keys, max((len(s) for s in slots), default=0)
        lo, hi = np.full((len(q), n), MOST), np.full((len(q), n), LEAST)
        name = np.zeros((len(q), n), int)
        for i, row in enumerate(slots):
            for j, s in enumerate(row):
                lo[i, j], hi[i, j], name[i, j] = s["lo"], s["hi"], s["slot"]
        x = q.astype(np.float64)
        d, squares = keys.distances(x, np.zeros(len(x))), (x * x).sum(1)
        at = d[:, self.pivot]
        least, most = np.maximum(np.maximum(self.low - at, at - self.high), 0), at + self.high
        used = lo <= hi
        inner = np.where(used, np.maximum(squares[:, None] + keys.top - 2.0 * hi, 0), np.inf).min(1) ** 0.5 - keys.slack
        best = np.zeros((4, 0), np.int64)
        for block in np.argsort(least.min(0), kind="stable"):
            outer = np.where(used, np.maximum(squares[:, None] + keys.top - 2.0 * lo, 0), -1.0).max(1)
            live = np.nonzero((outer >= 0) & (least[:, block] <= np.sqrt(np.maximum(outer, 0)) + keys.slack) & (most[:, block] >= inner))[0]
            if not len(live):
                continue
            a, b = self.blocks[block]
            scores = self.products(q[live], a, b)
            fits = (label[live, None] == self.label[None, a:b]) == same
            found = [best]
            for j in range(n):
                ok = fits & (scores >= lo[live, j, None]) & (scores <= hi[live, j, None])
                if not ok.any():
                    continue
                if b - a > k:
                    kept = np.where(ok, scores, LEAST)
                    ok &= kept >= np.partition(kept, b - a - k, axis=1)[:, b - a - k, None]
                i, row = np.nonzero(ok)
                many = self.start[a + row + 1] - self.start[a + row]
                one = np.repeat(np.arange(len(i)), many)
                place = np.arange(len(one)) - np.repeat(np.cumsum(many) - many, many)
                found.append(np.array([live[i[one]], np.full(len(one), j), scores[i[one], row[one]], self.ids[self.start[a + row[one]] + place]]))
            best = np.concatenate(found, axis=1)
            best = best[:, np.lexsort((best[3], -best[2], best[1], best[0]))]
            group = best[0] * max(n, 1) + best[1]
            begins = np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else np.zeros(0, bool)
            rank = np.arange(len(group)) - np.maximum.accumulate(np.where(begins, np.arange(len(group)), 0))
            best = best[:, rank < k]
            last = rank[rank < k] == k - 1
            lo[best[0, last], best[1, last]] = best[2, last]
        return best[0], name[best[0], best[1]] if n else best[1], best[2], best[3]


def _scan(rows: DataFrame, visits: DataFrame, keys: Keys, k: int, same: bool) -> DataFrame:
    """qid, slot, score, id: the k best of each visit, from shards that are held one at a time."""
    nothing = lambda kind: F.lit(None).cast(kind)
    left = rows.select("shard", F.lit(0).alias("kind"), "label", "vec", "pivot", "dist", "ids", nothing("string").alias("qid"), nothing("array<struct<slot:int,lo:bigint,hi:bigint>>").alias("slots"))
    right = visits.select("shard", F.lit(1).alias("kind"), "label", "vec", nothing("int").alias("pivot"), nothing("double").alias("dist"), nothing("array<bigint>").alias("ids"), "qid", "slots")
    both = left.unionByName(right).repartition(max(shuffle_partitions(rows.sparkSession), min(4096, int(keys.shard.max()) + 1)), "shard").sortWithinPartitions("shard", "kind", "pivot", "dist")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, shard = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            tags = batch.column("shard").to_numpy().astype(np.int64) * 2 + batch.column("kind").to_numpy()
            edges = [0, *(np.nonzero(np.diff(tags))[0] + 1).tolist(), len(tags)]
            for a, b in zip(edges, edges[1:]):
                here, query = divmod(int(tags[a]), 2)
                if here != at:
                    at, parts, shard = here, [], None
                piece = batch.slice(a, b - a)
                if not query:
                    parts.append(piece)
                    continue
                if shard is None and parts:
                    shard, parts = Shard(keys, parts), []
                if shard is None:
                    continue
                i, slot, score, found = shard.search(_matrix(piece.column("vec"), keys.dim), piece.column("label").to_numpy(), piece.column("slots").to_pylist(), k, same)
                if len(i):
                    yield pa.RecordBatch.from_arrays([piece.column("qid").take(pa.array(i)), pa.array(slot.astype(np.int32)), pa.array(score), pa.array(found)], names=["qid", "slot", "score", "id"])

    return both.mapInArrow(run, "qid string, slot int, score bigint, id bigint")


def _first(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query's slot: Spark limits each partition's groups before it moves them."""
    order = Window.partitionBy("qid", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search(rows: DataFrame, queries: DataFrame, keys: Keys, k: int, same: bool, name: str) -> DataFrame:
    """qid, slot, score, id, rank: the home shard first, then all that its findings cannot rule out."""
    near = staged(_first(_scan(rows, _visits(queries, keys, True), keys, k, same), k), f"{name}_home")
    last = near.where(F.col("rank") == k).groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("last"))
    closer = F.transform("slots", lambda s: F.struct(s["slot"].alias("slot"), F.greatest(s["lo"], F.try_element_at("last", s["slot"])).alias("lo"), s["hi"].alias("hi")))
    rest = queries.join(last, "qid", "left").withColumn("slots", closer).drop("last")
    far = _scan(rows, _visits(rest, keys, False), keys, k, same)
    return staged(_first(near.drop("rank").unionByName(far), k), name)


def _usable(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int) -> DataFrame:
    """id, label, vec (whole numbers), norm2 and qid of the rows that take part."""
    vec, one = F.col(f"`{vec_col}`"), lambda x: x.cast("double")
    plain = F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(one(x)) & (F.abs(one(x)) <= float(MOST_NORM))), F.lit(False))
    rows = vectors.where(plain).select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), F.transform(vec, lambda x: F.floor(one(x) * scale).cast("long")).alias("vec")
    )
    rows = rows.dropna().withColumn("norm2", F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))).where(F.col("norm2") <= float(MOST_NORM) ** 2)
    return rows.select("id", "label", F.col("vec").cast("array<int>").alias("vec"), "norm2", F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.col("vec").cast("array<string>")), 256).alias("qid"))


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column | None = None,
    positives: int = 5,
    negatives: int = 3,
    lowest: int = 50,
    highest: int = 95,
    scale: int = 256,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    pivots: int = PIVOTS,
    shard_rows: int | None = None,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components are rounded down after `scale`. For each anchor (is_anchor: of its `id`) and each of its first `positives`
    rows of the same label: the first `negatives` rows of other labels that score from `lowest` to `highest` hundredths of the positive's.
    """
    spark = vectors.sparkSession
    is_anchor = F.col("id") % 50 == 0 if is_anchor is None else is_anchor
    usable = _usable(vectors, id_col, vec_col, label_col, scale)
    # As many ids of equal rows as one anchor can be given, its own besides.
    most = max(positives + 1, negatives)
    order = Window.partitionBy("qid").orderBy("id")
    least = usable.dropDuplicates(["qid", "id"]).withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    rows = staged(least.groupBy("qid").agg(F.any_value("label").alias("label"), F.any_value("vec").alias("vec"), F.max("norm2").alias("norm2"), F.array_sort(F.collect_list("id")).alias("ids")), "distinct_vectors")
    size, top, total = rows.agg(F.max(F.size("vec")), F.max("norm2"), F.count(F.lit(1))).first()
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not total:
        return empty
    dim, top = max(1, int(size)), int(top)
    sample = rows.select("qid", "vec").orderBy("qid").limit(SAMPLE).select("vec").toArrow()["vec"].combine_chunks()
    centres = _pivots(_matrix(sample, dim), top, pivots)
    plain = Keys(dim, top, centres, *[np.zeros(0, int)] * 5)
    keyed = staged(_keyed(rows.drop("norm2"), plain), "keyed_vectors")
    strips = keyed.groupBy("pivot", "strip").agg(F.count(F.lit(1)).alias("n"), F.min("dist").alias("low"), F.max("dist").alias("high")).orderBy("pivot", "strip").toPandas()
    room = shard_rows or max(SHARD_ROWS, min(SHARD_COMPONENTS // dim, -(-total // (2 * shuffle_partitions(spark)))))
    first, parts = _shards(list(zip(strips["pivot"].tolist(), strips["n"].tolist())), room)
    keys = Keys(dim, top, centres, strips["pivot"].to_numpy(), strips["low"].to_numpy(), strips["high"].to_numpy(), np.array(first), np.array(parts))
    dealt = spark.createDataFrame([(int(p), int(s), f, n) for p, s, f, n in zip(strips["pivot"], strips["strip"], first, parts)], "pivot int, strip int, first int, parts int")
    turn = F.pmod(F.xxhash64("qid"), F.lit(1 << 30))
    sharded = keyed.join(F.broadcast(dealt), ["pivot", "strip"]).withColumn("shard", (F.col("first") + turn % F.col("parts")).cast("int"))

    anchors = usable.where(is_anchor).select("id", "label", "vec", "qid").dropDuplicates(["qid", "id"])
    slot = lambda j, lo, hi: F.struct(j.cast("int").alias("slot"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))
    whole = F.array(slot(F.lit(0), F.lit(LEAST + 1), F.lit(MOST)))
    queries = staged(anchors.groupBy("qid").agg(F.any_value("label").alias("label"), F.any_value("vec").alias("vec")).withColumns({"turn": turn, "slots": whole}), "anchor_vectors")
    same = _search(sharded, queries, keys, positives + 1, True, "positives")
    listed = same.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "id"))).alias("given"))
    # The range of negatives is empty below a score of 0.
    ranges = F.transform(F.filter("given", lambda g: g["score"] >= 0), lambda g: slot(g["rank"], _whole_div(g["score"] * lowest + 99), _whole_div(g["score"] * highest)))
    asked = staged(queries.drop("slots").join(listed, "qid").withColumn("slots", ranges).drop("given"), "ranges")
    other = _search(sharded, asked, keys, negatives, False, "negatives")
    answers = listed.join(other.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("slot", "rank", "score", "id"))).alias("taken")), "qid")
    salted = answers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = anchors.select(F.col("id").alias("anchor_id"), "qid", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt")).join(salted, ["qid", "salt"])
    out = out.withColumn("g", F.explode(F.slice(F.filter("given", lambda g: g["id"] != F.col("anchor_id")), 1, positives)))
    out = out.withColumn("t", F.explode(F.filter("taken", lambda t: t["slot"] == F.col("g.rank"))))
    return out.select("anchor_id", F.col("g.id").alias("positive_id"), F.col("t.rank").alias("rank"), F.col("t.id").alias("negative_id"), F.col("g.score").alias("positive_score"), F.col("t.score").alias("negative_score"))


def _whole_div(x: Column) -> Column:
    """x div 100 for x of 0 or more."""
    return F.call_function("div", x, F.lit(100).cast("long"))
