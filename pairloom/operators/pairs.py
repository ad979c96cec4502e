"""Pair generation, pair classes and lookups on pair tables.

An index has a whole-number `idx`, a feature column and attributes. Pairs are made tile by tile: items
are cut into blocks by idx, every pair of blocks is a key, and blocks meet by an equi-join on that key.
No side is broadcast and no row is compared outside its tile. There are at most `MOST_BLOCKS` blocks, so an
item goes to at most so many tiles and one more, and what is shuffled grows with the index and not with its
pairs. A task holds two blocks and compares them in parts of `PART_ROWS` items, so that scores never take
more than a part. Attributes travel in the blocks, so pairs need no joins to get them.

Where only counts or the best pairs are wanted, a tile folds its parts and gives its own (`class_histogram`,
`best_pairs`), so that what leaves it does not grow with the pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.operators.scorers import Scorer
from pairloom.sources.files import cached
from pairloom.sources.ordered import numbered
from pairloom.sources.scratch import scratch

#: Least rows of a block, and most blocks of an index.
TILE_ROWS, MOST_BLOCKS = 256, 32
#: Rows of either side of a tile that are compared at once.
PART_ROWS = 512
#: Rows that a tile's fold gathers before it merges them.
GATHERED = 200_000
#: Listed pairs that are scored at once, and numbers that their lists are gathered by.
LISTED_ROWS, LISTED_TOGETHER = 20_000, 8
#: Features that are columns at most.
MOST_COLUMNS = 256
#: Columns of a join that Spark compiles (spark.sql.codegen.maxFields).
COMPILED_COLUMNS = 100


@dataclass(frozen=True)
class PairClass:
    """Classes of pairs by the attributes of both ends.

    column: of the attributes as name_i and name_j. block: of {attribute: values} of two blocks, the number of each pair's class
    in names.
    """

    attributes: tuple[str, ...]
    names: tuple[str, ...]
    column: Callable[[], Column]
    block: Callable[[dict, dict], np.ndarray]


def _equal(a: dict, b: dict, attribute: str) -> np.ndarray:
    return a[attribute][:, None] == b[attribute][None, :]


def _blocks(index: DataFrame, features: str, rows: int, attributes: tuple[str, ...] = (), first: int = 0) -> DataFrame:
    block = F.floor((F.col("idx") - first) / rows).cast("int").alias("block")
    # In structs, as a list of plain values leaves nulls out.
    carried = [F.transform(F.collect_list(F.struct(F.col(c).alias("v"))), lambda x: x["v"]).alias(f"a_{c}") for c in attributes]
    return index.groupBy(block).agg(F.collect_list("idx").alias("ids"), F.flatten(F.collect_list(F.col(features).cast("array<double>"))).alias("x"), *carried)


def _extent(index: DataFrame, tile_rows: int) -> tuple[int, int, int]:
    """The least idx, how many in a row make a block, so that there are at most MOST_BLOCKS, and the last block."""
    low, high = index.agg(F.coalesce(F.min("idx"), F.lit(0)), F.coalesce(F.max("idx"), F.lit(0))).first()
    rows = max(tile_rows, -(-(high - low + 1) // MOST_BLOCKS))
    return low, rows, (high - low) // rows


def _even_blocks(index: DataFrame, features: str, tile_rows: int, attributes: tuple[str, ...] = ()) -> DataFrame:
    first, rows, _ = _extent(index, tile_rows)
    return _blocks(index, features, rows, attributes, first)


def _meet(left: DataFrame, right: DataFrame, triangle: bool) -> DataFrame:
    """Rows of a block and another one, whose columns end in 2, for every pair of blocks; triangle: only block <= block2."""
    other = [F.col(c).alias(f"{c}2") for c in right.columns if c != "block"]
    own = [c for c in left.columns if c != "block"]
    top_left, top_right = (df.agg(F.coalesce(F.max("block"), F.lit(-1))).first()[0] for df in (left, right))
    if min(top_left, top_right) < 0:
        return left.select(*own).crossJoin(right.select(*other)).where("false")
    a = left.select(*own, F.col("block").alias("p"), F.explode(F.sequence(F.col("block") if triangle else F.lit(0), F.lit(top_right))).alias("q"))
    b = right.select(*other, F.col("block").alias("q"), F.explode(F.sequence(F.lit(0), F.col("block") if triangle else F.lit(top_left))).alias("p"))
    # The planner does not see that the sides were multiplied, and would broadcast what it takes for a small table.
    return a.join(b.hint("merge"), ["p", "q"]).drop("p", "q")


def _parts(tile: dict, triangle: bool, rows: int | None) -> Iterator[dict]:
    """Tiles of at most so many rows on either side that make up a tile; of a triangle only those that have pairs."""
    if rows is None:
        yield tile
        return
    sides = [{c: tile[c] for c in tile if f"{c}2" in tile}, {f"{c}2": tile[f"{c}2"] for c in tile if f"{c}2" in tile}]
    rest = {c: v for c, v in tile.items() if c not in sides[0] and c not in sides[1]}
    cut: list[list[dict]] = []
    for side, two in zip(sides, ("", "2")):
        n = len(side[f"ids{two}"])
        width = len(side[f"x{two}"]) // max(1, n)
        x = np.asarray(side.pop(f"x{two}")).reshape(n, width)
        if triangle:
            order = np.argsort(np.asarray(side[f"ids{two}"]), kind="stable")
            x, side = x[order], {c: v.take(pa.array(order)) for c, v in side.items()}
        cut.append([{f"x{two}": x[k : k + rows].ravel(), **{c: v.slice(k, rows) for c, v in side.items()}} for k in range(0, n, rows)])
    for a in cut[0]:
        for b in cut[1]:
            if not triangle or a["ids"][0].as_py() < b["ids2"][-1].as_py():
                yield {**rest, **a, **b}


def _per_tile(tiles: DataFrame, scorers: list[Scorer], triangle: bool, work, schema: str, rows: int | None = PART_ROWS, fold=None, can=None) -> DataFrame:
    """work(tile, ids, ids2, keep, scores) -> record batch, for every part of every tile. tile: a dict of its columns as Arrow arrays.

    rows: of either side of a part; None leaves tiles whole. fold: of what work gives for the parts of one tile, record batches of the tile.
    can: whether a part's features can make what is wanted; others are left out.
    """

    def scored(tile: dict) -> Iterator[pa.RecordBatch]:
        for part in _parts(tile, triangle, rows):
            ids, x, ids2, x2 = (np.asarray(part[c]) for c in ("ids", "x", "ids2", "x2"))
            x, x2 = x.reshape(len(ids), -1), x2.reshape(len(ids2), -1)
            if can and not can(x, x2):
                continue
            keep = ids[:, None] < ids2[None, :] if triangle else np.ones((len(ids), len(ids2)), bool)
            yield work(part, ids, ids2, keep, [s.block(x, x2).astype(np.int64) for s in scorers])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found = scored({c: batch.column(c)[k].values for c in batch.schema.names})
                yield from fold(found) if fold else found

    return tiles.mapInArrow(run, schema)


def _merged(merge: Callable[[pa.Table], pa.Table]):
    """A fold that merges what the parts give, some at a time."""

    def fold(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = least = 0
        for part in parts:
            held.append(part)
            size += part.num_rows
            if size > GATHERED + 2 * least:
                held = merge(pa.Table.from_batches(held)).combine_chunks().to_batches()
                size = least = sum(b.num_rows for b in held)
        if held:
            yield from merge(pa.Table.from_batches(held)).combine_chunks().to_batches()

    return fold


def _grouped(by: list[str], **how: str):
    """A fold by the columns `by`; how: of each other column, its aggregate."""
    names = [*by, *how]

    def merge(table: pa.Table) -> pa.Table:
        found = table.group_by(by).aggregate([(c, f) for c, f in how.items()])
        return found.select([*by, *(f"{c}_{f}" for c, f in how.items())]).rename_columns(names).cast(pa.schema([table.schema.field(c) for c in names]))

    return _merged(merge)


def _tile_scores(tiles: DataFrame, scorers: list[Scorer], triangle: bool, attributes: tuple[str, ...], kinds: dict[str, str], least: dict[str, int] | None = None) -> DataFrame:
    names = ["i", "j", *(s.name for s in scorers), *(f"{c}_{end}" for c in attributes for end in "ij")]

    def work(tile, ids, ids2, keep, scores) -> pa.RecordBatch:
        for s, x in zip(scorers, scores):
            keep = keep & (x >= (least or {}).get(s.name, np.iinfo(np.int64).min))
        i, j = np.nonzero(keep)
        ends = [tile[f"a_{c}{two}"].take(pa.array(at)) for c in attributes for two, at in (("", i), ("2", j))]
        return pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids2[j]), *(pa.array(s[keep]) for s in scores), *ends], names)

    schema = ["i long", "j long", *(f"`{s.name}` long" for s in scorers), *(f"`{c}_{end}` {kinds[c]}" for c in attributes for end in "ij")]
    return _per_tile(tiles, scorers, triangle, work, ", ".join(schema))


def all_pairs(index: DataFrame, scorers: list[Scorer], features: str = "q", tile_rows: int = TILE_ROWS, attributes: tuple[str, ...] = (), least: dict[str, int] | None = None) -> DataFrame:
    """Every unordered pair once: i < j, a column for each (symmetric) scorer, and name_i and name_j of the attributes.

    least: scores below these keep a pair in its tile.
    """
    blocks = _even_blocks(index, features, tile_rows, attributes)
    return _tile_scores(_meet(blocks, blocks, True), scorers, True, attributes, dict(index.dtypes), least)


def rectangle(probes: DataFrame, gallery: DataFrame, scorers: list[Scorer], features: str = "q", tile_rows: int = TILE_ROWS, attributes: tuple[str, ...] = ()) -> DataFrame:
    """Every probe (i) with every gallery item (j). The same table twice gives all directed pairs, the diagonal too."""
    sides = [_even_blocks(df, features, tile_rows, attributes) for df in (probes, gallery)]
    return _tile_scores(_meet(*sides, False), scorers, False, attributes, dict(probes.dtypes))


def _classes(tile: dict, classes: PairClass) -> np.ndarray:
    a, b = ({c: np.asarray(tile[f"a_{c}{two}"].to_numpy(zero_copy_only=False)) for c in classes.attributes} for two in ("", "2"))
    return np.broadcast_to(classes.block(a, b), (len(tile["ids"]), len(tile["ids2"])))


def _tiles(index: DataFrame, against: DataFrame | None, features: str, tile_rows: int, attributes: tuple[str, ...]) -> DataFrame:
    """Tiles of all unordered pairs of an index, or of all its pairs with the items of another one."""
    blocks = _even_blocks(index, features, tile_rows, attributes)
    return _meet(blocks, blocks, True) if against is None else _meet(blocks, _even_blocks(against, features, tile_rows, attributes), False)


def class_histogram(index: DataFrame, scorers: list[Scorer], classes: PairClass, features: str = "q", tile_rows: int = TILE_ROWS, against: DataFrame | None = None) -> DataFrame:
    """pair_class, a column for each scorer, n: how many unordered pairs have these scores. Tiles count their own pairs.

    against: other items, each of which makes a pair with each item of the index; the index then makes none within itself.
    """
    tiles = _tiles(index, against, features, tile_rows, classes.attributes)
    names = [s.name for s in scorers]

    def work(tile, ids, ids2, keep, scores) -> pa.RecordBatch:
        whole = keep.all()
        found, counts = _counts([c.reshape(-1) if whole else c[keep] for c in (_classes(tile, classes), *scores)])
        return pa.RecordBatch.from_arrays([pa.array(np.array(classes.names)[found[0]], pa.string()), *map(pa.array, found[1:]), pa.array(counts)], ["pair_class", *names, "n"])

    schema = "pair_class string, " + ", ".join(f"`{n}` long" for n in names) + ", n long"
    fold = _grouped(["pair_class", *names], n="sum")
    return _per_tile(tiles, scorers, against is None, work, schema, fold=fold).groupBy("pair_class", *names).agg(F.sum("n").alias("n"))


def _counts(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The different rows of whole-number columns, and how often each occurs."""
    columns = [c.astype(np.int64, copy=False) for c in columns]
    if not len(columns[0]):
        return columns, np.zeros(0, np.int64)
    low = [int(c.min()) for c in columns]
    span = [int(c.max()) - x + 1 for c, x in zip(columns, low)]
    cells = float(np.prod(np.array(span, float)))
    if cells >= 2**62:
        found, counts = np.unique(np.column_stack(columns), axis=0, return_counts=True)
        return list(found.T), counts
    codes = columns[0] - low[0]
    for c, x, n in zip(columns[1:], low[1:], span[1:]):
        codes *= n
        codes += c
        codes -= x
    if cells <= 4 * len(codes) + 1024:
        counts = np.bincount(codes)
        codes = np.flatnonzero(counts)
        counts = counts[codes]
    else:
        codes, counts = np.unique(codes, return_counts=True)
    return [c + x for c, x in zip(np.unravel_index(codes, span), low)], counts


def _best_of_tiles(tiles: DataFrame, scorers: list[Scorer], k: int, classes: PairClass, wanted: str, triangle: bool, reached: list[float] | None = None) -> DataFrame:
    """i, j and all scores of the pairs of the wanted class that are among the k best of their tile by any of the scorers.

    reached: for each scorer, a score that the k best of all reach; parts that cannot hold it are not scored.
    """
    names, code = [s.name for s in scorers], classes.names.index(wanted)
    #: The k-th score of what a tile has gathered; what is below it is no longer among its best.
    least: dict[str, int] = {}

    def work(tile, ids, ids2, keep, scores) -> pa.RecordBatch:
        reach = np.zeros_like(keep)
        for n, s in zip(names, scores):
            reach |= s >= least.get(n, np.iinfo(np.int64).min)
        i, j = np.divmod(np.flatnonzero(reach & keep & (_classes(tile, classes) == code)), max(1, len(ids2)))
        return best(ids[i], ids2[j], [s[i, j] for s in scores])

    def best(i: np.ndarray, j: np.ndarray, own: list[np.ndarray]) -> pa.RecordBatch:
        at = np.unique(np.concatenate([_best(s, i, j, k) for s in own]))
        return pa.RecordBatch.from_arrays([pa.array(i[at]), pa.array(j[at]), *(pa.array(s[at]) for s in own)], ["i", "j", *names])

    def merge(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        i, j, *own = (np.concatenate([np.asarray(b.column(c)) for b in held]) for c in ("i", "j", *names))
        out = best(i, j, own)
        for n in names:
            s = np.asarray(out.column(n))
            if len(s) >= k > 0:
                least[n] = int(np.partition(s, len(s) - k)[len(s) - k])
        return out

    def fold(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least.clear()
        held: list[pa.RecordBatch] = []
        size = kept = 0
        for part in parts:
            held.append(part)
            size += part.num_rows
            if size - kept >= k:
                held = [merge(held)]
                size = kept = held[0].num_rows
        if held:
            yield merge(held)

    def can(x: np.ndarray, x2: np.ndarray) -> bool:
        ends = (x.min(0), x.max(0), x2.min(0), x2.max(0))
        return any(s.bound is None or s.bound(*ends) >= t for s, t in zip(scorers, reached))

    return _per_tile(tiles, scorers, triangle, work, "i long, j long, " + ", ".join(f"`{n}` long" for n in names), fold=fold, can=can if reached else None)


def best_pairs(index: DataFrame, scorers: list[Scorer], k: int, classes: PairClass, wanted: str, features: str = "q", tile_rows: int = TILE_ROWS, against: DataFrame | None = None) -> DataFrame:
    """i, j and all scores of the pairs of the wanted class that are among the k best of their tile by any of the scorers.

    The k best of all by any scorer are among them; ties go to the lesser i, then j. against: as in class_histogram; i is of the index.
    """
    return _best_of_tiles(_tiles(index, against, features, tile_rows, classes.attributes), scorers, k, classes, wanted, against is None)


def promising_tiles(blocks: DataFrame, scorers: list[Scorer], least: list[float]) -> DataFrame:
    """p <= q, of the pairs of blocks that can hold a score of at least `least` by one of the scorers.

    Of a block only the least and the greatest value of each feature come together with those of others.
    """

    def envelope(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x = np.asarray(batch.column("x")[k].values).reshape(len(batch.column("ids")[k].values), -1)
                yield pa.RecordBatch.from_arrays([batch.column("block").slice(k, 1), pa.array([x.min(0).tolist()]), pa.array([x.max(0).tolist()])], ["block", "low", "high"])

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                low, high, low2, high2 = (np.array(batch.column(c).to_pylist(), float) for c in ("low", "high", "low2", "high2"))
                keep = np.zeros(batch.num_rows, bool)
                for s, t in zip(scorers, least):
                    keep |= (s.bound(low, high, low2, high2) >= t) if s.bound else True
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("at", "at2")], ["p", "q"])

    small = blocks.select("block", "ids", "x").mapInArrow(envelope, "block int, low array<double>, high array<double>").withColumn("at", F.col("block"))
    return _meet(small, small, True).mapInArrow(reach, "p int, q int")


def best_pairs_pruned(index: DataFrame, scorers: list[Scorer], k: int, classes: PairClass, wanted: str, features: str = "q", tile_rows: int = TILE_ROWS, order: Column | None = None) -> DataFrame:
    """As best_pairs, but only tiles, and parts of tiles, that can hold one of the k best are made.

    Blocks within themselves come first; the k-th score found there is one that the k best of all reach. order: by which
    items are put into blocks, so that items alike lie together; their idx otherwise. What is returned does not hang on it.
    """
    spark = index.sparkSession
    if order is not None:
        placed = numbered(index, [order, F.col("idx")], "_place")
        index = placed.select(*(c for c in index.columns if c != "idx"), F.col("idx").alias("_idx"), F.col("_place").alias("idx"))
    carried = (*classes.attributes, *(("_idx",) if order is not None else ()))
    # No more blocks than other tiles have, so that an item goes to at most MOST_BLOCKS and one more; within a tile its parts are left out.
    blocks = cached(spark, scratch(spark), lambda: _even_blocks(index, features, tile_rows, carried))
    other = blocks.select(F.col("block").alias("q"), *(F.col(c).alias(f"{c}2") for c in blocks.columns if c != "block"))
    own = blocks.withColumnRenamed("block", "p")
    within = _best_of_tiles(own.join(other.withColumnRenamed("q", "p").hint("merge"), "p").drop("p"), scorers, k, classes, wanted, True)
    least = [_kth(within, s.name, k) for s in scorers]
    wanted_tiles = F.broadcast(cached(spark, scratch(spark), lambda: promising_tiles(blocks, scorers, least)))
    # Both sides go to their tile by its key, or a broadcast would leave all tiles to the task that has named them.
    tiles = own.join(wanted_tiles, "p").join(other.join(wanted_tiles, "q").hint("merge"), ["p", "q"]).drop("p", "q")
    found = _best_of_tiles(tiles, scorers, k, classes, wanted, True, least)
    if order is None:
        return found
    names = [index.select(F.col("idx").alias(end), F.col("_idx").alias(f"_{end}")) for end in "ij"]
    both = found.join(names[0], "i").join(names[1], "j")
    return both.select(F.least("_i", "_j").alias("i"), F.greatest("_i", "_j").alias("j"), *(s.name for s in scorers))


def _kth(found: DataFrame, score: str, k: int) -> float:
    """The k-th best score, or one that all reach where there are fewer."""
    top = found.select(score).orderBy(F.desc(score)).limit(k).agg(F.min(score), F.count(F.lit(1))).first()
    return float(top[0]) if top[1] == k else float("-inf")


def _best(score: np.ndarray, i: np.ndarray, j: np.ndarray, k: int) -> np.ndarray:
    """Where the k best are; only what reaches the k-th score is sorted."""
    at = np.arange(len(score))
    if len(score) > k:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return at[np.lexsort((j[at], i[at], -score[at]))[:k]]


def _width(index: DataFrame, features: str) -> tuple[int | None, int | None]:
    """How many features every item has, where it is one number, none is null and they are few enough to be columns.

    And, where all are whole numbers, of how many bits (16 or 32) these are at most.
    """
    element = index.schema[features].dataType
    known = F.size(features) if not element.containsNull else F.when(F.exists(features, lambda x: x.isNull()), -1).otherwise(F.size(features))
    low, high, least, most = index.agg(F.min(F.coalesce(known, F.lit(-1))), F.max(F.coalesce(known, F.lit(-1))), F.min(F.array_min(features)), F.max(F.array_max(features))).first()
    if low is None or not 0 < low == high <= MOST_COLUMNS:
        return None, None
    fits = [bits for bits in (16, 32) if -(1 << bits - 1) <= least and most < 1 << bits - 1] if element.elementType.simpleString() in ("tinyint", "smallint", "int", "bigint") else []
    return low, fits[0] if fits else None


def _packed_words(features: str, width: int, bits: int, name: str) -> list[Column]:
    """Features as columns of 64 bits with several each, none of which may be null."""
    each, mask = 64 // bits, F.lit((1 << bits) - 1).cast("long")
    at = lambda k: F.shiftleft(F.coalesce(F.col(features)[k].cast("long"), F.lit(0).cast("long")).bitwiseAND(mask), bits * (k % each))
    return [reduce(Column.bitwiseOR, [at(k) for k in range(w, min(w + each, width))]).alias(f"{name}{w // each}") for w in range(0, width, each)]


def _unpacked(width: int, bits: int, name: str) -> list[Column]:
    """The features again. Sums of products of 16 bits are exact as doubles, which take less code than whole numbers that are watched for overflow."""
    each = 64 // bits
    found = []
    for k in range(width):
        word, left = F.col(f"{name}{k // each}"), 64 - bits * (k % each + 1)
        found.append(F.shiftright(F.shiftleft(word, left) if left else word, 64 - bits))
    return [f.cast("double") for f in found] if bits == 16 else found


def all_pairs_native(index: DataFrame, scorers: list[Scorer], features: str = "q", tile_rows: int = 64) -> DataFrame:
    """all_pairs without Python, for scorers that have only a Column.

    Where all of them have terms and items have features of one number, features are columns, and scores are compiled; functions of
    arrays are interpreted, element by element. Whole numbers travel several to a column, as Spark compiles no join of more than
    COMPILED_COLUMNS, whose columns are then copied for every pair.
    """
    first, size, last = _extent(index, tile_rows)
    width, bits = _width(index, features) if all(s.terms for s in scorers) else (None, None)
    words = -(-width * bits // 64) if bits else 0
    # One side as it is, where there is place, so that less is unpacked for every pair.
    plain = bool(bits) and width + words + 6 <= COMPILED_COLUMNS
    kind = "double" if bits == 16 else "long"

    def held(end: str) -> list[Column]:
        if bits and not (plain and end == "xa"):
            return _packed_words(features, width, bits, end)
        if plain:
            return [F.coalesce(F.col(features)[k].cast(kind), F.lit(0).cast(kind)).alias(f"{end}{k}") for k in range(width)]
        return [F.col(features)[k].alias(f"{end}{k}") for k in range(width)] if width else [F.col(features).alias(end)]

    block = F.floor((F.col("idx") - first) / size).cast("int")
    a = index.select(F.col("idx").alias("i"), *held("xa"), block.alias("p")).select("*", F.explode(F.sequence(F.col("p"), F.lit(last))).alias("q"))
    b = index.select(F.col("idx").alias("j"), *held("xb"), block.alias("q")).select("*", F.explode(F.sequence(F.lit(0), F.col("q"))).alias("p"))
    pairs = a.join(b.hint("merge"), ["p", "q"]).where("i < j")
    if width:
        ends = [_unpacked(width, bits, end) if bits and not (plain and end == "xa") else [F.col(f"{end}{k}") for k in range(width)] for end in ("xa", "xb")]
        return pairs.select("i", "j", *(s.terms(*ends).alias(s.name) for s in scorers))
    return pairs.select("i", "j", *(s.column(F.col("xa"), F.col("xb")).alias(s.name) for s in scorers))


def with_attributes(edges: DataFrame, index: DataFrame, columns: list[str]) -> DataFrame:
    """edges with the index columns of both ends, as name_i and name_j."""
    for end in ("i", "j"):
        side = index.select(F.col("idx").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in columns))
        edges = edges.join(side, end)
    return edges


def two_way_class(source: str = "source", item: str = "finger_id") -> Column:
    """genuine: same source and same item; impostor otherwise."""
    same = (F.col(f"{source}_i") == F.col(f"{source}_j")) & (F.col(f"{item}_i") == F.col(f"{item}_j"))
    return F.when(same, "genuine").otherwise("impostor")


def three_way_class(source: str = "source", item: str = "finger_id") -> Column:
    """artefact: the same item number in different sources, which a two-way class counts as impostor."""
    same_item, same_source = F.col(f"{item}_i") == F.col(f"{item}_j"), F.col(f"{source}_i") == F.col(f"{source}_j")
    return F.when(same_item & same_source, "genuine").when(same_item, "artefact").otherwise("impostor")


#: The classes above, for tiles.
TWO_WAY = PairClass(("source", "finger_id"), ("impostor", "genuine"), two_way_class, lambda a, b: (_equal(a, b, "source") & _equal(a, b, "finger_id")).astype(int))
THREE_WAY = PairClass(("source", "finger_id"), ("impostor", "artefact", "genuine"), three_way_class, lambda a, b: _equal(a, b, "finger_id") * (1 + _equal(a, b, "source")))
SAME_PERSON = PairClass(("person",), ("different", "same"), lambda: F.when(F.col("person_i") == F.col("person_j"), "same").otherwise("different"), lambda a, b: _equal(a, b, "person").astype(int))


EVERY = PairClass((), ("every",), lambda: F.lit("every"), lambda a, b: np.zeros((1, 1), int))


def apart(classes: PairClass, attribute: str) -> PairClass:
    """The same classes, and each once more as excluded_NAME for pairs an end of which has the (boolean) attribute."""
    size, held = len(classes.names), lambda v: np.asarray(v).astype(bool)
    column = lambda: F.concat(F.when(F.col(f"{attribute}_i") | F.col(f"{attribute}_j"), "excluded_").otherwise(""), classes.column())
    block = lambda a, b: classes.block(a, b) + size * (held(a[attribute])[:, None] | held(b[attribute])[None, :])
    return PairClass((*classes.attributes, attribute), (*classes.names, *(f"excluded_{n}" for n in classes.names)), column, block)


def _bodies(a: dict, b: dict) -> np.ndarray:
    return _equal(a, b, "person") * (1 + (_equal(a, b, "finger") & ~_equal(a, b, "hand")))


#: Pairs by person, and of one person by finger and hand.
BODIES = PairClass(
    ("person", "hand", "finger"),
    ("different_bodies", "same_body_other", "same_body_homologous"),
    lambda: F.when(F.col("person_i") != F.col("person_j"), "different_bodies").when((F.col("finger_i") == F.col("finger_j")) & (F.col("hand_i") != F.col("hand_j")), "same_body_homologous").otherwise("same_body_other"),
    _bodies,
)


def unordered(a: str, b: str) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def symmetrised(directed: DataFrame, score: str = "score") -> DataFrame:
    """The greater score of both directions, one row per unordered pair; the diagonal is dropped."""
    low, high = unordered("i", "j")
    return directed.where("i <> j").groupBy(low.alias("i"), high.alias("j")).agg(F.max(score).alias(score))


def item_blocks(edges: DataFrame, key: str = "key") -> DataFrame:
    """edges with key_a < key_b, the ordered keys of both ends; pairs within one key are dropped."""
    low, high = unordered(f"{key}_i", f"{key}_j")
    return edges.withColumns({"key_a": low, "key_b": high}).where("key_a <> key_b")


def named_pairs(items_a: DataFrame, items_b: DataFrame, scorers: list[Scorer], least: dict[str, int], features: str = "q") -> DataFrame:
    """All pairs of two named sets as i < j with their scores, null where one is below its least. Only these sets are scored."""
    found = rectangle(items_a, items_b, scorers, features)
    ends = [c.alias(n) for c, n in zip(unordered("i", "j"), ("i", "j"))]
    known = F.lit(True)
    for name, score in least.items():
        known = known & (F.col(name) >= score)
    return found.select(*ends, *(F.when(known, F.col(s.name)).alias(s.name) for s in scorers))


def listed_pairs(listed: DataFrame, index: DataFrame, scorers: list[Scorer], features: str = "q", tile_rows: int = TILE_ROWS) -> DataFrame:
    """listed (i, j and whatever else) with the scores of its pairs, however often a pair is listed.

    Features come once to each tile that has a listed pair; no other tile is made.
    """
    own = [c for c in listed.columns if c not in ("i", "j")]
    block = lambda c: F.floor(F.col(c) / tile_rows).cast("int")
    wanted = listed.select(block("i").alias("p"), block("j").alias("q"), F.struct("i", "j").alias("ij")).distinct()
    wanted = wanted.groupBy("p", "q").agg(F.sort_array(F.collect_list("ij")).alias("wanted"))
    sides = [_blocks(index, features, tile_rows).select(F.col("block").alias(at), *(F.col(c).alias(c + two) for c in ("ids", "x"))) for at, two in (("p", ""), ("q", "2"))]
    tiles = wanted.join(sides[0], "p").join(sides[1], "q").select(F.col("wanted.i").alias("wi"), F.col("wanted.j").alias("wj"), "ids", "x", "ids2", "x2")

    def work(tile, ids, ids2, keep, scores) -> pa.RecordBatch:
        i, j = (np.asarray(tile[c]) for c in ("wi", "wj"))
        rows, columns = ({v: k for k, v in enumerate(x.tolist())} for x in (ids, ids2))
        known = np.array([a in rows and b in columns for a, b in zip(i.tolist(), j.tolist())], bool)
        i, j = i[known], j[known]
        at = [rows[a] for a in i.tolist()], [columns[b] for b in j.tolist()]
        return pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), *(pa.array(s[at]) for s in scores)], ["i", "j", *(s.name for s in scorers)])

    scored = _per_tile(tiles, scorers, False, work, "i long, j long, " + ", ".join(f"`{s.name}` long" for s in scorers), None)
    return listed.join(scored, ["i", "j"]).select("i", "j", *own, *(s.name for s in scorers))


def listed_totals(listed: DataFrame, index: DataFrame, scorer: Scorer, by: str, features: str = "q", tile_rows: int = TILE_ROWS) -> DataFrame:
    """by (a whole number), total: the sum of the scores of the listed pairs (i, j), however often a pair is listed.

    There are no more blocks than other tiles have, so features move at most so often, however the list is spread; a tile gives its own
    sums, and a listed pair moves once, to its tile. A pair that has no items counts for nothing.
    """
    first, rows, last = _extent(index, tile_rows)
    place = lambda c: F.floor((F.col(c) - first) / rows).cast("int")
    # A tile's list comes in rows of its own, by ranges of `by`, so that no row has to hold a long list.
    wanted = listed.select(place("i").alias("p"), place("j").alias("q"), F.floor(F.col(by) / LISTED_TOGETHER).cast("int").alias("part"), F.struct(F.col(by).cast("int").alias("k"), (F.col("i") - first - rows * place("i")).cast("int").alias("i"), (F.col("j") - first - rows * place("j")).cast("int").alias("j")).alias("w"))
    wanted = wanted.groupBy("p", "q", "part").agg(F.collect_list("w").alias("w")).groupBy("p", "q").agg(F.collect_list("w").alias("w")).select("p", "q", F.flatten("w").alias("w")).select("p", "q", *(F.col(f"w.{c}").alias(f"w{c}") for c in "kij"))
    sides = [_blocks(index, features, rows, first=first).select(F.col("block").alias(at), *(F.col(c).alias(c + two) for c in ("ids", "x"))) for at, two in (("p", ""), ("q", "2"))]
    tiles = wanted.join(sides[0].hint("merge"), "p").join(sides[1].hint("merge"), "q").select("p", "q", "wk", "wi", "wj", "ids", "x", "ids2", "x2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                tile = {c: batch.column(c)[at].as_py() if c in ("p", "q") else np.asarray(batch.column(c)[at].values) for c in batch.schema.names}
                x, places = [], []
                for block, two in (("p", ""), ("q", "2")):
                    ids = tile[f"ids{two}"]
                    x.append(tile[f"x{two}"].reshape(len(ids), -1))
                    places.append(np.full(rows, -1))
                    places[-1][ids - first - rows * tile[block]] = np.arange(len(ids))
                k, i, j = tile["wk"], places[0][tile["wi"]], places[1][tile["wj"]]
                known = (i >= 0) & (j >= 0)
                k, i, j = k[known], i[known], j[known]
                kinds, code = np.unique(k, return_inverse=True)
                totals = np.zeros(len(kinds), np.int64)
                for a in range(0, len(k), LISTED_ROWS):
                    own = slice(a, a + LISTED_ROWS)
                    np.add.at(totals, code[own], scorer.rows(x[0][i[own]], x[1][j[own]]).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(totals)], [by, "total"])

    return tiles.mapInArrow(run, f"`{by}` int, total long").groupBy(by).agg(F.sum("total").alias("total"))


def per_probe(index: DataFrame, scorer: Scorer, features: str = "q", tile_rows: int = TILE_ROWS) -> DataFrame:
    """i, n, low, high, best: of each item's scores with all others their number, least and greatest, and the least item with the greatest.

    The scorer is symmetric; a tile serves the items of both its blocks, and gives one row for each.
    """
    name = scorer.name

    def work(tile, ids, ids2, keep, scores) -> pa.RecordBatch:
        # Where a block meets itself in one order, one turn has all of its pairs.
        both = keep | keep.T if np.array_equal(ids, ids2) else keep
        turns = [(ids, ids2, both, scores[0])] + ([] if both is not keep else [(ids2, ids, keep.T, scores[0].T)])
        out: list[list[np.ndarray]] = [[] for _ in range(5)]
        for own, others, kept, s in turns:
            order = np.argsort(others, kind="stable")
            kept, s, others = kept[:, order], s[:, order], others[order]
            some = kept.any(1)
            kept, s = kept[some], s[some]
            if len(s):
                high = np.where(kept, s, np.iinfo(np.int64).min)
                at = high.argmax(1)
                for column, x in zip(out, (own[some], kept.sum(1), np.where(kept, s, np.iinfo(np.int64).max).min(1), high.max(1), others[at])):
                    column.append(x)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in out], ["i", "n", "low", "high", "best"])

    def merge(table: pa.Table) -> pa.Table:
        i, n, low, high, best = (np.asarray(table.column(c)) for c in table.column_names)
        order = np.lexsort((best, -high, i))
        first = np.flatnonzero(np.append(True, np.diff(i[order]) != 0)) if len(i) else np.zeros(0, int)
        own = order[first]
        sums = (np.add.reduceat(n[order], first), np.minimum.reduceat(low[order], first)) if len(i) else (n, low)
        return pa.table([i[own], *sums, high[own], best[own]], names=table.column_names)

    blocks = _even_blocks(index, features, tile_rows)
    rows = _per_tile(_meet(blocks, blocks, True), [scorer], True, work, "i long, n long, low long, high long, best long", fold=_merged(merge))
    best = F.max(F.struct("high", -F.col("best"))).alias("m")
    return rows.groupBy("i").agg(F.sum("n").alias("n"), F.min("low").alias("low"), best).select("i", "n", "low", F.col("m.high").alias("high"), (-F.col("m.col2")).alias("best"))


def best_of_samples(index: DataFrame, scorer: Scorer, key: str, places: str, sizes: list[int], features: str = "q", tile_rows: int = TILE_ROWS) -> DataFrame:
    """k, rep, top: the greatest score of two items of different keys, both of which are among the first k of a sample.

    places: of an item, the place from 1 of its key in each sample, 0 where it is in none.
    """
    def work(tile, ids, ids2, keep, scores) -> pa.RecordBatch:
        a, b = (np.array(tile[f"a_{places}{two}"].to_pylist()) for two in ("", "2"))
        keys = [np.asarray(tile[f"a_{key}{two}"].to_numpy(zero_copy_only=False)) for two in ("", "2")]
        keep = keep & (keys[0][:, None] != keys[1][None, :])
        rows = []
        for rep in range(a.shape[1] if a.ndim == 2 else 0):
            x, y = np.flatnonzero(a[:, rep]), np.flatnonzero(b[:, rep])
            if len(x) and len(y):
                last = np.maximum(a[x, rep][:, None], b[y, rep][None, :])
                own, s = keep[np.ix_(x, y)], scores[0][np.ix_(x, y)]
                for k in sizes:
                    hit = own & (last <= k)
                    if hit.any():
                        rows.append((k, rep, int(s[hit].max())))
        columns = list(zip(*rows)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64()))], ["k", "rep", "top"])

    blocks = _even_blocks(index, features, tile_rows, (key, places))
    fold = _grouped(["k", "rep"], top="max")
    return _per_tile(_meet(blocks, blocks, True), [scorer], True, work, "k int, rep int, top long", fold=fold).groupBy("k", "rep").agg(F.max("top").alias("top"))
