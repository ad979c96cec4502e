"""Pairs of items of several rows each: tiles that hold whole items, so that what two items have in common is exact in one tile.

Rows are put into blocks by a hash of their item, so all rows of two items meet in one tile, which gives one row for them. An
item with more rows than `item_rows` is cut into pieces; its pairs give counts of scores, which are then merged. Blocks are at most
`pairs.MOST_BLOCKS`. A tile counts its scores part by part and never sorts its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators import pairs
from pairloom.operators.pairs import PairClass
from pairloom.operators.scorers import Scorer
from pairloom.sources.files import cached
from pairloom.sources.scratch import scratch

ITEM_ROWS = 1024


def _pieces(index: DataFrame, key: str, item_rows: int) -> DataFrame:
    return index.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / item_rows).cast("int").alias("_pieces"))


def _item_blocks(index: DataFrame, key: str, features: str, tile_rows: int, item_rows: int, attributes: tuple[str, ...]) -> DataFrame:
    """block, ids, x, and by row: key, whether its item is whole, and the attributes."""
    sizes = _pieces(index, key, item_rows)
    # The size of all, for the number of blocks, is one number.
    total = index.count()
    rows = index.join(sizes, key).withColumn("_piece", F.pmod(F.xxhash64("idx"), F.col("_pieces")))
    block = F.pmod(F.xxhash64(key, F.when(F.col("_pieces") > 1, F.col("_piece"))), F.lit(max(1, min(pairs.MOST_BLOCKS, -(-total // tile_rows))))).cast("int").alias("block")
    row = F.struct("idx", F.col(features).cast("array<double>").alias("x"), F.col(key).cast("string").alias("key"), (F.col("_pieces") == 1).alias("whole"), *(F.col(c).alias(f"v_{c}") for c in attributes))
    grouped = rows.groupBy(block).agg(F.sort_array(F.collect_list(row)).alias("r"))
    column = lambda c: F.transform("r", lambda r: r[c])
    return grouped.select("block", column("idx").alias("ids"), F.flatten(column("x")).alias("x"), column("key").alias("a_key"), column("whole").alias("a_whole"), *(column(f"v_{c}").alias(f"a_{c}") for c in attributes))


def _segments(columns: list[np.ndarray]) -> np.ndarray:
    """First place of each run of equal rows of sorted columns."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _summed(held: list[tuple[list[np.ndarray], np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """group, score, n of several counts of (group, score), sorted, each pair once."""
    group, score, n = (np.concatenate(c) for c in zip(*((g, x, n) for (g, x), n in held)))
    order = np.lexsort((score, group))
    group, score, n = group[order], score[order], n[order]
    first = _segments([group, score])
    return group[first], score[first], np.add.reduceat(n, first) if len(n) else n


def _of_counts(group: np.ndarray, score: np.ndarray, n: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First row, number, median and number of at least `least`, of each group of sorted counts."""
    first = _segments([group])
    upto = np.cumsum(n)
    total = np.add.reduceat(n, first) if len(n) else n
    before = upto[first] - n[first]
    middle = (score[np.searchsorted(upto, before + (total - 1) // 2, "right")] + score[np.searchsorted(upto, before + total // 2, "right")]) / 2 if len(n) else np.zeros(0)
    reached = np.add.reduceat(np.where(score >= least, n, 0), first) if len(n) else n
    return first, total, middle, reached


def item_pairs(index: DataFrame, scorers: list[Scorer], classes: PairClass, least: dict[str, int], peak: dict[str, int] | None = None, key: str = "key", features: str = "q", tile_rows: int = pairs.TILE_ROWS, item_rows: int = ITEM_ROWS) -> DataFrame:
    """key_a < key_b, pair_class, n, of each scorer median_NAME and reached_NAME, and peak.

    reached: how many pairs score at least what `least` says. peak: the greatest sum of scores by the weights of `peak`, with i and j; ties to the greater.
    """
    names = [s.name for s in scorers]
    blocks = _item_blocks(index, key, features, tile_rows, item_rows, classes.attributes)
    counts = "array<struct<score:bigint,n:bigint>>"
    schema = "key_a string, key_b string, pair_class string, n long, top struct<sum:bigint,i:bigint,j:bigint>, whole boolean, " + ", ".join(f"`median_{n}` double, `reached_{n}` long, `counts_{n}` {counts}" for n in names)

    shape = ["key_a", "key_b", "pair_class", "n", "top", "whole", *(f"{x}_{n}" for n in names for x in ("median", "reached", "counts"))]
    score_kind = pa.struct([("score", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                yield from of_tile({c: batch.column(c)[k].values for c in batch.schema.names})

    def of_tile(tile: dict):
        sides = []
        for two in ("", "2"):
            key, ids = np.array(tile[f"a_key{two}"].to_pylist(), object).astype(str), np.asarray(tile[f"ids{two}"])
            sides.append((key, ids, np.asarray(tile[f"x{two}"]).reshape(len(ids), -1), np.asarray(tile[f"a_whole{two}"].to_numpy(zero_copy_only=False)).astype(bool)))
        # A block meets itself once; two blocks meet in one order only.
        same = np.array_equal(np.sort(sides[0][1]), np.sort(sides[1][1]))
        keys, code = np.unique(np.concatenate([s[0] for s in sides]), return_inverse=True)
        whole = np.zeros(len(keys), bool)
        whole[code] = np.concatenate([s[3] for s in sides])
        # Rows of an item lie together, so that a part has few items.
        orders = [np.lexsort((s[1], c)) for s, c in zip(sides, (code[: len(sides[0][0])], code[len(sides[0][0]) :]))]
        code = [code[: len(sides[0][0])][orders[0]], code[len(sides[0][0]) :][orders[1]]]
        ids, x = ([s[at][o] for s, o in zip(sides, orders)] for at in (1, 2))
        attributes = [{c: tile[f"a_{c}{two}"].take(pa.array(o)) for c in classes.attributes} for two, o in zip(("", "2"), orders)]
        held: list[list] = [[] for _ in names]
        tops: list[tuple] = []
        size = 0
        for a in range(0, len(ids[0]), pairs.PART_ROWS):
            for b in range(0, len(ids[1]), pairs.PART_ROWS):
                at = [slice(a, a + pairs.PART_ROWS), slice(b, b + pairs.PART_ROWS)]
                ca, cb = (c[s] for c, s in zip(code, at))
                keep = ca[:, None] != cb[None, :]
                if same:
                    keep &= ids[0][at[0]][:, None] < ids[1][at[1]][None, :]
                if not keep.any():
                    continue
                part = {"ids": ids[0][at[0]], "ids2": ids[1][at[1]]} | {f"a_{c}{two}": v.slice(s.start, pairs.PART_ROWS) for own, two, s in zip(attributes, ("", "2"), at) for c, v in own.items()}
                # Groups by the few items of the part, then by those of the tile.
                few, local = np.unique(np.concatenate([ca, cb]), return_inverse=True)
                la, lb = local[: len(ca)][:, None], local[len(ca) :][None, :]
                group = ((np.minimum(la, lb) * len(few) + np.maximum(la, lb)) * len(classes.names) + pairs._classes(part, classes))[keep]
                scores = [s.block(x[0][at[0]], x[1][at[1]]).astype(np.int64) for s in scorers]

                def named(g: np.ndarray) -> np.ndarray:
                    rest, kind = np.divmod(g, len(classes.names))
                    return (few[rest // len(few)] * len(keys) + few[rest % len(few)]) * len(classes.names) + kind

                for h, s in zip(held, scores):
                    (g, v), n = pairs._counts([group, s[keep]])
                    h.append(([named(g), v], n))
                    size += len(n)
                if peak:
                    weighed = sum(scores[names.index(c)] * w for c, w in peak.items())[keep]
                    greatest = np.full(int(group.max()) + 1, np.iinfo(np.int64).min)
                    np.maximum.at(greatest, group, weighed)
                    best = np.flatnonzero(weighed == greatest[group])
                    i, j = np.divmod(np.flatnonzero(keep)[best], len(cb))
                    tops.append(lasts(named(group[best]), weighed[best], part["ids"][i], part["ids2"][j]))
                if size > 20 * pairs.GATHERED:
                    held = [[((g, v), n)] for g, v, n in map(_summed, held)]
                    size = sum(len(h[0][1]) for h in held)
        if held[0]:
            yield rows_of(keys, whole, list(map(_summed, held)), tops)

    def lasts(group, weighed, i, j) -> tuple:
        """The greatest of each group, by group; ties to the greater i, then j."""
        low, high = np.minimum(i, j), np.maximum(i, j)
        order = np.lexsort((high, low, weighed, group))
        group, weighed, low, high = (c[order] for c in (group, weighed, low, high))
        end = np.append(_segments([group])[1:], len(group)) - 1
        return group[end], weighed[end], low[end], high[end]

    def rows_of(keys: np.ndarray, whole: np.ndarray, counts: list[tuple], tops: list[tuple]) -> pa.RecordBatch:
        found = [_of_counts(*c, least.get(name, 0)) for name, c in zip(names, counts)]
        group = counts[0][0][found[0][0]]
        rest, kind = np.divmod(group, len(classes.names))
        low, high = rest // len(keys), rest % len(keys)
        done = whole[low] & whole[high]
        columns = [pa.array(keys[low], pa.string()), pa.array(keys[high], pa.string()), pa.array(np.array(classes.names, object)[kind], pa.string()), pa.array(found[0][1])]
        best = lasts(*(np.concatenate(c) for c in zip(*tops)))[1:] if tops else [np.zeros(len(group), np.int64)] * 3
        columns.append(pa.StructArray.from_arrays([pa.array(c.astype(np.int64)) for c in best], names=["sum", "i", "j"]))
        columns.append(pa.array(done))
        for (g, score, n), (first, _, middle, reached) in zip(counts, found):
            # Items that are cut give their counts.
            sizes = np.diff(np.append(first, len(g)))
            given = np.repeat(~done, sizes)
            ends = np.append(0, np.cumsum(np.where(done, 0, sizes)))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(score[given]), pa.array(n[given])], fields=list(score_kind)))
            columns += [pa.array(middle.astype(float)), pa.array(reached), lists]
        return pa.RecordBatch.from_arrays(columns, shape)

    rows = pairs._meet(blocks, blocks, True).mapInArrow(run, schema)
    by = ["key_a", "key_b", "pair_class"]
    shown = [*by, "n", F.col("top").alias("peak"), *(f"{x}_{n}" for n in names for x in ("median", "reached"))]
    if _pieces(index, key, item_rows).where("_pieces > 1").isEmpty():
        return rows.select(*shown)
    # Read several times, and made once.
    spark, made = index.sparkSession, rows
    rows = cached(spark, scratch(spark), lambda: made)
    cut = rows.where("NOT whole")
    merged = cut.groupBy(*by).agg(F.sum("n").alias("n"), F.max("top").alias("peak"), *(F.sum(f"reached_{n}").alias(f"reached_{n}") for n in names))
    for n in names:
        each = cut.select(*by, F.explode(f"counts_{n}").alias("c"))
        merged = merged.join(each.groupBy(*by).agg(F.percentile("c.score", F.lit(0.5), F.col("c.n")).alias(f"median_{n}")), by)
    return rows.where("whole").select(*shown).unionByName(merged.select(*by, "n", "peak", *(f"{x}_{n}" for n in names for x in ("median", "reached"))))
