"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame
operations only.

Targets. Sources in code point order (null last) weigh 5, 2, 1, 5, 2, 1, ... and share the total
size. A target stops at `cap` times its source's size and the excess is shared again by weight. That
is min(cap * size, level * weight), and the level is found in one pass over the sources ordered by
cap * size / weight.

Blocks. A keyed hash of its id and text gives each document a place in [0, 1) and cuts its source into
blocks, about `blocks` in all whatever the size of the input (a source has at least 16, or its equal
share of `blocks` where there are very many sources, and one in any case). A source takes whole laps over its blocks, then the
first blocks of one more lap, the last of them as far as its documents fit, and up to three
documents more that fill what is then missing. Each (block, lap) taken, whole or in part, is a draw,
and the draws of a source are its exact quota.

Tree. The root holds every source's quota. A node deals its draws, in a random order, half to each
child; the counts per source of such a half are a multivariate-hypergeometric draw. After log2(shards)
levels each leaf knows how many draws of each source it gets, and takes that many next ones of the
source's permuted draws, so leaves are disjoint and together complete. What the mix takes is what the leaves
hand out. Within a shard rows have a random order of their own; `shuffled` brings them into it.

Planning shuffles sizes, sources and ids, never texts. The plan has at most about 2 * `blocks` rows
and one for each source; it grows with the number of sources and not with their size. It is broadcast
if its counted rows are few, and joined by (source, block) if not.

Defined cases: null text has size 0; documents of size 0 are taken with their block but add no
words; a null source is a source of its own, ordered last; rows equal in id and text are taken
together; all choices hang on hashes of ids and the seed, so reruns
agree; an empty table gives an empty result; further columns pass through `mix` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.common import file_bytes, partitions_for, staged, word_count

WEIGHTS = (5, 2, 1)
#: Most rows of a table of the plan that are broadcast; a row has about 100 bytes.
BROADCAST_ROWS = 50_000
PLACES = 1 << 53


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _place(seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(PLACES)) / F.lit(float(PLACES))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = 3) -> DataFrame:
    """source, source_size, weight, target from one row per source with source and source_size."""
    by_name, everything = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy(F.lit(0))
    turn = (F.row_number().over(by_name) - 1) % len(weights) + 1
    df = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn).cast("double"))
    df = df.withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    before = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns(
        {
            "level": (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
            / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        }
    )
    # The first source, in this order, that the level does not lift above its limit fixes the level.
    fits = F.when(F.col("level") * F.col("weight") <= F.col("limit") * (1 + 1e-12), F.struct(F.col("limit") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("level").alias("level")))
    df = df.withColumn("level", F.min(fits).over(everything)["level"])
    return df.select("source", "source_size", "weight", F.least(F.col("limit"), F.col("level") * F.col("weight")).alias("target"))


def _tree(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """(shard, source, quota) of the leaves; quotas: source, quota."""
    nodes = quotas.select(F.lit(0).cast("long").alias("node"), "source", "quota")
    for level in range(levels):
        units = nodes.select("node", "source", F.explode(F.sequence(F.lit(1).cast("long"), F.col("quota"))).alias("i"))
        chance = F.xxhash64(F.lit(seed), F.lit(level), "node", "source", "i")
        order = Window.partitionBy("node").orderBy(chance, F.col("source"), "i")
        dealt = units.select("node", "source", F.row_number().over(order).alias("r"), F.count(F.lit(1)).over(Window.partitionBy("node")).alias("n"))
        # An odd one goes left or right by chance.
        left = F.floor((F.col("n") + F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "node"), F.lit(2))) / 2)
        nodes = dealt.groupBy((F.col("node") * 2 + (F.col("r") > left).cast("long")).alias("node"), "source").agg(F.count(F.lit(1)).alias("quota"))
    return nodes.withColumnRenamed("node", "shard")


def _units(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _place(seed).alias("__place"))


def _block() -> Column:
    return F.least(F.floor(F.col("__place") * F.col("__blocks")), F.col("__blocks") - 1)


def plan(units: DataFrame, shards: int = 16, blocks: int = 4096, weights: tuple[int, ...] = WEIGHTS, cap: int = 3, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(sources, draws).

    sources: source, source_size, target, __blocks (how many it has). draws: source, block and an array of
    struct(lap, shard, from, upto); the documents of the block with __place in that range are taken.
    shards: a power of two.
    """
    if shards < 1 or shards & (shards - 1):
        raise ValueError("shards has to be a power of two")
    sources = targets(units.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    total = F.sum("source_size").over(Window.partitionBy(F.lit(0)))
    share = F.ceil(F.lit(blocks) * F.col("source_size") / F.greatest(total, F.lit(1)))
    fewest = F.greatest(F.lit(1), F.least(F.lit(16), F.floor(F.lit(blocks) / F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))))).cast("long")
    sources = staged(sources.select("source", "source_size", "target", F.greatest(fewest, share).alias("__blocks")), "sources")
    placed = units.join(_small(sources), units["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    laps = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(cap))).otherwise(0)
    rest = F.when(F.col("laps") < cap, F.col("target") - F.col("laps") * F.col("source_size")).otherwise(0.0)
    sums = placed.groupBy("source", _block().alias("block"), "source_size", "target").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("laps", laps).withColumn("need", rest - F.coalesce(F.sum("words").over(before), F.lit(0)))
    # need: words of the last lap that are still wanted when it comes to this block.
    sums = staged(sums.select("source", "block", "laps", "need", "words", ((F.col("need") > 0) & (F.col("need") < F.col("words"))).alias("cut")), "blocks")

    # In the one block of a source where the last lap ends, documents are taken in their order as long as they fit.
    ends = sums.where("cut").select(F.col("source").alias("s"), F.col("block").alias("b"), F.col("laps").alias("lap"), "need")
    here = F.col("source").eqNullSafe(F.col("s"))
    placed = placed.withColumn("block", _block()).select("doc_id", "source", "size", "__place", "block")
    inside = placed.join(_small(ends), here & (F.col("block") == F.col("b")))
    upto_here = Window.partitionBy("s", "b").orderBy("__place", "doc_id", "size").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    reached = inside.select("s", "b", "lap", "need", "size", "__place", (F.sum("size").over(upto_here) <= F.col("need")).alias("fits"))
    fitting = F.when(F.col("fits"), F.col("size"))
    edges = reached.groupBy("s", "b", "lap", "need").agg(F.max(F.when(F.col("fits"), F.col("__place"))).alias("upto"), (F.first("need") - F.coalesce(F.sum(fitting), F.lit(0))).alias("gap"))
    edges = staged(edges, "edges")
    # What is still missing is filled by single documents beyond that end: twice by the largest that fits, then by the
    # one whose size comes nearest.
    beyond = (F.col("block") > F.col("b")) | ((F.col("block") == F.col("b")) & (F.col("__place") > F.coalesce("upto", F.lit(-1.0))))
    gaps = edges.withColumn("picks", F.array().cast("array<struct<off:double,at:double,block:long>>"))
    for fits in (True, True, False):
        off = F.col("gap") - F.col("size")
        new = ~F.exists("picks", lambda x: x["at"] == F.col("__place"))
        found = placed.where("size > 0").join(_small(gaps), here).where(beyond & new & (off >= 0 if fits else F.abs(off) < F.col("gap")))
        found = found.groupBy("s").agg(F.min(F.struct(F.abs(off).cast("double").alias("off"), F.col("__place").alias("at"), "block")).alias("x"))
        gaps = gaps.join(_small(found.withColumnRenamed("s", "t")), F.col("s").eqNullSafe(F.col("t")), "left").drop("t")
        picked = F.when(F.col("x").isNull(), F.col("picks")).otherwise(F.array_append("picks", F.col("x")))
        gaps = staged(gaps.withColumns({"picks": picked, "gap": F.when(F.col("x").isNull(), F.col("gap")).otherwise(F.col("x.off"))}).drop("x"), "gaps")
    last = gaps.select("s", "lap", F.explode("picks").alias("x"))

    # Every lap over every block that is taken, and what is taken of a block in part, in the source's permuted order.
    whole = (F.col("need") > 0) & ~F.col("cut") & (F.col("words") > 0)
    laps_of = F.slice(F.array(*(F.lit(k) for k in range(cap))), F.lit(1), F.col("laps").cast("int") + whole.cast("int"))
    everywhere = (F.lit(0.0), F.lit(1.0))
    taken = sums.select("source", "block", F.explode(laps_of).alias("lap"), *(c.alias(n) for c, n in zip(everywhere, ("from", "upto"))))
    taken = taken.unionByName(edges.where("upto is not null").select(F.col("s").alias("source"), F.col("b").alias("block"), F.col("lap").cast("int").alias("lap"), F.lit(0.0).alias("from"), "upto"))
    taken = taken.unionByName(last.select(F.col("s").alias("source"), F.col("x.block").alias("block"), F.col("lap").cast("int").alias("lap"), F.col("x.at").alias("from"), F.col("x.at").alias("upto")))
    order = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed), "source", "block", "lap", "from"), "block", "lap", "from")
    taken = staged(taken.withColumn("p", (F.row_number().over(order) - 1).cast("long")), "draws")

    leaves = _tree(taken.groupBy("source").agg(F.count(F.lit(1)).alias("quota")), shards.bit_length() - 1, seed)
    upper = F.sum("quota").over(Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    dealt = leaves.select(F.col("source").alias("s"), "shard", "quota", upper.alias("upper")).select("s", F.col("shard").cast("int").alias("shard"), F.explode(F.sequence(F.col("upper") - F.col("quota"), F.col("upper") - 1)).alias("q"))
    draws = taken.join(dealt, F.col("source").eqNullSafe(F.col("s")) & (F.col("p") == F.col("q")))
    draws = draws.groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct("lap", "shard", "from", "upto"))).alias("draws"))
    return sources, staged(draws, "plan")


def _planned(rows: DataFrame, sources: DataFrame, draws: DataFrame, source: str) -> DataFrame:
    """rows (with __place) and the draws that take each, __draws; also source_size and target."""
    s = _small(sources.select(F.col("source").alias("__s"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), "__blocks"))
    d = _small(draws.select(F.col("source").alias("__d"), F.col("block").alias("__b"), F.col("draws").alias("__draws")))
    rows = rows.join(s, F.col(source).eqNullSafe(F.col("__s")), "left").withColumn("__block", _block())
    rows = rows.join(d, F.col(source).eqNullSafe(F.col("__d")) & (F.col("__block") == F.col("__b")), "left")
    held = F.filter(F.coalesce("__draws", F.array().cast("array<struct<lap:int,shard:int,from:double,upto:double>>")), lambda x: F.col("__place").between(x["from"], x["upto"]))
    return rows.withColumn("__draws", held).drop("__s", "__d", "__b", "__block", "__blocks", "__place")


def mixed_sizes(docs: DataFrame, seed: int = 7, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, shards: one row per document.

    taken: the words that the mix has of it, repeats counted. shards: the output shard of each copy.
    """
    units = staged(_units(docs, seed), "units")
    rows = _planned(units, *plan(units, seed=seed, **options), "source")
    return rows.select(
        "doc_id",
        "size",
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        (F.col("size") * F.size("__draws")).cast("long").alias("taken"),
        F.transform("__draws", lambda d: d["shard"]).alias("shards"),
    )


def mix(docs: DataFrame, seed: int = 7, **options) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is drawn, with mix_shard and mix_order.

    docs has doc_id, source and text; all columns are returned, but for earlier mix_shard and
    mix_order, which are replaced. Sorting a shard by mix_order shuffles it.
    """
    docs = docs.drop("mix_shard", "mix_order")
    # In one struct, so that none of their names can meet one used here.
    row = F.struct(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)))
    docs_alone = docs.select("doc_id", "source", "text", row.alias("__row"))
    rows = _planned(docs_alone.withColumn("__place", _place(seed)), *plan(staged(_units(docs, seed), "units"), seed=seed, **options), "source")
    drawn = rows.withColumn("__d", F.explode("__draws"))
    return drawn.select(*(F.col(f"__row.c{k}").alias(c) for k, c in enumerate(docs.columns)), F.col("__d.shard").alias("mix_shard"), F.xxhash64(F.lit(seed + 1), "doc_id", F.col("__d.lap")).alias("mix_order"))


def shuffled(mixed: DataFrame, shards: int = 16, tasks: int | None = None) -> DataFrame:
    """The mix in shard order, each shard in its own random order.

    A shard is cut into even parts by mix_order, which is a hash, so that it may span several tasks.
    """
    parts = -(-(tasks or partitions_for(2 * file_bytes(mixed))) // shards)
    part = F.least(F.floor((F.col("mix_order") / F.lit(float(1 << 63)) + 1) / 2 * parts), F.lit(parts - 1))
    return mixed.repartition(shards * parts, "mix_shard", part).sortWithinPartitions("mix_shard", "mix_order")
