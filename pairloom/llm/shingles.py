"""Near-duplicates by SimHash, confirmed and completed at a Jaccard similarity of word shingles.

Two texts link if their sets of shingles (runs of five words, lower-cased as in simhash) have a
similarity of 0.8 or more.

SimHash. The fingerprints of the texts are grouped by anchor-point covering (`simhash`), and each set
of a group is checked on the whole sets against the group's least one. But texts of that similarity
differ in about 10 of 64 bits, and anchors within reach of so many bits would make each fingerprint
meet most others. So SimHash finds the near ones, and what it cannot reach is found by this:

Completion. A set of n shingles that links to another shares at least ceil(0.8 n) of
its own with it; so under any one order of all shingles, both have a common one among their first
n - ceil(0.8 n) + 1. These meet by shingle, and what can still reach the similarity by the sizes and
the places of the common shingle, and by the distance of bit maps of the sets (shingles that only one
of two sets has are never fewer than the bits that differ), is checked on the whole sets. The order
puts shingles that many documents have last (by a sample, which changes the cost and never the
result), then goes by hash.

Large groups of near copies would make all their pairs. So each set is also checked against one
pivot for each of a few least hashes, and where a hash has many sets still apart, in further turns
against others; sets that these links or those of SimHash connect need no pairs
among themselves. Pivots of the further turns are sets most of whose shingles others have as well, which lie
in the middle of their group, and only pairs that share half of their least hashes are checked; what
pivots miss, the completion finds.

Defined cases: null and wordless texts have the empty set and are alike; fewer than five words make
one shingle; equal sets are one vertex throughout. Shingles are told apart by 64-bit hashes, and
sets by a 64-bit hash of those; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm import simhash
from pairloom.llm.common import discard, map_texts, staged
from pairloom.llm.components import components
from pairloom.llm.simhash import combined, shingle_hashes

SEED = 42
#: Odd factors that make other orders of the same hashes, for the pivots.
FACTORS = np.random.default_rng(3).integers(0, 1 << 63, 16, np.uint64) * np.uint64(2) + np.uint64(1)
#: Bits of the map of a set: how often each value of a shingle's last bits occurs, modulo 2.
BITS = 1024
#: Up to so many rows (of 8 or 16 bytes) on which sets are wanted, or in a large cluster, are told to all tasks, which saves dealing out all sets.
TOLD = 500_000
#: Clusters below this size may as well make their pairs.
CLUSTER = 32
#: Of the least hashes of a set and of its pivot so many have to be equal; of 16 about 13 are at a similarity of 0.8.
SHARED = 8


def shingle_set(text: str, words_of_shingle: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text; empty for a text without words."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, words_of_shingle)]))


def _sets(docs: DataFrame, words_of_shingle: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, t (hash of the text), v (hash of the set), n (its size), shingles, least (one hash for each of FACTORS), bits, fp (SimHash): one row per document."""
    from xxhash import xxh64_intdigest

    def work(texts: list[str], ts: list[int]) -> list:
        sets, fps = [], []
        for text in texts:
            parts = list(shingle_hashes(text, words_of_shingle))
            fps.append(combined(parts))
            sets.append(np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64))
        v = np.array([xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
        least = [(s[:, None] * FACTORS).min(0).view(np.int64) if len(s) else [] for s in sets]
        bits = [np.packbits(np.bincount(s.astype(np.int64) & (BITS - 1), minlength=BITS) & 1).view(np.int64) for s in sets]
        return [ts, v, [len(s) for s in sets], [s.view(np.int64) for s in sets], least, bits, np.array(fps, np.uint64).view(np.int64)]

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("t"))
    return map_texts(rows, work, "doc_id long, t long, v long, n int, shingles array<long>, least array<long>, bits array<long>, fp long", also=("t",))


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of the pairs (u, v) those that have the similarity."""
    maps = sets.select("v", "n", "bits").groupBy("v").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
    a, b = (maps.select(F.col("v").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"b{x}")) for x in "uv")
    apart = F.aggregate(F.zip_with("bu", "bv", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    sizes = F.col("nu") + F.col("nv")
    pairs = staged(pairs.join(a, "u").join(b, "v").where(apart <= sizes - 2 * _least_common(sizes, similarity)).select("u", "v"), "mapped")
    wanted = staged(pairs.select("u").unionByName(pairs.select(F.col("v").alias("u"))).distinct().withColumnRenamed("u", "v"), "wanted")
    told = F.broadcast(wanted) if wanted.count() <= TOLD else wanted
    few = staged(sets.select("v", "n", "shingles").join(told, "v", "left_semi").groupBy("v").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles")), "few")
    a, b = (few.select(F.col("v").alias(x), F.col("n").alias(f"n{x}"), F.col("shingles").alias(f"s{x}")) for x in "uv")
    common = F.size(F.array_intersect("su", "sv"))
    out = staged(pairs.join(a, "u").join(b, "v").where(common >= _least_common(sizes, similarity)).select("u", "v"), "alike")
    discard(pairs, wanted, few)
    return out


def _least_common(sizes, similarity: float):
    """How many common shingles two sets with so many in sum need."""
    return sizes * (similarity / (1 + similarity)) - 1e-6


def _last_bytes(first: int):
    """The last bytes of eight of a set's least hashes as one number."""
    return sum((F.shiftleft(F.col("least")[first + k].bitwiseAND(255), 8 * k) for k in range(1, 8)), F.col("least")[first].bitwiseAND(255))


def _differ(a: str, b: str):
    """In how many of its eight bytes two numbers differ."""
    x = F.col(a).bitwiseXOR(F.col(b))
    for k in (4, 2, 1):
        x = x.bitwiseOR(F.shiftrightunsigned(x, k))
    return F.bit_count(x.bitwiseAND(0x0101010101010101))


def _pivot_pairs(at: DataFrame, turn: int) -> DataFrame:
    """(u, v), u < v: each set with a pivot among those of other clusters c that share one of its least hashes m.

    at: k, m, v, c, x and y (last bytes of all least hashes), score. The pivots of a group of near copies are different sets
    for each k and turn, those with a high score sooner; a set and its pivot share SHARED least hashes.
    """
    h = F.xxhash64("v", "k", F.lit(turn))
    middle = F.col("score") * (F.lit(1000) - F.pmod(h, F.lit(100 * max(turn - 1, 0) + 1)))
    order = F.struct((-middle).alias("o"), h.alias("h"), F.col("v"), F.col("c"), F.col("x"), F.col("y"))
    pivots = at.groupBy("k", "m").agg(F.min(order).alias("a"), F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high")
    pivots = pivots.select("k", "m", F.col("a.v").alias("p"), F.col("a.c").alias("d"), F.col("a.x").alias("px"), F.col("a.y").alias("py"))
    both = at.join(pivots, ["k", "m"]).where((F.col("c") != F.col("d")) & (_differ("x", "px") + _differ("y", "py") <= len(FACTORS) - SHARED))
    return both.select(F.least("p", "v").alias("u"), F.greatest("p", "v").alias("v")).distinct()


def _stars(sets: DataFrame, similarity: float, bits: int, common: tuple[np.ndarray, np.ndarray], turns: int = 4, first: int = 4) -> tuple[DataFrame, DataFrame]:
    """Links found by SimHash and by pivots, and the large clusters that they make, (v, c).

    The first turn takes the pivots of the `first` factors. After it only cells of many sets, in which there are several
    clusters, get other pivots, of all factors; a set scores by its share of common shingles.
    """
    at = sets.select("v", _last_bytes(0).alias("x"), _last_bytes(8).alias("y"), F.posexplode("least").alias("k", "m"))
    at = staged(at.distinct(), "least")
    near = _simhash_pairs(sets, bits).unionByName(_pivot_pairs(at.where(F.col("k") < first).select("*", F.col("v").alias("c"), F.lit(0).cast("long").alias("score")), 0)).distinct()
    stars = _alike(staged(near, "pivots"), sets, similarity)
    crowded = at.groupBy("k", "m").count().where(F.col("count") >= CLUSTER).select("k", "m")
    scores = sets.select("v", "n", "shingles").mapInArrow(_common_share(common[0]), "v long, score long").distinct()
    scored = staged(at.join(crowded, ["k", "m"], "left_semi").join(scores, "v"), "scored")
    discard(at)
    for turn in range(1, turns + 1):
        known = components(stars).withColumnRenamed("vertex", "v")
        large = known.groupBy("root").count().where(F.col("count") >= CLUSTER).select("root")
        clusters = staged(known.join(large, "root", "left_semi").select("v", F.col("root").alias("c")).distinct(), "clusters")
        if turn == turns:
            break
        near = staged(_pivot_pairs(scored.join(clusters, "v", "left").withColumn("c", F.coalesce("c", "v")), turn), "pivots")
        if near.isEmpty():
            break
        stars = stars.unionByName(_alike(near, sets, similarity))
    discard(scored)
    return stars, clusters


def _simhash_pairs(sets: DataFrame, most: int) -> DataFrame:
    """(u, v): each set whose fingerprint is grouped with others by SimHash, with the group's least set."""
    found = simhash.grouped(sets.select(F.col("v").alias("doc_id"), "fp"), most)
    return found.where("doc_id <> component_id").select(F.col("component_id").alias("u"), F.col("doc_id").alias("v"))


def _common_shingles(sets: DataFrame, share: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many documents have, sorted, and in how many of one sampled of `share` they are."""
    seen = sets.where(F.pmod(F.xxhash64("v"), F.lit(share)) == 0).select(F.explode("shingles").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("c"))
    seen = staged(seen.where("c >= 4"), "common")
    total, least = 0, None
    for r in sorted(seen.groupBy("c").count().collect(), reverse=True):
        total += r["count"]
        if total > most:
            break
        least = r["c"]
    rows = seen.where(F.lit(least is not None) & (F.col("c") >= (least or 0))).toArrow()
    x, c = rows["x"].to_numpy().view(np.uint64), rows["c"].to_numpy()
    order = np.argsort(x)
    return x[order], c[order]


def _common_share(hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """v, score: how many thousandths of the shingles of a set are common ones."""
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("shingles")
            values, offsets = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
            known = np.zeros(len(values) + 1, np.int64)
            if len(hot):
                known[1:] = np.cumsum(hot[np.minimum(np.searchsorted(hot, values), len(hot) - 1)] == values)
            score = 1000 * (known[offsets[1:]] - known[offsets[:-1]]) // np.maximum(1, np.diff(offsets))
            yield pa.RecordBatch.from_arrays([batch.column("v"), pa.array(score, pa.int64())], ["v", "score"])

    return run


def _first_shingles(common: tuple[np.ndarray, np.ndarray], similarity: float):
    hot, often = common

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            n, lists = batch.column("n").to_numpy(), batch.column("shingles")
            values, offsets = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
            for k in np.flatnonzero(n).tolist():
                s = values[offsets[k] : offsets[k + 1]]
                first = len(s) - int(np.ceil(similarity * len(s) - 1e-6)) + 1
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
                    s = s[np.argsort(np.where(hot[at] == s, often[at], 0), kind="stable")]
                out.append((k, s[:first]))
            if out:
                row = np.repeat([k for k, _ in out], [len(s) for _, s in out])
                place = np.concatenate([np.arange(len(s), dtype=np.int32) for _, s in out])
                columns = [pa.array(np.concatenate([s for _, s in out]).view(np.int64)), batch.column("v").take(row), batch.column("n").take(row), pa.array(place), batch.column("c").take(row)]
                yield pa.RecordBatch.from_arrays(columns, ["shingle", "v", "n", "place", "c"])

    return run


def _candidates(similarity: float):
    def pairs(v, n, place, c) -> Iterator[pa.RecordBatch]:
        """Pairs of one cell that may have the similarity if this is the first shingle they have in common."""
        _, at = np.unique(v, return_index=True)
        v, n, place, c = v[at], n[at].astype(np.int64), place[at], c[at]
        order = np.argsort(n, kind="stable")
        v, n, rest, c = v[order], n[order], (n - place - 1)[order], c[order]
        block = max(1, (1 << 20) // max(1, len(v)))
        for a in range(0, len(v), block):
            i = np.arange(a, min(a + block, len(v)))
            stop = np.searchsorted(n, n[i[-1]] / similarity + 1e-6, "right")
            j = np.arange(a, stop)
            may = (i[:, None] < j) & (c[i][:, None] != c[j])
            may &= np.minimum(rest[i][:, None], rest[j]) + 1 >= _least_common(n[i][:, None] + n[j], similarity)
            x, y = np.nonzero(may)
            if len(x):
                p, q = v[i[x]], v[j[y]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches come sorted by cell; the last cell of a batch may go on in the next."""
        rest = None

        def cells(columns):
            cuts = np.flatnonzero(np.append(True, columns[0][1:] != columns[0][:-1]))
            ends = np.append(cuts[1:], len(columns[0]))
            several = ends - cuts > 1
            for a, b in zip(cuts[several].tolist(), ends[several].tolist()):
                yield from pairs(*(x[a:b] for x in columns[1:]))

        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(x).to_numpy() for x in ("cell", "v", "n", "place", "c")]
            new = new if rest is None else [np.concatenate(x) for x in zip(rest, new)]
            key = new[0]
            cut = len(key) - int(np.argmax(key[::-1] != key[-1])) if (key != key[-1]).any() else 0
            rest = [x[cut:] for x in new]
            if cut:
                yield from cells([x[:cut] for x in new])
        if rest is not None:
            yield from cells(rest)

    return run


def links(sets: DataFrame, similarity: float = 0.8, cell: int = 20_000, share: int = 4, most: int = 1_000_000, bits: int = 4) -> DataFrame:
    """Edges (u, v) between sets (columns v, n, shingles, least, bits, fp) that connect whatever has the similarity.

    bits: in which SimHash fingerprints may differ.
    """
    common = _common_shingles(sets, share, most)
    stars, clusters = _stars(sets, similarity, bits, common)
    told = F.broadcast(clusters) if clusters.count() <= TOLD else clusters
    own = sets.select("v", "n", "shingles").join(told, "v", "left").withColumn("c", F.coalesce("c", "v"))
    first = own.mapInArrow(_first_shingles(common, similarity), "shingle long, v long, n int, place int, c long")
    if len(common[0]):
        crowded = first.groupBy("shingle").count().where(F.col("count") > cell).select("shingle", F.ceil(F.col("count") / cell).cast("int").alias("tiles"))
        crowded = staged(crowded, "crowded")
    if not len(common[0]) or crowded.isEmpty():
        cells = first.withColumnRenamed("shingle", "cell")
    else:
        tile = F.pmod(F.xxhash64("v"), F.col("tiles")).cast("int")
        tiles = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda j: F.xxhash64("shingle", F.least(tile, j), F.greatest(tile, j)))
        cells = first.join(crowded, "shingle", "left").select(F.explode(F.when(F.col("tiles").isNull(), F.array("shingle")).otherwise(tiles)).alias("cell"), "v", "n", "place", "c")
    near = cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_candidates(similarity), "u long, v long").distinct()
    near = staged(near, "candidates")
    return stars.unionByName(_alike(near, sets, similarity))


def near_keep(docs: DataFrame, similarity: float = 0.8, words_of_shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that stay, with all columns: of each component the document with the smallest id.

    A row without an id stays only if its component has none with an id. Among rows that share the id,
    or have none, the least hash of the text stays. Rows equal in id and text are one document.
    """
    sets = staged(_sets(docs, words_of_shingle, id_col, text_col), "sets")
    found = components(links(sets, similarity, **options)).select(F.col("vertex").alias("v"), "root")
    rows = sets.select("doc_id", "t", "v").join(found, "v", "left").select("doc_id", "t", F.coalesce("root", "v").alias("root"))
    rows = staged(rows, "rows")
    discard(sets)
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("t").alias("t"))
    first = rows.groupBy("root").agg(F.min(order).alias("first"), F.max(order).alias("last")).where("first <> last").select("root", "first")
    gone = rows.join(first, "root").where(~(F.col("doc_id").eqNullSafe(F.col("first.id")) & (F.col("t") == F.col("first.t"))))
    gone = staged(gone.select(F.col("doc_id").alias("__id"), F.col("t").alias("__t")).distinct(), "gone")
    discard(rows)
    same = docs[id_col].eqNullSafe(gone["__id"]) & (F.xxhash64(docs[text_col]) == gone["__t"])
    return docs.join(gone, same, "left_anti")
