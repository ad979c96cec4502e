"""Near-duplicates by SimHash, linked by anchor-point covering.

A fingerprint has 64 bits; two link at `most` or fewer differing bits. The bits are cut into m
blocks, one of which then differs in at most t = most // m bits. In each block the anchors are the
words of a linear covering code of radius R: every value is within R of its home anchor, and a
value that differs from it in at most t bits is within R + t of that same anchor. So each distinct
fingerprint goes to all anchors within R + t in every block, and at each anchor those at home there
are compared, over all 64 bits, with all that came. No link is lost, whichever code is taken; the
code is taken by the number of distinct fingerprints, so that an anchor gets few of them.

The codes take 1.3 million (Golay, 23 bits), 14 million (Hamming, 15 of 21 bits) and 1.9 thousand
million (Hamming, 31 of 32 bits, 343 anchors a fingerprint) distinct fingerprints at 5000 comparisons
each; beyond that the comparisons of one grow with the number of all, and no link is lost.

At an anchor only a star of each linked set leaves (members to its least member), never all pairs.
Anchors that hold more than `cell` fingerprints, as where very many texts are nearly alike, are cut
into tiles, and each pair of tiles is a cell of its own. Equal fingerprints are one vertex throughout.

Defined cases: null and wordless texts have fingerprint 0 and link like any other; fewer than four
words make one shingle; rows with a null doc_id take part in linking but are never the smallest id
(a component of nothing but such rows has a null component_id); repeated rows get equal results;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import map_texts, staged
from pairloom.llm.components import components

SEED = 42


def shingle_hashes(text: str, words_of_shingle: int) -> Iterator[np.ndarray]:
    """XXH64 of the word shingles of a text, repeats included, in parts; none for a text without words."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.append(0, ends[:-1] + 1)
    k = min(words_of_shingle, len(words))
    n = len(words) - k + 1
    for at in range(0, n, 1 << 17):
        a, b = begins[at : min(at + (1 << 17), n)].tolist(), ends[at + k - 1 : min(at + (1 << 17), n) + k - 1].tolist()
        yield np.array([xxh64_intdigest(joined[x:y], SEED) for x, y in zip(a, b)], "<u8")


def combined(parts: Iterable[np.ndarray]) -> int:
    """The SimHash of hashes: a bit is set if it is set in more than half of them; 0 without any."""
    total, n = np.zeros(64, np.int64), 0
    for hashes in parts:
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str, words_of_shingle: int = 4) -> int:
    """64-bit SimHash over word shingles, repeats counted; 0 for a text without words."""
    return combined(shingle_hashes(text, words_of_shingle))


def fingerprints(docs: DataFrame, words_of_shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""
    return map_texts(docs, lambda texts: [np.array([fingerprint(t, words_of_shingle) for t in texts], np.uint64).view(np.int64)], "doc_id long, fp long", id_col, text_col)


@dataclass(frozen=True)
class Code:
    """A linear code on blocks of a fingerprint.

    blocks: (lowest bit, bits, padded bits) of each block. parts: generator polynomials of the
    cyclic codes laid side by side in a block, with their lengths; bits beyond them are uncoded, so
    all their values are code words.
    """

    name: str
    blocks: tuple[tuple[int, int, int], ...]
    parts: tuple[tuple[int, int], ...]
    radius: int
    anchors: int
    _tables: dict = field(default_factory=dict, compare=False, repr=False)

    def columns(self, bits: int) -> np.ndarray:
        """Syndrome of each single bit of a block."""
        out, at, shift = [], 0, 0
        for length, poly in self.parts:
            degree = poly.bit_length() - 1
            for i in range(length):
                value = 1 << i
                while value.bit_length() > degree:
                    value ^= poly << (value.bit_length() - 1 - degree)
                out.append(value << shift)
            at, shift = at + length, shift + degree
        return np.array(out + [0] * (bits - at), np.int64)

    def patterns(self, bits: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All error patterns of at most `most` bits by syndrome: patterns, and where each syndrome's begin and end.

        The first of a syndrome is its leader, the pattern from any value to its home anchor.
        """
        if (bits, most) not in self._tables:
            columns = self.columns(bits)
            errors, syndromes = [], []
            for weight in range(most + 1):
                for places in combinations(range(bits), weight):
                    errors.append(sum(1 << p for p in places))
                    syndromes.append(int(np.bitwise_xor.reduce(columns[list(places)])) if places else 0)
            order = np.argsort(np.array(syndromes), kind="stable")
            errors, syndromes = np.array(errors, np.int64)[order], np.array(syndromes)[order]
            count = 1 << sum(poly.bit_length() - 1 for _, poly in self.parts)
            first = np.searchsorted(syndromes, np.arange(count + 1))
            self._tables[bits, most] = errors, first[:-1], first[1:]
        return self._tables[bits, most]

    def syndromes(self, values: np.ndarray, bits: int) -> np.ndarray:
        out = np.zeros(len(values), np.int64)
        for i, column in enumerate(self.columns(bits)):
            if column:
                out ^= ((values >> i) & 1) * column
        return out

    def spread(self, fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, index into fps, at home there) for every anchor that a fingerprint is to visit."""
        t = most // len(self.blocks)
        anchors, index, home = [], [], []
        for number, (low, width, bits) in enumerate(self.blocks):
            values = ((fps.view(np.uint64) >> np.uint64(low)) & np.uint64((1 << width) - 1)).view(np.int64)
            errors, first, last = self.patterns(bits, self.radius + t)
            s = self.syndromes(values, bits)
            n = last[s] - first[s]
            row = np.repeat(np.arange(len(fps)), n)
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            anchors.append((number << 40) | (values[row] ^ errors[first[s][row] + step]))
            index.append(row)
            home.append(step == 0)
        return np.concatenate(anchors), np.concatenate(index), np.concatenate(home)

    def replicas(self, most: int) -> float:
        """Mean number of anchors of a fingerprint."""
        t = most // len(self.blocks)
        return sum(len(self.patterns(bits, self.radius + t)[0]) / len(self.patterns(bits, self.radius + t)[1]) for _, _, bits in self.blocks)


#: Generator polynomials of the binary Golay code (23, 12) and the Hamming codes (15, 11) and (31, 26).
GOLAY, HAMMING, LONG_HAMMING = (23, 0b110001110101), (15, 0b10011), (31, 0b100101)
THIRDS = ((0, 22), (22, 21), (43, 21))
#: From few anchors and few replicas to many of both.
CODES = (
    Code("golay", tuple((low, width, 23) for low, width in THIRDS), (GOLAY,), 3, 1 << 12),
    Code("hamming", tuple((low, width, width) for low, width in THIRDS), (HAMMING,), 1, 1 << 17),
    Code("hamming-halves", ((0, 32, 32), (32, 32, 32)), (LONG_HAMMING,), 1, 1 << 27),
)


def most_fingerprints(code: Code, most: int = 4, comparisons: int = 5000) -> int:
    """How many evenly spread fingerprints a code can take so that each is compared with about `comparisons` others."""
    return int(comparisons * code.anchors / code.replicas(most))


def code_for(n: int, most: int = 4, comparisons: int = 5000) -> Code:
    """The first code that can take n fingerprints, or the finest."""
    return next((c for c in CODES if n <= most_fingerprints(c, most, comparisons)), CODES[-1])


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Make labels the least index of what the pairs (i, j) connect."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (label[label] != label).any():
            label[:] = label[label]


def linked(fps: np.ndarray, home: np.ndarray, most: int) -> np.ndarray:
    """Index of the least fingerprint that each links to through this anchor, or its own. fps are sorted."""
    label, homes = np.arange(len(fps)), np.flatnonzero(home)
    block = max(1, (1 << 21) // max(1, len(fps)))
    for at in range(0, len(homes), block):
        rows = homes[at : at + block]
        i, j = np.nonzero(np.bitwise_count(fps[rows][:, None] ^ fps[None, :]) <= most)
        _merge(label, rows[i], j)
    return label


def _anchor_stars(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches come sorted by cell; the last cell of a batch may go on in the next."""
        rest: tuple[np.ndarray, ...] | None = None

        def stars(key, fp, home):
            us, vs = [], []
            cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(key)).tolist()):
                if b - a < 2:
                    continue
                f, at = np.unique(fp[a:b], return_inverse=True)
                h = np.zeros(len(f), bool)
                h[at[home[a:b]]] = True
                label = linked(f, h, most)
                moved = np.flatnonzero(label != np.arange(len(f)))
                us.append(f[moved])
                vs.append(f[label[moved]])
            if us:
                u, v = np.concatenate(us), np.concatenate(vs)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            new = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "fp", "home"))
            new = (new[0], new[1].view(np.uint64), new[2])
            key, fp, home = new if rest is None else tuple(np.concatenate(x) for x in zip(rest, new))
            cut = len(key) - np.argmax(key[::-1] != key[-1]) if (key != key[-1]).any() else 0
            rest = (key[cut:], fp[cut:], home[cut:])
            if cut:
                yield from stars(key[:cut], fp[:cut], home[:cut])
        if rest is not None:
            yield from stars(*rest)

    return run


def links(classes: DataFrame, most: int = 4, code: Code | None = None, cell: int = 20_000) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column fp) that connect whatever differs in `most` bits or fewer."""
    code = code or code_for(classes.count(), most)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                fps = batch.column("fp").to_numpy()
                anchor, index, home = code.spread(fps, most)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fps[index]), pa.array(home)], ["anchor", "fp", "home"])

    visits = classes.select("fp").mapInArrow(spread, "anchor long, fp long, home boolean")
    crowded = staged(visits.groupBy("anchor").count().where(F.col("count") > cell).select("anchor", F.ceil(F.col("count") / cell).cast("int").alias("tiles")), "crowded")
    if crowded.isEmpty():
        cells = visits.select(F.col("anchor").alias("cell"), "fp", "home")
    else:
        tile = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda j: F.xxhash64("anchor", F.least(tile, j), F.greatest(tile, j)))
        cells = visits.join(crowded, "anchor", "left").select(F.explode(F.when(F.col("tiles").isNull(), F.array("anchor")).otherwise(pairs)).alias("cell"), "fp", "home")
    stars = cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_anchor_stars(most), "u long, v long")
    return stars.distinct()


def grouped(prints: DataFrame, most: int = 4, code: Code | None = None, cell: int = 20_000) -> DataFrame:
    """prints (a table with an id, doc_id, and fp) with component_id, the smallest id of the component."""
    classes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    found = components(links(classes, most, code, cell)).select(F.col("vertex").alias("fp"), "root")
    found = staged(found, "linked")
    least = found.join(classes, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.join(found.join(least, "root").select("fp", "component_id"), "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return prints.join(staged(named, "named"), "fp")


def near_duplicates(docs: DataFrame, most: int = 4, words_of_shingle: int = 4, id_col: str = "doc_id", text_col: str = "text", code: Code | None = None, cell: int = 20_000) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id: one row per document."""
    prints = staged(fingerprints(docs, words_of_shingle, id_col, text_col), "fingerprints")
    return grouped(prints, most, code, cell).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
