"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted, each with a cost. Documents longer than the longest are cut
into pieces of that length, so every word is in one piece. Pieces are dealt to groups of about
`group_rows` by a hash of their document's id and content, their number and, for repeated rows, the
number of the copy; a group is packed by one task. Longest first, a piece goes to the fullest open
bin that holds it; where none does, a bin is opened at the length that costs least per word still to
be packed. That is done once for every set of permitted lengths that can hold the longest piece, and
the cheapest of these packings is taken, which settles the mix of lengths jointly. Last, every bin is
reduced to the shortest permitted length that holds its contents.

The length of a document is its number of words and one end mark.

Defined cases: null and empty texts have length 1; repeated rows and ids are packed as pieces of
their own; equal lengths are taken in order of id, content, copy and piece, so the result does not
depend on files or tasks; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import staged, word_count

CAPACITIES = (512, 1024, 2048, 4096)


def bin_cost(capacity: int, fixed: float = 32.0, quadratic: float = 1 / 32768) -> float:
    """Cost of a sequence: its places, a fixed part, and attention's square."""
    return fixed + capacity + quadratic * capacity * capacity


def best_fit(lengths: list[int], capacities: tuple[int, ...], opened: tuple[int, ...], cost=bin_cost) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(bin of each piece, its place there, capacity of each bin, total cost), with bins opened at the lengths `opened`.

    Lengths are from 1 to the greatest of `opened`, which are some of the permitted capacities.
    """
    order = np.argsort(-np.asarray(lengths), kind="stable").tolist()
    bins, places = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(max(capacities) + 1)]
    used: list[int] = []
    size: list[int] = []
    filled = 0  # bit r: there is an open bin with r places left
    rest = sum(lengths)
    for i in order:
        n = lengths[i]
        if fits := filled >> n:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                filled &= ~(1 << r)
        else:
            c = min((c for c in opened if c >= n), key=lambda c: (cost(c) / min(c, rest), c))
            b, r = len(used), c
            used.append(0)
            size.append(c)
        bins[i], places[i] = b, used[b]
        used[b] += n
        rest -= n
        if r > n:
            room[r - n].append(b)
            filled |= 1 << (r - n)
    least = np.sort(np.array(capacities))
    final = least[np.searchsorted(least, np.array(used, np.int64))] if used else np.zeros(0, np.int64)
    return bins, places, final, float(sum(map(cost, final.tolist())))


def pack_lengths(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, cost=bin_cost) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """The cheapest best-fit packing over all sets of permitted lengths."""
    longest = max(lengths, default=0)
    sets = [c for n in range(1, len(capacities) + 1) for c in combinations(sorted(capacities), n) if c[-1] >= longest]
    return min((best_fit(lengths, capacities, opened, cost) for opened in sets), key=lambda x: x[3])


def pack(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, group_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, pack_group, bin, place, capacity: one row per piece.

    start: the piece's first word in the document. place: its first place in the bin, which is bin
    number `bin` of its group.
    """
    longest = max(capacities)
    text = F.col(text_col)
    units = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("content"), (word_count(text) + 1).alias("n"))
    # Equal rows are counted before they are dealt out again, so no key is hot.
    units = staged(units.groupBy("doc_id", "content", "n").agg(F.count(F.lit(1)).alias("copies")), "lengths")
    pieces = units.agg(F.sum(F.col("copies") * F.ceil(F.col("n") / longest))).first()[0] or 0
    groups = max(1, -(-int(pieces) // group_rows))
    rows = units.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / longest))))
    rows = rows.select(
        "doc_id",
        "content",
        "copy",
        "piece",
        (F.col("piece") * longest).alias("start"),
        F.least(F.lit(longest).cast("long"), F.col("n") - F.col("piece") * longest).alias("length"),
        F.pmod(F.xxhash64("doc_id", "content", "copy", "piece"), F.lit(groups)).alias("pack_group"),
    )

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "content", "copy", "piece"])
        bins, places, sizes, _ = pack_lengths(pdf["length"].tolist(), capacities)
        return pdf.drop(columns=["content", "copy"]).assign(bin=bins, place=places, capacity=sizes[bins])

    return rows.groupBy("pack_group").applyInPandas(packed, "doc_id long, piece long, start long, length long, pack_group long, bin long, place long, capacity long")
