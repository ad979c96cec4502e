"""Pair scorers.

A scorer is a Column over two feature columns, a function of two blocks of features for the tiled
path, or an external program behind `external`.
"""

from __future__ import annotations

import subprocess
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scorer:
    """column: of the features of i and j. block: of two matrices, rows are items; whole-number scores.

    A scorer that is not symmetric has to see both directions of a pair. bound: of the least and greatest features (low, high) of
    two groups of items, no less than any score between them; the greater, the less a tile can be left out. terms: as column, of
    lists that have a Column for each feature. aligned: of two matrices of as many rows, the score of each row of one with that of the other.
    """

    name: str
    column: Callable[[Column, Column], Column]
    block: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None
    symmetric: bool = True
    bound: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None = None
    terms: Callable[[list[Column], list[Column]], Column] | None = None
    aligned: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None

    def rows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.aligned(a, b) if self.aligned else np.array([self.block(x[None], y[None])[0, 0] for x, y in zip(a, b)])


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)


def _l1(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0).cast("long"), lambda s, x: s + x)


def _sum(terms: list[Column]) -> Column:
    return reduce(lambda s, x: s + x, terms, F.lit(0).cast("long"))


def _l1_block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """|x - y| is 2 max(x, y) - x - y: sums of maxima, feature by feature, of numbers as small as hold them."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)))
    low = np.minimum(a.min(0), b.min(0))
    span = np.maximum(a.max(0), b.max(0)) - low
    reach = span.sum()
    if reach >= 2**31 or (a != np.floor(a)).any() or (b != np.floor(b)).any():
        return np.array([np.abs(b - row).sum(1) for row in a])
    # Sums of 16 bits may run over the sign, and are read without one.
    kind, read = (np.int16, np.uint16) if reach < 2**16 and span.max(initial=0) < 2**15 else (np.int32, np.int32)
    x, y = (np.ascontiguousarray((v - low).astype(kind).T) for v in (a, b))
    out = np.empty((len(a), len(b)))
    greater = np.empty((min(128, len(a)), len(b)), kind)
    for k in range(0, len(a), 128):
        own = x[:, k : k + 128]
        total, t = np.zeros((own.shape[1], len(b)), kind), greater[: own.shape[1]]
        for u, v in zip(own, y):
            t[:] = u[:, None]
            np.maximum(t, v, out=t)
            total += t
        out[k : k + 128] = total.view(read)
    out *= 2
    out -= (a - low).sum(1)[:, None]
    out -= (b - low).sum(1)
    return out


def _similarity_block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a @ b.T
    out /= 10000.0
    np.floor(out, out=out)
    out += 60
    return out


def _closeness_block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = _l1_block(a, b)
    np.subtract(12000, out, out=out)
    out /= 100.0
    return np.floor(out, out=out)


def _greatest_dot(low_a: np.ndarray, high_a: np.ndarray, low_b: np.ndarray, high_b: np.ndarray) -> np.ndarray:
    products = np.maximum(np.maximum(low_a * low_b, low_a * high_b), np.maximum(high_a * low_b, high_a * high_b))
    return np.floor(products.sum(-1) / 10000.0) + 60


def _greatest_closeness(low_a: np.ndarray, high_a: np.ndarray, low_b: np.ndarray, high_b: np.ndarray) -> np.ndarray:
    gaps = np.maximum(np.maximum(low_a - high_b, low_b - high_a), 0)
    return np.floor((12000 - gaps.sum(-1)) / 100.0)


#: Whole-number features make every sum exact, whatever its order.
similarity = Scorer("similarity", lambda a, b: (F.floor(_dot(a, b) / 10000.0) + 60).cast("long"), _similarity_block, bound=_greatest_dot, aligned=lambda a, b: np.floor(np.einsum("ij,ij->i", a, b) / 10000.0) + 60, terms=lambda a, b: (F.floor(_sum([x * y for x, y in zip(a, b)]) / 10000.0) + 60).cast("long"))
closeness = Scorer("closeness", lambda a, b: F.floor((12000 - _l1(a, b)) / 100.0).cast("long"), _closeness_block, bound=_greatest_closeness, terms=lambda a, b: F.floor((12000 - _sum([F.abs(x - y) for x, y in zip(a, b)])) / 100.0).cast("long"))


def _half(a: Column, first: bool) -> Column:
    return F.slice(a, 1 if first else 33, 32)


one_sided = Scorer(
    "one_sided",
    lambda a, b: F.floor(_dot(_half(a, True), _half(b, False)) / 10000.0).cast("long"),
    lambda a, b: np.floor(a[:, :32] @ b[:, 32:].T / 10000.0),
    symmetric=False,
)


def external(pairs: DataFrame, score: Callable[[pd.Series, pd.Series], list[int]], a: str = "path_a", b: str = "path_b") -> DataFrame:
    """pairs with a column score from a program that scores a batch of path pairs at once.

    It has to return a whole number for each pair; anything else fails the task, which is then tried again.
    """
    schema = ", ".join(f"`{c}` {t}" for c, t in pairs.dtypes if c != "score") + ", score long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [int(x) for x in score(pdf[a], pdf[b]) if str(x).strip()]
            if len(got) != len(pdf):
                raise ValueError(f"{len(pdf)} pairs asked for, {len(got)} scores given")
            yield pdf.assign(score=got)

    return pairs.drop("score").mapInPandas(run, schema)


def program(command: list[str], seconds: float = 3600) -> Callable[[pd.Series, pd.Series], list[str]]:
    """For `external`: a program that is given a line with both paths, parted by a tab, for each pair, and writes a line with the score of each.

    It runs once for a batch, where the batch is; an exit other than 0 or one that takes longer fails the task.
    """

    def score(a: pd.Series, b: pd.Series) -> list[str]:
        lines = "".join(f"{x}\t{y}\n" for x, y in zip(a, b))
        return subprocess.run(command, input=lines, capture_output=True, text=True, check=True, timeout=seconds).stdout.splitlines()

    return score


def mirrored(scorer: Scorer) -> Scorer:
    """The greater score of both directions, which is symmetric: a tile makes both."""
    return Scorer(
        scorer.name,
        lambda a, b: F.greatest(scorer.column(a, b), scorer.column(b, a)),
        scorer.block and (lambda a, b: np.maximum(scorer.block(a, b), scorer.block(b, a).T)),
    )
