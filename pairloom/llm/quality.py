"""Quality by nearest-neighbour voting in a latent-semantic space.

Documents become counts of surface terms (word shapes, word endings, repeats of the word before),
hashed to `terms` columns. On a bounded sample of labelled documents the counts are weighted by
inverse document frequency and factored by a truncated SVD. The projection and the sample's unit
vectors are broadcast; their size is fixed by `sample`, `terms` and `dims`. Every document is then
projected, and its cosines with all labelled vectors are computed exactly, in blocks. The `k` nearest
vote with their labels, weighted by similarity.

Defined cases: null counts as empty; a text without terms gets the sample's mean label; similarities
are rounded to 2^-20, and ties are broken by the sample's order; repeated rows get equal scores, in
whatever batch and on whatever processor, because projections and cosines are exact sums of whole numbers; without any labels all
scores are 0.5; an empty table gives an empty result. Labels, ids and other columns are no inputs
of a score.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import lru_cache
from operator import eq

import numpy as np
from pyspark.sql import DataFrame

from pairloom.llm.common import map_texts, training_sample


#: Documents of one product, and what a similarity of 1 is rounded to.
BLOCK, ONE = 256, 1 << 20
#: Counts, axes and unit vectors are whole numbers of this unit. Rows are shorter than 10 and axes have length 1, so no sum of
#: products, in whatever order, passes 2^53, and products in float64 are exact.
UNIT = 1 << 24


def _fixed(x: np.ndarray) -> np.ndarray:
    return np.rint(x.astype(np.float64) * UNIT)


def _shape(word: str) -> str:
    """Letters to x or X and digits to 0, each run once; other characters stay."""
    out = []
    for c in word:
        s = ("X" if c.isupper() else "x") if c.isalpha() else "0" if c.isdigit() else c
        if not out or out[-1] != s:
            out.append(s)
    return "".join(out)


class Terms:
    """Hashed term counts of texts."""

    def __init__(self, terms: int):
        self.terms = terms
        self.known: dict[str, tuple[int, int]] = {}
        self.repeat = self._id("repeat:")

    @lru_cache(1 << 16)
    def _id(self, term: str) -> int:
        return zlib.crc32(term.encode("utf-8", "replace")) % self.terms

    def _word(self, w: str) -> tuple[int, int]:
        ids = self._id("shape:" + _shape(w)), self._id("end:" + w[-2:])
        if len(w) <= 100:  # a word can be a whole text
            self.known[w] = ids
        return ids

    def matrix(self, texts: list[str]) -> np.ndarray:
        """Square roots of relative frequencies, a row per text; rows have length 1, or 0 without words."""
        if len(self.known) > 500_000:
            self.known.clear()
        out = np.zeros((len(texts), self.terms), np.float32)
        for i, text in enumerate(texts):
            words = text.split()
            if not words:
                continue
            ids = {w: self.known.get(w) or self._word(w) for w in set(words)}
            shapes, ends = zip(*map(ids.__getitem__, words))
            row = np.bincount(np.fromiter(shapes, np.int64, len(words)), minlength=self.terms) + np.bincount(np.fromiter(ends, np.int64, len(words)), minlength=self.terms)
            row[self.repeat] += 2 * sum(map(eq, words, words[1:]))
            out[i] = np.sqrt(row / row.sum())
        return out


_TERMS: dict[int, Terms] = {}


def _terms(n: int) -> Terms:
    return _TERMS.setdefault(n, Terms(n))


@dataclass
class Model:
    terms: int
    weights: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    k: int

    def project(self, rows: np.ndarray) -> np.ndarray:
        """Unit vectors, in UNIT, of rows of term counts; the axes are in UNIT."""
        out = np.empty((len(rows), self.axes.shape[1]))
        for at in range(0, len(rows), BLOCK):
            v = np.rint(_fixed(rows[at : at + BLOCK] * self.weights) @ self.axes / UNIT)
            whole = v.astype(np.int64)
            length = np.sqrt((whole * whole).sum(1).astype(np.float64))
            out[at : at + BLOCK] = np.rint(v / np.maximum(length, 1.0)[:, None] * UNIT)
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        n = len(self.labels)
        mean = float(self.labels.mean()) if n else 0.5
        if not n:
            return np.full(len(texts), mean)
        vectors = self.project(_terms(self.terms).matrix(texts))
        out, k, place = np.empty(len(texts)), min(self.k, n), np.arange(n)
        for at in range(0, len(texts), BLOCK):
            cosines = np.rint(vectors[at : at + BLOCK] @ self.vectors.T / (UNIT * UNIT // ONE)).astype(np.int64)
            rank = cosines * n - place  # no two are equal
            near = np.argpartition(-rank, k - 1, axis=1)[:, :k]
            near = np.take_along_axis(near, np.argsort(-np.take_along_axis(rank, near, 1), axis=1), 1)
            # The eighth power and the sums step by step: a library's may differ from processor to processor.
            weight = np.maximum(np.take_along_axis(cosines, near, 1), 0) / ONE
            for _ in range(3):
                weight = weight * weight
            total, voted = np.zeros(len(near)), np.zeros(len(near))
            for j in range(k):
                total = total + weight[:, j]
                voted = voted + weight[:, j] * self.labels[near[:, j]]
            out[at : at + BLOCK] = np.where(total > 0, voted / np.maximum(total, 1e-300), mean)
        return np.clip(out, 0, 1)


def _svd(x: np.ndarray, dims: int) -> np.ndarray:
    """Right singular vectors of x by subspace iteration from a fixed start."""
    start = np.random.default_rng(0).standard_normal((x.shape[1], min(dims + 16, *x.shape))).astype(np.float32)
    q = np.linalg.qr(start)[0]
    for _ in range(6):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ vt.T)[:, :dims]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 4000, terms: int = 2048, dims: int = 48, k: int = 15) -> Model:
    """Learn from at most `sample` labelled documents. Only their term counts come to the driver."""

    def work(texts: list[str], y: list[int]) -> list:
        rows = _terms(terms).matrix(texts)
        return [y, [np.flatnonzero(r).tolist() for r in rows], [r[r > 0].tolist() for r in rows]]

    picked = training_sample(docs, labels, label, sample)
    rows = map_texts(picked, work, "doc_id long, label int, at array<int>, value array<float>", also=("label",)).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["at"], r["value"]))
    x = np.zeros((len(rows), terms), np.float32)
    for i, r in enumerate(rows):
        x[i, r["at"]] = r["value"]
    y = np.array([r["label"] for r in rows], np.float64)
    weights = np.log((1 + len(rows)) / (1 + (x > 0).sum(0))).astype(np.float32) + 1
    axes = _fixed(_svd(x * weights, dims)) if len(rows) else np.zeros((terms, 1))
    model = Model(terms, weights, axes, np.zeros((0, axes.shape[1])), y, k)
    model.vectors = model.project(x)
    return model


def quality_scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score: one row per document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, lambda texts: [shared.value.scores(texts)], "doc_id long, score double")
