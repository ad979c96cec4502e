"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Tokens are labelled from the documents' labels: in a toxic document of the training sample a token
is labelled toxic if one of its features (the word, its first 3 to 7 letters) is far more frequent
in toxic documents than in others. The field is then trained on every segment of every document of
the sample by the gradient of its exact likelihood (forward-backward), and a small logistic model
turns the marginals of a document (their greatest values and how many are expected to be toxic) into
a score. The number of labelled documents (`sample`) is the only bound.

A chain is a segment of up to `SEGMENT` tokens of one document; every token of a text is in one.
Segments are dealt out in blocks of bounded size, whatever the length of a text. In each round of training
tasks sum the gradients of their blocks, as whole numbers, so the model does not hang on how rows are dealt
out; the sum and the model have a fixed size (hashed features) and go to the driver and to the tasks.

Defined cases: null counts as empty; a text without tokens gets the score of a document without any
toxic evidence; repeated rows get equal results; without labels of both kinds all scores are 0; an
empty table gives an empty result. Labels, ids and other columns are no inputs of a score.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import append_columns, discard, map_texts, no_shuffle_files_left, staged, texts_of, training_sample

SEGMENT = 64
FEATURES = 1 << 16
PREFIXES = (3, 4, 5, 6, 7)
PER_WORD = len(PREFIXES) + 2
_EDGE = re.compile(r"^\W+|\W+$")


def word_features(word: str) -> list[int]:
    """Hashed features of a token: a bias, the word and its beginnings, without punctuation and case."""
    w = _EDGE.sub("", word).lower()
    names = ["", f"w:{w}", *(f"{n}:{w[:n]}" if len(w) >= n else "" for n in PREFIXES)]
    return [zlib.crc32(x.encode("utf-8", "replace")) % FEATURES if x else 0 for x in names]


class _Words:
    """What is known of words so far, recomputed when it grows too large."""

    def __init__(self, make, most: int = 500_000):
        self.make, self.known, self.most = make, {}, most

    def __call__(self, words: list[str]) -> list:
        if len(self.known) > self.most:
            self.known.clear()
        for w in set(words).difference(self.known):
            self.known[w] = self.make(w)
        return list(map(self.known.__getitem__, words))


def _segments(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each segment begins and how many tokens it has, for documents of these lengths laid end to end."""
    counts = -(-lengths // SEGMENT)
    number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    begins = np.repeat(np.cumsum(lengths) - lengths, counts) + number * SEGMENT
    return begins, np.minimum(SEGMENT, np.repeat(lengths, counts) - number * SEGMENT)


@dataclass
class Crf:
    """Two states; the weight of state 0 is 0 everywhere. trans[a, b]: from a to b."""

    weights: np.ndarray
    trans: np.ndarray

    def marginals(self, emission: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For a grid (place, segment): probability of state 1; forward and backward odds.

        Steps with mask false come only after a segment's end.
        """
        e, a = np.exp(np.clip(emission, -30, 30)), np.exp(self.trans)
        ahead, back = np.empty_like(e), np.empty_like(e)
        ahead[0] = e[0]
        for t in range(1, len(e)):
            ahead[t] = e[t] * (a[0, 1] + a[1, 1] * ahead[t - 1]) / (a[0, 0] + a[1, 0] * ahead[t - 1])
        back[-1] = 1
        for t in range(len(e) - 2, -1, -1):
            x = e[t + 1] * back[t + 1]
            back[t] = np.where(mask[t + 1], (a[1, 0] + a[1, 1] * x) / (a[0, 0] + a[0, 1] * x), 1)
        odds = ahead * back
        return np.where(mask, odds / (1 + odds), 0), ahead, back

    def expected(self, emission, mask, unit: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of state 1 and expected transition counts; unit: each of both as a whole number of it."""
        p, ahead, back = self.marginals(emission, mask)
        e, a = np.exp(np.clip(emission, -30, 30)), np.exp(self.trans)
        x = e[1:] * back[1:]
        w = np.stack([np.full_like(x, a[0, 0]), a[0, 1] * x, a[1, 0] * ahead[:-1], a[1, 1] * ahead[:-1] * x])
        w = w / w.sum(0) * mask[1:]
        if unit:
            p, w = np.rint(p * unit), np.rint(w * unit)
        return p, w.sum((1, 2)).reshape(2, 2)


#: Tokens of a block of training segments, about; a longer text is in several. What a token adds to a gradient is a whole
#: number of this unit, so that sums hang on no order and no dealing out.
BLOCK_TOKENS, UNIT = 1 << 16, 1 << 32


@dataclass
class Block:
    """Training tokens: features of every word, word and state of every token, and tokens of every piece of a text, end to end."""

    features: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    lengths: np.ndarray

    def gradient(self, model: Crf, side: int = 2048) -> np.ndarray:
        """What the tokens add to the gradient of the weights and, last, of the four transitions, in UNIT. side: segments of one grid."""
        begins, sizes = _segments(self.lengths)
        emission = model.weights[self.features].sum(1)[self.ids]
        error, moves = -self.labels.astype(float) * UNIT, np.zeros((2, 2))
        order = np.argsort(sizes, kind="stable")
        for at in range(0, len(order), side):  # segments of about equal length side by side
            own = order[at : at + side]
            mask = np.arange(sizes[own[-1]])[:, None] < sizes[own]
            token = np.where(mask, begins[own] + np.arange(len(mask))[:, None], 0)
            p, some = model.expected(emission[token], mask, UNIT)
            error[token[mask]] += p[mask]
            moves += some
        same = np.ones(max(0, len(self.ids) - 1), bool)
        same[begins[1:] - 1] = False
        seen = np.bincount((2 * self.labels[:-1].astype(int) + self.labels[1:])[same], minlength=4).reshape(2, 2)
        by_word = np.bincount(self.ids, error, len(self.features))
        by_feature = np.bincount(self.features.ravel(), np.repeat(by_word, PER_WORD), FEATURES)
        return np.concatenate([by_feature, (moves - seen * UNIT).ravel()]).astype(np.int64)


def train_crf(gradient: Callable[[Crf], np.ndarray], used: np.ndarray, tokens: int, rounds: int = 60, ridge: float = 1e-4) -> Crf:
    """Maximum likelihood by Adam. gradient: the sum over all blocks; used: the features that occur."""
    model = Crf(np.zeros(FEATURES), np.zeros((2, 2)))
    model.weights[word_features("")[0]] = -3.0
    m, v = np.zeros(len(used) + 4), np.zeros(len(used) + 4)
    for t in range(1, rounds + 1):
        whole = gradient(model) / UNIT / max(1, tokens)
        grad = np.concatenate([whole[used], whole[-4:]])
        grad[: len(used)] += ridge * model.weights[used] / len(used)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        step = 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        model.weights[used] -= step[:-4]
        model.trans -= step[-4:].reshape(2, 2)
    return model


@dataclass
class Model:
    crf: Crf | None
    blend: np.ndarray

    def __post_init__(self):
        self._emission = None

    def __getstate__(self):
        return {"crf": self.crf, "blend": self.blend, "_emission": None}

    def tags(self, texts: list[str]) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
        """Words of each text, where each text's begin in the marginals, and all marginals."""
        self._emission = self._emission or _Words(lambda w: float(self.crf.weights[word_features(w)].sum()))
        words = [t.split() for t in texts]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.array(self._emission([w for ws in words for w in ws]))
        begins, sizes = _segments(lengths)
        p = np.zeros(len(flat))
        if len(flat):
            mask = np.arange(sizes.max())[:, None] < sizes
            token = np.where(mask, begins + np.arange(len(mask))[:, None], 0)
            p[token[mask]] = self.crf.marginals(flat[token], mask)[0][mask]
        return words, np.append(0, np.cumsum(lengths)), p

    @staticmethod
    def evidence(p: np.ndarray) -> list[float]:
        """What a document's marginals come to: the greatest, the second, and the expected number of toxic tokens."""
        top = np.sort(np.partition(p, -2)[-2:])[::-1] if len(p) > 1 else np.append(p, [0.0, 0.0])[:2]
        return [1.0, float(top[0]), float(top[1]), float(np.log1p(p[p >= 0.1].sum()))]

    def score(self, texts: list[str]) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        """Scores, and the offending (start, end) character offsets of each text."""
        if self.crf is None:
            return np.zeros(len(texts)), [[] for _ in texts]
        words, at, p = self.tags(texts)
        scores, spans = np.empty(len(texts)), []
        for i, text in enumerate(texts):
            own = p[at[i] : at[i + 1]]
            scores[i] = 1 / (1 + np.exp(-np.clip(np.dot(self.blend, self.evidence(own)), -30, 30)))
            found: list[tuple[int, int]] = []
            if len(own) and own.max() >= 0.5:
                last = -2
                for k, m in enumerate(re.finditer(r"\S+", text)):
                    if own[k] >= 0.5:
                        if k == last + 1:
                            found[-1] = (found[-1][0], m.end())
                        else:
                            found.append(m.span())
                        last = k
            spans.append(found)
        return scores, spans


def _presence(texts: list[str]) -> list[np.ndarray]:
    make = _Words(word_features)
    return [np.unique(np.array(make(t.split()) or [[0]]).ravel()) for t in texts]


def labelled_blocks(texts: Iterator[tuple[str, int]], suspect: np.ndarray) -> Iterator[Block]:
    """All tokens of all texts (text, whether it is toxic), in blocks.

    A token of a toxic text is toxic if one of its features is suspect. A text is cut only between segments.
    """
    number: dict[str, int] = {}
    ids, labels, lengths, held = [], [], [], 0
    room = BLOCK_TOKENS // SEGMENT * SEGMENT

    def block() -> Block:
        features = np.array([word_features(w) for w in number], np.int32).reshape(-1, PER_WORD)
        own, toxic = np.concatenate(ids), np.repeat(np.array(labels) == 1, lengths)
        return Block(features, own, (suspect[features].any(1)[own] & toxic).astype(np.int8), np.array(lengths))

    for text, toxic in texts:
        words = text.split()
        for at in range(0, len(words), room):
            piece = words[at : at + room]
            ids.append(np.array([number.setdefault(w, len(number)) for w in piece], np.int32))
            labels.append(toxic)
            lengths.append(len(piece))
            held += len(piece)
            if held >= BLOCK_TOKENS:
                yield block()
                number = {}
                ids, labels, lengths, held = [], [], [], 0
    if held:
        yield block()


def _blend(rows: list[tuple[list[float], int]]) -> np.ndarray:
    """Newton steps of a ridge logistic regression of labels on evidence."""
    x, t, blend = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.zeros(4)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ blend, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(4)
        blend = blend - np.linalg.solve(h, x.T @ (p - t) + 0.1 * blend)
    return blend


def _summed(blocks: DataFrame, model: Crf) -> np.ndarray:
    """The gradient of all blocks: each task gives what is not zero of its own, and Spark adds them up."""
    shared = blocks.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FEATURES + 4, np.int64)
        for batch in batches:
            for features, ids, labels, lengths in zip(*(batch.column(c).to_pylist() for c in ("features", "ids", "labels", "lengths"))):
                total += Block(np.frombuffer(features, np.int32).reshape(-1, PER_WORD), np.frombuffer(ids, np.int32), np.frombuffer(labels, np.int8), np.frombuffer(lengths, np.int64)).gradient(shared.value)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["f", "g"])

    with no_shuffle_files_left(blocks.sparkSession):
        found = blocks.mapInArrow(run, "f int, g long").groupBy("f").agg(F.sum("g").alias("g")).toArrow()
    out = np.zeros(FEATURES + 4)
    out[found["f"].to_numpy()] = found["g"].to_numpy()
    shared.unpersist()
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = 6000, odds: float = 2.5, support: int = 4) -> Model:
    """Learn from at most `sample` labelled documents, whole ones.

    To the driver come, for each feature, how many toxic and other documents have it, the gradients of the rounds, and four
    numbers for each document of the sample.
    """
    none = Model(None, np.zeros(4))
    picked = training_sample(docs, labels, label, sample)
    have = map_texts(picked, lambda texts, y: [y, _presence(texts)], "doc_id long, y int, f array<int>", also=("label",)).select("y", F.explode("f").alias("f"))
    rows = have.groupBy("f").agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("other")).collect()
    counts = np.zeros((2, FEATURES))
    for r in rows:
        counts[:, r["f"]] = r["other"], r["toxic"]
    n = counts[:, 0]  # every document has the bias
    if not n.all():
        return none
    lift = np.log((counts[1] + 0.5) / (n[1] + 1)) - np.log((counts[0] + 0.5) / (n[0] + 1))
    suspect = (lift >= odds) & (counts[1] >= support)
    if not suspect.any():
        return none

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((t, y) for b in batches for t, y in zip(texts_of(b), b.column("label").to_pylist()))
        for b in labelled_blocks(rows, suspect):
            columns = [pa.array([x.tobytes()], pa.binary()) for x in (b.features, b.ids.astype(np.int32), b.labels, b.lengths.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([len(b.ids)])], ["features", "ids", "labels", "lengths", "tokens"])

    spark = docs.sparkSession
    made = staged(picked.select("text", "label").mapInArrow(cut, "features binary, ids binary, labels binary, lengths binary, tokens long"), "blocks")
    # All rounds read the blocks, which tasks keep; a lost one is read again from the table.
    blocks = made.repartition(spark.sparkContext.defaultParallelism).persist()
    try:
        tokens = blocks.agg(F.sum("tokens")).first()[0]
        model = Model(train_crf(lambda crf: _summed(blocks, crf), np.flatnonzero(counts.sum(0)), tokens), np.zeros(4))
    finally:
        blocks.unpersist()
    discard(made)
    shared = spark.sparkContext.broadcast(model)

    def weigh(texts: list[str], y: list[int]) -> list:
        _, ends, p = shared.value.tags(texts)
        return [y, [Model.evidence(p[a:b]) for a, b in zip(ends[:-1], ends[1:])]]

    rows = map_texts(picked, weigh, "doc_id long, y int, x array<double>", also=("label",)).select("x", "y").collect()
    model.blend = _blend(sorted((r["x"], r["y"]) for r in rows))
    return model


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, spans (start and end of each offending span, in characters): one row per document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts: list[str]) -> list:
        scores, spans = shared.value.score(texts)
        return [scores, [[{"start": a, "end": b} for a, b in s] for s in spans]]

    return map_texts(docs, work, "doc_id long, score double, spans array<struct<start:int,end:int>>")


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose score is below the threshold, with all columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    name = "__toxicity"
    while name in (c.lower() for c in docs.columns):
        name += "_"
    scored = append_columns(docs, lambda texts: [shared.value.score(texts)[0]], f"{name} double")
    return scored.where(F.col(name) < threshold).drop(name)
