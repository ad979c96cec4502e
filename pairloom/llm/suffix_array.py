"""Byte-level deduplication by suffix arrays built by two-stage sorting.

Which texts meet in one array is settled in `repeats`. A suffix array is built in two stages: the
suffixes smaller than their successors are sorted directly, by eight bytes at a time as far as
they tie; the others are induced by scanning the buckets of first bytes in order, each bucket as
whole arrays. Common prefixes of neighbours then show which windows are equal.

Sorting goes DEPTH bytes deep, which is more than a window; beyond that order is arbitrary.

Defined cases: null counts as empty; texts shorter than a window are never touched; a null doc_id
counts as greater than all others; rows that share a doc_id do not remove each other's text;
repetition inside one document stays; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pairloom.llm.repeats import WINDOW, byte_tokens, keyed, removable, runs_of, squeezed, unsqueezed, with_spans

#: Whole words of eight bytes that hold a window, and one byte more.
DEPTH = 8 * (WINDOW // 8 + 1)


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one number, zeros beyond the end, for places up to DEPTH beyond it; a view."""
    padded = np.concatenate([text, np.zeros(DEPTH + 16, np.uint8)])
    return np.ndarray(len(text) + DEPTH + 8, ">u8", padded, strides=(1,))


def _at(words: np.ndarray, places: np.ndarray) -> np.ndarray:
    return words[places].astype(np.uint64)


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; the last one is not."""
    n = len(text)
    if not n:
        return np.zeros(0, bool)
    step = np.append(np.sign(np.diff(text.astype(np.int16))), -1)
    # A run of equal bytes goes as the first byte after it.
    decides = np.where(step != 0, np.arange(n), n - 1)
    decides = np.minimum.accumulate(decides[::-1])[::-1]
    return step[decides] > 0


def _sort_directly(places: np.ndarray, words: np.ndarray) -> np.ndarray:
    key = _at(words, places)
    order = np.argsort(key)
    places, key = places[order], key[order]
    group = np.cumsum(np.append(True, key[1:] != key[:-1])) if len(places) else places
    for depth in range(8, DEPTH, 8):
        tied = np.zeros(len(places), bool)
        same = group[1:] == group[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        at = np.flatnonzero(tied)
        if not len(at):
            break
        key, own = _at(words, places[at] + depth), group[at]
        order = np.lexsort((key, own))
        places[at] = places[at][order]
        key = key[order]
        new = np.append(True, (own[1:] != own[:-1]) | (key[1:] != key[:-1]))
        # Groups are numbered anew: a tied place that begins a part of its group moves all after it up.
        starts = np.append(True, ~same)
        starts[at] |= new
        group = np.cumsum(starts)
    return places


def suffix_array(text: np.ndarray, words: np.ndarray | None = None, rising: np.ndarray | None = None, wanted: np.ndarray | None = None) -> np.ndarray:
    """Places of all suffixes of text (bytes) in order of their first DEPTH bytes.

    rising: smaller_than_next(text), if it is known. wanted: whether each suffix is to be in the array; one that is not
    rising can only be wanted with its successor.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    words = _words(text) if words is None else words
    rising = smaller_than_next(text) if rising is None else rising
    wanted = np.ones(n, bool) if wanted is None else wanted
    induced = wanted & ~rising
    direct = _sort_directly(np.flatnonzero(rising & wanted), words)
    ends = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    if induced[-1]:
        waiting[text[-1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        parts, at = waiting[c], 0
        while at < len(parts):  # in this bucket, what stands before an induced suffix may be one as well
            before = parts[at] - 1
            before = before[before >= 0]
            before = before[induced[before]]
            before = before[text[before] == c]
            if len(before):
                parts.append(before)
            at += 1
        bucket = np.concatenate([*parts, direct[ends[c] : ends[c + 1]]])
        waiting[c] = []
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[induced[before]]
        before = before[text[before] > c]
        if len(before):
            first = text[before]
            order = np.argsort(first, kind="stable")
            first, before = first[order], before[order]
            cuts = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
            for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(first)).tolist()):
                waiting[first[a]].append(before[a:b])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def common_prefixes(order: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix and the one before it in order, up to DEPTH; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    for depth in range(0, DEPTH, 8):
        differ = _at(words, order[live] + depth) ^ _at(words, order[live - 1] + depth)
        apart = differ != 0
        rest = differ[apart]
        same = np.zeros(len(rest), np.int8)
        for byte in range(1, 8):
            same += rest < np.uint64(1 << 64 - 8 * byte)
        out[live[apart]] += same
        live = live[~apart]
        out[live] += 8
    return out


def first_owners(slices: list[bytes], low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every window of every slice the least owner of a slice that has the same window, and windows per slice."""
    lengths = np.fromiter(map(len, slices), np.int64, len(slices))
    text = np.frombuffer(b"".join(slices), np.uint8)
    words, rising = _words(text), smaller_than_next(text)
    begins = np.cumsum(lengths) - lengths
    windows = lengths - WINDOW + 1
    slice_of = np.repeat(np.arange(len(slices)), lengths)
    whole = np.arange(len(text)) - begins[slice_of] < windows[slice_of]
    # Besides windows only what they are induced from is wanted: up to the next suffix that is sorted directly.
    rises = np.flatnonzero(rising)
    next_rise = np.append(rises, len(text))[np.searchsorted(rises, begins + windows - 1)]
    ends = np.zeros(len(text) + 2, np.int64)
    np.add.at(ends, begins, 1)
    np.add.at(ends, next_rise + 1, -1)
    order = suffix_array(text, words, rising, np.cumsum(ends)[: len(text)] > 0)
    order = order[whole[order]]
    first = np.flatnonzero(common_prefixes(order, words) < WINDOW)
    least = np.minimum.reduceat(low[slice_of[order]], first)
    out = np.zeros(len(text), np.int64)
    out[order] = np.repeat(least, np.diff(np.append(first, len(order))))
    return out[whole], windows


def removed_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (squeezed), starts, ends: of every document the runs of bytes to remove; null where there are none."""
    rows = keyed(docs, id_col, text_col)
    return with_spans(squeezed(rows), removable(rows, byte_tokens, first_owners))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row per document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "starts", "ends"))):
                raw, runs = unsqueezed(text), runs_of(starts, ends)
                kept, at = hashlib.sha256(), 0
                for a, b in runs:
                    kept.update(raw[at:a])
                    at = b
                kept.update(raw[at:])
                rows.append((doc, len(raw), sum(b - a for a, b in runs), len(runs), kept.hexdigest()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [*[pa.int64()] * 4, pa.string()])], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return removed_spans(docs, id_col, text_col).mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
