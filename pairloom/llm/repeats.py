"""Passages that recur across documents: the parts that byte and word substring deduplication share.

A window is `WINDOW` consecutive tokens (bytes or words) of one document. Wanted is, for every window
of every document, the smallest doc_id in which the same window starts.

1. Seeds. Each window is named by the least hash among its `GRAM`-token pieces. Equal windows have
   equal names, and neighbouring windows mostly share one, so a document gives a run of windows per
   name, about one for 18 tokens. Names travel in packed blocks, one for each map task and bucket; a
   name that a task has in several documents leaves it once. A name of one document only is done with:
   its windows recur nowhere else.
   A name with very many distinct surroundings (a line that a third of all documents have, say) is
   crowded, and the answer says so to every task that has it.
2. Slices. A run of windows whose name recurs is cut out with its tokens; of a crowded name every
   window is cut out for itself, and goes by its own content. Each map task sends each
   distinct slice once, with the least and greatest doc_id it has it from, and notes where it occurs.
3. Verdicts. All slices of a name meet in one bucket, where a verifier (a suffix array, or a table of
   windows) compares them by content and tells for each slice from which doc_id its windows come first.
4. Verdicts go back to the task that sent the slice, by its number there, and become spans of the
   documents it had it from. So a slice that very many documents share costs each task one row.

Words take steps 1 and 2 by phrases and automata instead (`phrases`).

So what is compared by content is only what may recur; the hash decides nothing but where. Texts are
read whole. doc_id null counts as greater than all others. Rows that share a doc_id do not remove
each other's text. Steps 1 and 4 end in tables in the shared folder; slices go to their verdicts as
they are cut, and what says where they occur goes along with them. Texts travel compressed. The number
of buckets and of tasks follows the bytes of the input, so what one of them holds does not grow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import discard, file_bytes, partitions_for, small_batches, staged

WINDOW, GRAM = 50, 16
LAST_ID = (1 << 63) - 1
#: Stands for "several documents" among doc_ids.
SEVERAL = -(1 << 63)
#: Names and slices that a map task gathers before it sends them.
NAMES, SLICE_BYTES = 2_000_000, 32 << 20
#: Bits of a name, and the bit that marks a crowded one.
NAME_BITS = 47
CROWDED = 1 << NAME_BITS
PACKED = (NAME_BITS + 1) // 8
#: A name is crowded of which the tasks together send more distinct slices than this, whatever the number of tasks.
SLICES_OF_NAME = 2_000

_rng = np.random.default_rng(11)
BYTE_HASHES = _rng.integers(0, 1 << 63, 256, np.uint64)
BASE, MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
#: What the first half of a piece is multiplied by as pieces double in length, and the shifts of the mixing.
POWERS, SHIFTS = [np.uint64(pow(BASE, 1 << k, 1 << 64)) for k in range(GRAM.bit_length() - 1)], (np.uint64(31), np.uint64(29))

#: Splits a text into tokens: their hashes, and cut(first, end) giving the bytes of those tokens.
Tokens = Callable[[str], tuple[np.ndarray, Callable[[int, int], bytes]]]


def byte_tokens(text: str):
    raw = text.encode("utf-8", "replace")
    return BYTE_HASHES[np.frombuffer(raw, np.uint8)], lambda a, b: raw[a:b]


#: Which bytes are between words, the same as spaces, and the last n bytes of a number of eight left out.
BETWEEN = np.isin(np.arange(256), [32, *range(9, 14)])
AS_SPACE = bytes(32 if x else k for k, x in enumerate(BETWEEN.tolist()))
LEADING = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Words of more bytes are hashed one by one.
LONG_WORD = 64


def _word_hashes(raw: bytes, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of each word, all words together, eight bytes at a time."""
    eight = np.ndarray(len(raw) + 1, "<u8", raw + bytes(8), strides=(1,))
    h = lengths.astype(np.uint64) * MIX
    live = np.arange(len(starts))
    for at in range(0, LONG_WORD, 8):
        if at:
            live = live[lengths[live] > at]
        if not len(live):
            return h
        x = h[live] ^ (eight[starts[live] + at] & LEADING[np.minimum(lengths[live] - at, 8)])
        x *= POWERS[0]
        x ^= x >> SHIFTS[0]
        h[live] = x
    live = live[lengths[live] > LONG_WORD]
    if len(live):
        from xxhash import xxh3_64_intdigest

        h[live] = [xxh3_64_intdigest(raw[a : a + n]) for a, n in zip(starts[live].tolist(), lengths[live].tolist())]
    return h


def word_tokens(text: str):
    """Words of the text; a cut has them joined by one space."""
    raw = text.encode("utf-8", "replace").translate(AS_SPACE)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = np.frombuffer(raw, np.uint8) != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    first, end = edges[::2], edges[1::2]
    hashes = _word_hashes(raw, first, end - first)
    apart = bool((first[1:] - end[:-1] > 1).any())
    first, end = first.tolist(), end.tolist()

    def cut(a: int, b: int) -> bytes:
        piece = raw[first[a] : end[b - 1]]
        return b" ".join(piece.split()) if apart else piece

    return hashes, cut


def _begins(x: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before it, the first one too; x is not empty. (np.append costs more than all of this.)"""
    new = np.empty(len(x), bool)
    new[0] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return np.flatnonzero(new)


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    have = 1
    while have < n:
        step = min(have, n - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def grams(hashes: np.ndarray) -> np.ndarray:
    """Hash of the GRAM tokens from each place on, for at least GRAM tokens."""
    h, have = hashes, 1
    for power in POWERS:
        longer = h[:-have] * power
        longer += h[have:]
        h, have = longer, 2 * have
    h ^= h >> SHIFTS[0]
    h *= MIX
    h ^= h >> SHIFTS[1]
    return h


def name_runs(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, first window, last window, hash of the ends) of every run of windows with one name."""
    if len(hashes) < WINDOW:
        return (np.zeros(0, np.int64),) * 4
    pieces = grams(hashes)
    least = _sliding_min(pieces, WINDOW - GRAM + 1)
    first = _begins(least)
    last = np.empty_like(first)
    last[:-1] = first[1:] - 1
    last[-1] = len(least) - 1
    ends = (pieces[first] * MIX ^ pieces[last + WINDOW - GRAM]).view(np.int64)
    return (least[first] & np.uint64(CROWDED - 1)).view(np.int64), first, last, ends


def _groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[int, list[list]]]:
    """(bucket, columns) of each bucket; batches come sorted by column bucket."""
    now, held = None, None
    for batch in batches:
        buckets = batch.column("bucket").to_numpy()
        cuts = [0, *(np.flatnonzero(buckets[1:] != buckets[:-1]) + 1).tolist(), len(buckets)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b == a:
                continue
            part = [batch.column(c).slice(a, b - a).to_pylist() for c in columns]
            if now == buckets[a]:
                for x, y in zip(held, part):
                    x.extend(y)
            else:
                if now is not None:
                    yield int(now), held
                now, held = buckets[a], part
    if now is not None:
        yield int(now), held


def _short(names: np.ndarray) -> bytes:
    """PACKED bytes of each name."""
    return np.ascontiguousarray(names.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :PACKED]).tobytes()


def _names(short: bytes) -> np.ndarray:
    names = np.zeros((len(short) // PACKED, 8), np.uint8)
    names[:, :PACKED] = np.frombuffer(short, np.uint8).reshape(-1, PACKED)
    return names.view("<i8").ravel()


def _pack(names: np.ndarray, docs: np.ndarray) -> bytes:
    """Pairs of names and docs, by doc: number of docs, docs, names of each, PACKED bytes of each name."""
    order = np.argsort(docs, kind="stable")
    names, docs = names[order], docs[order]
    ids, counts = np.unique(docs, return_counts=True)
    return b"".join([np.int64(len(ids)).tobytes(), ids.astype("<i8").tobytes(), counts.astype("<u4").tobytes(), _short(names)])


def _unpack(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(block, "<i8", 1)[0])
    ids, counts = np.frombuffer(block, "<i8", n, 8), np.frombuffer(block, "<u4", n, 8 + 8 * n)
    return _names(block[8 + 12 * n :]), np.repeat(ids, counts)


def dealt(df: DataFrame, tasks: int, number: Column, *then: str) -> DataFrame:
    """df by bucket and `then`, bucket k in task `number` modulo tasks: numbers in a row make tasks even, as hashes of few buckets would not."""
    return df.repartitionById(tasks, F.pmod(number, F.lit(tasks)).cast("int")).sortWithinPartitions("bucket", *then)


def numbered_by_task(column: Column, bits: int) -> Column:
    """Numbers in a row of what a task numbers in the lower bits, tasks' numbers apart by more than any common divisor."""
    return F.shiftright(column, bits) * 7919 + column.bitwiseAND((1 << bits) - 1)


def _recurring(docs: DataFrame, tokens: Tokens, tasks: int, buckets: int, crowd: int) -> DataFrame:
    """key, names: of each document the names that another document has as well (PACKED bytes each), crowded ones marked.

    A task sends its names to their buckets and is answered, bucket by bucket, which of them recur and
    which are crowded.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        names: list[np.ndarray] = []
        ends: list[np.ndarray] = []
        ids: list[int] = []
        flush_id = TaskContext.get().partitionId() << 24

        def flush():
            lengths = np.fromiter(map(len, names), np.int64, len(names))
            n, e, d = np.concatenate(names), np.concatenate(ends), np.repeat(np.array(ids, np.int64), lengths)
            for held in (names, ends, ids):
                held.clear()
            order = np.lexsort((e, n))
            n, e, d = n[order], e[order], d[order]
            begins = np.append(True, n[1:] != n[:-1])
            first = np.flatnonzero(begins)
            several = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)
            slices = np.add.reduceat(begins | np.append(True, e[1:] != e[:-1]), first, dtype=np.int64)
            known = np.repeat(several, np.diff(np.append(first, len(n))))
            out = [(flush_id % buckets, None, None, _pack(n[known], d[known]))]
            ask, owner = n[first], np.where(several, SEVERAL, d[first])
            for bucket, k in _parts(ask % buckets):
                k = k[np.argsort(owner[k], kind="stable")]
                out.append((bucket, _pack(ask[k], owner[k]), slices[k].astype("<u4").tobytes(), None))
            for at in range(0, len(out), 500):
                bucket, *blocks = zip(*out[at : at + 500])
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array([flush_id] * len(bucket), pa.int64()), *(pa.array(x, pa.binary()) for x in blocks)], ["bucket", "flush", "asked", "slices", "told"])

        total = 0
        for batch in batches:
            for doc, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                found, _, _, end = name_runs(tokens(text)[0])
                if len(found):
                    names.append(found)
                    ends.append(end)
                    ids.append(doc)
                    total += len(found)
                if total >= NAMES:
                    yield from flush()
                    flush_id, total = flush_id + 1, 0
        if names:
            yield from flush()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (flushes, asked, slices, told) in _groups(batches, ["flush", "asked", "slices", "told"]):
            out = [(f, t) for f, t in zip(flushes, told) if t is not None]
            asking = [(f, *_unpack(x), np.frombuffer(c, "<u4")) for f, x, c in zip(flushes, asked, slices) if x is not None]
            if asking:
                n, d, c = (np.concatenate([x[k] for x in asking]) for k in (1, 2, 3))
                f = np.repeat([x[0] for x in asking], [len(x[1]) for x in asking])
                order = np.argsort(n, kind="stable")
                n, d, c, f = n[order], d[order], c[order], f[order]
                first = np.flatnonzero(np.append(True, n[1:] != n[:-1]))
                asks = np.diff(np.append(first, len(n)))
                low, high = np.minimum.reduceat(d, first), np.maximum.reduceat(d, first)
                recurs = (low != high) | (low == SEVERAL)
                crowded = recurs & ((np.add.reduceat(c, first, dtype=np.int64) > crowd) | (crowd == 0))
                n = n + np.repeat(crowded, asks) * CROWDED
                # A task knows that what several of its documents have recurs, but not that it is crowded.
                hit = np.repeat(recurs, asks) & ((d != SEVERAL) | np.repeat(crowded, asks))
                out += [(flush, _pack(n[hit][k], d[hit][k])) for flush, k in _parts(f[hit])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["bucket", "told"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (told,) in _groups(batches, ["told"]):
            n, d = (np.concatenate(x) for x in zip(*map(_unpack, told)))
            crowded = n[d == SEVERAL] - CROWDED
            n, d = n[d != SEVERAL], d[d != SEVERAL]
            n = n + np.isin(n, crowded) * CROWDED
            parts = [(doc, _short(n[k])) for doc, k in _parts(d)]
            for at in range(0, len(parts), 5000):
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in parts[at : at + 5000]], pa.int64()), pa.array([x[1] for x in parts[at : at + 5000]], pa.binary())], ["key", "names"])

    sent = docs.select("key", "text").mapInArrow(send, "bucket long, flush long, asked binary, slices binary, told binary")
    answers = dealt(sent, tasks, F.col("bucket")).mapInArrow(answer, "bucket long, told binary")  # bucket: now the flush that has asked
    told = dealt(answers, tasks, numbered_by_task(F.col("bucket"), 24)).mapInArrow(gather, "key long, names binary")
    return told.groupBy("key").agg(F.collect_list("names").alias("names"))


def _parts(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(key, where it is) of each key, in order."""
    if not len(keys):
        return
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1]))
    for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(keys)).tolist()):
        yield int(keys[order[a]]), order[a:b]


SLICES = "kind int, flush long, bucket long, block binary, doc long, mark long"


@lru_cache(maxsize=None)
def _compressor(level: int):
    """One for each level and process, as making one costs as much as compressing a document's numbers."""
    from zstandard import ZstdCompressor

    return ZstdCompressor(level=level)


def _pack_slices(nos: np.ndarray, low: np.ndarray, high: np.ndarray, texts: list[bytes]) -> bytes:
    """Number of slices, their (rising) numbers as steps, least docs, how much greater the greatest are, lengths, and the slices end to end; compressed."""
    lengths = np.fromiter(map(len, texts), "<i4", len(texts))
    parts = [np.int64(len(texts)).tobytes(), np.diff(nos, prepend=0).astype("<i4").tobytes(), low.astype("<i8").tobytes(), (high - low).astype("<i8").tobytes(), lengths.tobytes(), *texts]
    return _compressor(3).compress(b"".join(parts))


def _unpack_slices(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    from zstandard import ZstdDecompressor

    raw = ZstdDecompressor().decompress(block)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    steps, low, more, lengths = (np.frombuffer(raw, t, n, at) for t, at in (("<i4", 8), ("<i8", 8 + 4 * n), ("<i8", 8 + 12 * n), ("<i4", 8 + 20 * n)))
    ends = (8 + 24 * n + np.cumsum(lengths, dtype=np.int64)).tolist()
    return np.cumsum(steps, dtype="<i4"), low, low + more, [raw[a:b] for a, b in zip([8 + 24 * n, *ends[:-1]], ends)]


def _pack_numbers(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers of one length, each as its steps; compressed."""
    parts = []
    for c in columns:
        steps = np.array(c, "<i8")
        steps[1:] -= steps[:-1].copy()
        parts.append(steps.view(np.uint8).reshape(-1, 8).T.tobytes())
    return _compressor(1).compress(b"".join(parts))


def _unpack_numbers(block: bytes, columns: int) -> list[np.ndarray]:
    from zstandard import ZstdDecompressor

    raw = np.frombuffer(ZstdDecompressor().decompress(block), np.uint8).reshape(columns, 8, -1)
    return [np.cumsum(np.ascontiguousarray(c.T).view("<i8").ravel()) for c in raw]


def squeezed(docs: DataFrame) -> DataFrame:
    """docs with texts as compressed bytes, in which they travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = _compressor(3).compress
        for batch in batches:
            texts = pa.array([compress(t.encode("utf-8", "replace")) for t in batch.column("text").to_pylist()], pa.binary())
            yield batch.set_column(batch.schema.get_field_index("text"), "text", texts)

    return docs.mapInArrow(run, ", ".join(f"{c} {'binary' if c == 'text' else kind}" for c, kind in docs.dtypes))


def unsqueezed(block: bytes) -> bytes:
    from zstandard import ZstdDecompressor

    return ZstdDecompressor().decompress(block)


class Gathered:
    """The distinct slices that a task gathers for their buckets, numbered, each with the least and the greatest doc that has it."""

    def __init__(self, flush_id: int):
        self.flush_id, self.size = flush_id, 0
        self.number: dict[bytes, int] = {}
        self.low: list[int] = []
        self.high: list[int] = []
        self.to: list[int] = []

    def rows(self, n: int, **columns) -> pa.RecordBatch:
        kinds = [("kind", pa.int32()), ("flush", pa.int64()), ("bucket", pa.int64()), ("block", pa.binary()), ("doc", pa.int64()), ("mark", pa.int64())]
        columns["flush"] = np.full(n, self.flush_id)
        return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in kinds], [k for k, _ in kinds])

    def flush(self) -> Iterator[pa.RecordBatch]:
        """The slices by bucket; then begins anew."""
        texts, where, low, high = list(self.number), np.array(self.to, np.int64), np.array(self.low, np.int64), np.array(self.high, np.int64)
        parts = list(_parts(where))
        for a in range(0, len(parts), 64):
            some = parts[a : a + 64]
            yield self.rows(len(some), kind=np.zeros(len(some)), bucket=[x for x, _ in some], block=[_pack_slices(k, low[k], high[k], [texts[i] for i in k.tolist()]) for _, k in some])
        self.__init__(self.flush_id + 1)

    def runs(self, doc: int, names: np.ndarray, first: np.ndarray, last: np.ndarray, alone: np.ndarray, piece, buckets: int) -> tuple[np.ndarray, list[int]]:
        """Add the runs of windows of a document; where each slice begins, and its number. alone: window by window."""
        from xxhash import xxh3_64_intdigest

        to = names % buckets
        if alone.any():
            # A crowded name's windows go each by its own content, so that they meet in many buckets.
            n = np.where(alone, last - first + 1, 1)
            begin = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            each = np.repeat(alone, n)
            to, last, first = np.where(each, -1, np.repeat(to, n)), np.where(each, begin, np.repeat(last, n)), begin
        nos, number, low, high, where, size = [], self.number, self.low, self.high, self.to, 0
        for bucket, a, b in zip(to.tolist(), first.tolist(), (last + WINDOW).tolist()):
            s = piece(a, b)
            if (n := number.get(s)) is None:
                n = number[s] = len(low)
                low.append(doc)
                high.append(doc)
                where.append(bucket if bucket >= 0 else xxh3_64_intdigest(s) % buckets)
                size += len(s) + 200
            elif doc < low[n]:
                low[n] = doc
            elif doc > high[n]:
                high[n] = doc
            nos.append(n)
        self.size += size
        return first, nos

    def found(self, rows: list[tuple], buckets: int) -> Iterator[pa.RecordBatch]:
        """rows: (doc, mark, at, nos) of documents."""
        if rows:
            doc, mark, at, nos = zip(*rows)
            # They only pass by the bucket, any one.
            yield self.rows(len(rows), kind=np.ones(len(rows)), bucket=np.array(doc) % buckets, doc=doc, mark=mark, block=[_pack_numbers(a, n) for a, n in zip(at, nos)])


def _slices(docs: DataFrame, recurring: DataFrame, tokens: Tokens, tasks: int, buckets: int) -> DataFrame:
    """Two kinds of rows. 0: flush, bucket, block: the distinct slices that a task has gathered for a bucket when it
    sends, each with a number and the least and greatest doc that has it. 1: flush, doc, mark, block: the windows that the
    slices of a document begin at, and their numbers. docs: squeezed."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        gathered = Gathered(TaskContext.get().partitionId() << 24)
        for batch in batches:
            rows = []
            for doc, text, mark, known in zip(*(batch.column(c).to_pylist() for c in ("doc", "text", "mark", "names"))):
                hashes, piece = tokens(unsqueezed(text).decode())
                names, first, last, _ = name_runs(hashes)
                wanted = _names(b"".join(known))
                marks = wanted >= CROWDED
                crowded = wanted[marks] - CROWDED if marks.any() else None
                wanted = np.sort(wanted & (CROWDED - 1))
                keep = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, names), len(wanted) - 1)] == names)
                if len(keep):
                    names = names[keep]
                    rows.append((doc, mark, *gathered.runs(doc, names, first[keep], last[keep], np.zeros(len(keep), bool) if crowded is None else np.isin(names, crowded), piece, buckets)))
            yield from gathered.found(rows, buckets)
            if gathered.size >= SLICE_BYTES:
                yield from gathered.flush()
        yield from gathered.flush()

    return docs.repartition(tasks, "key").join(recurring.hint("merge"), "key").select("doc", "text", "mark", "names").mapInArrow(cut, SLICES)


#: Verifier: distinct slices with the least and the greatest doc of each -> the least doc of each window, all slices'
#: windows end to end, and how many windows each slice has.
Verifier = Callable[[list[bytes], np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _verdicts(slices: DataFrame, verify: Verifier, tasks: int) -> DataFrame:
    """flush, doc, mark, block. Without a doc, the block has no, a, b, first: for slices of that flush some of whose windows start
    in an earlier document than the last that has the slice, runs [a, b) of windows and the doc they start in first. With one,
    it is what slices says of the document."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (kinds, flushes, blocks, ids, marks) in _groups(batches, ["kind", "flush", "block", "doc", "mark"]):
            passing = [(f, d, m, b) for k, f, b, d, m in zip(kinds, flushes, blocks, ids, marks) if k]
            if passing:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*passing), [*[pa.int64()] * 3, pa.binary()])], ["flush", "doc", "mark", "block"])
            flushes, blocks = [f for k, f in zip(kinds, flushes) if not k], [b for k, b in zip(kinds, blocks) if not k]
            if not blocks:
                continue
            number: dict[bytes, int] = {}
            of, nos, docs, mosts = [], [], [], []
            for block in blocks:
                no, low, high, texts = _unpack_slices(block)
                of.append(np.fromiter((number.setdefault(t, len(number)) for t in texts), np.int64, len(texts)))
                nos.append(no)
                docs.append(low)
                mosts.append(high)
            flush = np.repeat(np.array(flushes), [len(x) for x in nos])
            of, nos, docs, mosts = (np.concatenate(x) for x in (of, nos, docs, mosts))
            least, most = np.full(len(number), LAST_ID), np.full(len(number), SEVERAL)
            np.minimum.at(least, of, docs)
            np.maximum.at(most, of, mosts)
            first, n = verify(list(number), least, most)
            begin = np.cumsum(n) - n
            told = np.flatnonzero(np.minimum.reduceat(first, begin)[of] < mosts)
            if not len(told):
                continue
            # Runs of every distinct slice, then a copy of them for each slice that is told of.
            new = np.append(True, first[1:] != first[:-1])
            new[begin] = True
            start = np.flatnonzero(new)
            end = np.append(start[1:], len(first))
            owner = np.repeat(np.arange(len(n)), n)[start]
            runs = np.bincount(owner, minlength=len(n))
            at = np.cumsum(runs) - runs
            order = told[np.argsort(flush[told], kind="stable")]
            count = runs[of[order]]
            pick = np.repeat(at[of[order]] - np.cumsum(count) + count, count) + np.arange(count.sum())
            columns = [np.repeat(nos[order], count), start[pick] - begin[owner[pick]], end[pick] - begin[owner[pick]], first[start[pick]]]
            of_flush = np.repeat(flush[order], count)
            cuts = np.flatnonzero(np.append(True, of_flush[1:] != of_flush[:-1]))
            told = [_pack_numbers(*(c[x:y] for c in columns)) for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(of_flush)])]
            none = pa.nulls(len(cuts), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(of_flush[cuts]), none, none, pa.array(told, pa.binary())], ["flush", "doc", "mark", "block"])

    return dealt(slices, tasks, F.col("bucket")).mapInArrow(judge, "flush long, doc long, mark long, block binary")


def _spans(verdicts: DataFrame) -> DataFrame:
    """doc, mark, spans: what the verdicts on a flush say of its documents."""

    def one(group: pa.Table) -> pa.Table:
        out = []
        docs, marks, blocks = (group.column(c).to_pylist() for c in ("doc", "mark", "block"))
        told = [_unpack_numbers(b, 4) for d, b in zip(docs, blocks) if d is None]
        if told:
            no, a, b, first = (np.concatenate(x) for x in zip(*told))
            order = np.argsort(no, kind="stable")
            no, a, b, first = no[order], a[order], b[order], first[order]
            for doc, mark, block in zip(docs, marks, blocks):
                if doc is None:
                    continue
                at, nos = _unpack_numbers(block, 2)
                left, right = np.searchsorted(no, nos, "left"), np.searchsorted(no, nos, "right")
                n = right - left
                pick = np.repeat(left - np.cumsum(n) + n, n) + np.arange(n.sum())
                begin = np.repeat(at, n)
                early = first[pick] < doc
                if early.any():
                    start, end = (begin + a[pick])[early], (begin + b[pick] + WINDOW - 1)[early]
                    out.append((doc, mark, *_union(start, end)))
        kinds = [("doc", pa.int64()), ("mark", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))]
        return pa.table({n: pa.array([row[k] for row in out], t) for k, (n, t) in enumerate(kinds)})

    return verdicts.groupBy("flush").applyInArrow(one, "doc long, mark long, starts array<int>, ends array<int>")


def _union(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by spans; touching ones are one run."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.append(True, start[1:] > end[:-1])
    return start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, doc (never null), text (never null), mark, which tells texts of one id apart, and key, by which rows meet
    what is known of them: the id, or for rows without one a number of their text. (A clash of keys only adds names.)"""
    text = F.coalesce(F.col(text_col), F.lit(""))
    doc, mark = F.col(id_col).cast("long"), F.xxhash64(text)
    key = F.coalesce(doc, F.lit(LAST_ID) - F.pmod(mark, F.lit(1 << 40)))
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(doc, F.lit(LAST_ID)).alias("doc"), text.alias("text"), mark.alias("mark"), key.alias("key"))


def spread(docs: DataFrame) -> tuple[int, int]:
    """How many tasks and how many buckets share the work, by the bytes that docs is read from (texts are about twice that)."""
    tasks = partitions_for(2 * file_bytes(docs))
    return tasks, 4 * tasks


def judged(slices: DataFrame, verify: Verifier, tasks: int) -> DataFrame:
    """doc, mark, starts, ends, from slices, which are read once."""
    return staged(_spans(_verdicts(slices, verify, tasks)).dropDuplicates(["doc", "mark"]), "spans")


def removable(docs: DataFrame, tokens: Tokens, verify: Verifier, crowd: int = SLICES_OF_NAME) -> DataFrame:
    """doc, mark, starts, ends: of each document the runs of tokens that windows of earlier documents cover. docs: from keyed()."""
    small_batches(docs.sparkSession)
    tasks, buckets = spread(docs)
    recurring = staged(_recurring(docs, tokens, tasks, buckets, crowd), "recurring")
    out = judged(_slices(squeezed(docs.drop("doc_id")), recurring, tokens, tasks, buckets), verify, tasks)
    discard(recurring)
    return out


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs (from keyed()) with starts and ends of the spans of each, null where there are none."""
    tasks, _ = spread(docs)
    return docs.repartition(tasks, "doc", "mark").join(spans.hint("merge"), ["doc", "mark"], "left").select("doc_id", "text", "starts", "ends")


def runs_of(starts: list[int] | None, ends: list[int] | None) -> list[tuple[int, int]]:
    return list(zip(starts or (), ends or ()))
