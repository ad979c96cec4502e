"""Word-level substring deduplication by automata of repeated phrases.

A phrase is GRAM words; a document offers, for every window of WINDOW words, the phrase of least hash
in it, which is one for about 18 words.

1. Confirm. Documents are dealt to shards of up to SHARD_ROWS short texts; a long text is a shard of its own. A shard sends its phrases, each
   once, to the buckets of their names, where phrases meet by content. Those that occur in more than
   one document are confirmed and told to every shard that has sent them.
2. Compile. A shard's confirmed phrases become Aho-Corasick automata (pyahocorasick) of at most
   SHARD_PHRASES phrases, over words coded as three letters each.
3. Stream. Every document of the shard runs through its automata whole, which locate every occurrence
   of a phrase. A window that recurs anywhere holds a confirmed phrase, so windows without an
   occurrence are done with. The others are cut out as runs of windows with the same least phrase.
4. Decide. Runs go to the bucket of that phrase, where every window is looked up by its whole content
   for the first document it starts in (`repeats`, steps 3 and 4).

Defined cases: null counts as having no words; texts with fewer words than a window are never
touched; a null doc_id counts as greater than all others; rows that share a doc_id do not remove
each other's text; repetition inside one document stays; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import discard, small_batches, staged
from pairloom.llm.repeats import CROWDED, GRAM, SEVERAL, SLICE_BYTES, SLICES, SLICES_OF_NAME, WINDOW, Gathered, _begins, _groups, _parts, _sliding_min, dealt, grams, judged, keyed, numbered_by_task, runs_of, spread, with_spans, word_tokens

#: Rows of a shard of documents, at most, and phrases of one automaton.
SHARD_ROWS, SHARD_PHRASES = 1024, 20_000
#: Bytes from which a document is a shard of its own, so that a shard's texts come to SHARD_ROWS times as many at most, or to one text.
LONG_TEXT = 1 << 15
#: No phrase begins here.
NOWHERE = np.uint64((1 << 64) - 1)
#: Values that the first and second letter of a word's code can have.
BASE = 32


def offered(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, hash of the ends) of the least phrase of every run of windows that share it."""
    if len(hashes) < WINDOW:
        return (np.zeros(0, np.uint64),) * 3
    pieces, width = grams(hashes), WINDOW - GRAM + 1
    least = _sliding_min(pieces, width)
    first = _begins(least)
    last = np.append(first[1:], len(least)) - 1
    place = first + pieces[first[:, None] + np.arange(width)].argmin(1)
    return least[first], place, pieces[first] * np.uint64(BASE + 1) ^ pieces[last + WINDOW - GRAM]


def _pack(hashes: np.ndarray, owners: np.ndarray, counts: np.ndarray, phrases: list[bytes]) -> bytes:
    """Number of phrases, their hashes, owners, numbers of surroundings, lengths, and the phrases end to end; compressed."""
    from zstandard import ZstdCompressor

    lengths = np.fromiter(map(len, phrases), "<i4", len(phrases))
    parts = [np.int64(len(phrases)).tobytes(), hashes.astype("<u8").tobytes(), owners.astype("<i8").tobytes(), counts.astype("<i4").tobytes(), lengths.tobytes(), *phrases]
    return ZstdCompressor(level=1).compress(b"".join(parts))


def _unpack(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    from zstandard import ZstdDecompressor

    raw = ZstdDecompressor().decompress(block)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    hashes, owners, counts, lengths = (np.frombuffer(raw, t, n, 8 + at * n) for t, at in (("<u8", 0), ("<i8", 8), ("<i4", 16), ("<i4", 20)))
    ends = (8 + 24 * n + np.cumsum(lengths, dtype=np.int64)).tolist()
    return hashes, owners, counts, [raw[a:b] for a, b in zip([8 + 24 * n, *ends[:-1]], ends)]


class Offer:
    """The phrases of a shard, numbered by content."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.hashes: list[int] = []
        self.ids: list[int] = []
        self.ends: list[np.ndarray] = []
        self.keys: list[int] = []
        self.lengths: list[int] = []

    def add(self, key: int, text: str) -> None:
        hashes, cut = word_tokens(text)
        least, place, ends = offered(hashes)
        if len(least):
            for h, p in zip(least.tolist(), place.tolist()):
                phrase = cut(p, p + GRAM)
                if (n := self.number.get(phrase)) is None:
                    n = self.number[phrase] = len(self.hashes)
                    self.hashes.append(h)
                self.ids.append(n)
            self.ends.append(ends)
            self.keys.append(key)
            self.lengths.append(len(least))

    def blocks(self, buckets: int) -> Iterator[tuple[int, bytes]]:
        """(bucket, packed phrases): the document of each or SEVERAL, and how many surroundings it has here."""
        if not self.ids:
            return
        ids, keys, ends = np.array(self.ids), np.repeat(np.array(self.keys, np.int64), self.lengths), np.concatenate(self.ends)
        order = np.lexsort((ends, ids))
        ids, keys, ends = ids[order], keys[order], ends[order]
        begins = np.append(True, ids[1:] != ids[:-1])
        first = np.flatnonzero(begins)
        low, high = np.minimum.reduceat(keys, first), np.maximum.reduceat(keys, first)
        counts = np.add.reduceat(begins | np.append(True, ends[1:] != ends[:-1]), first, dtype=np.int64)
        hashes, phrases = np.array(self.hashes, np.uint64), list(self.number)
        owners = np.where(low != high, SEVERAL, low)
        for bucket, k in _parts((hashes % np.uint64(buckets)).astype(np.int64)):
            yield bucket, _pack(hashes[k], owners[k], counts[k], [phrases[i] for i in k.tolist()])


def _confirmed(docs: DataFrame, tasks: int, buckets: int, crowd: int) -> DataFrame:
    """shard, block: of each shard the packed phrases that another document has as well; owner 1 marks crowded ones."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, offer = None, Offer()

        def told(shard: int | None, offer: Offer) -> Iterator[pa.RecordBatch]:
            out = list(offer.blocks(buckets))
            for at in range(0, len(out), 500):
                bucket, block = zip(*out[at : at + 500])
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array([shard] * len(bucket), pa.int64()), pa.array(block, pa.binary())], ["bucket", "shard", "block"])

        for batch in batches:
            for shard, key, text in zip(*(batch.column(c).to_pylist() for c in ("shard", "key", "text"))):
                if shard < 0:
                    alone = Offer()
                    alone.add(key, text)
                    yield from told(shard, alone)
                    continue
                if shard != now:
                    yield from told(now, offer)
                    now, offer = shard, Offer()
                offer.add(key, text)
        yield from told(now, offer)

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (shards, blocks) in _groups(batches, ["shard", "block"]):
            number: dict[bytes, int] = {}
            sent = [_unpack(b) for b in blocks]
            of = [np.fromiter((number.setdefault(p, len(number)) for p in x[3]), np.int64, len(x[3])) for x in sent]
            ids, owners, counts = np.concatenate(of), np.concatenate([x[1] for x in sent]), np.concatenate([x[2] for x in sent])
            low, high, total = np.full(len(number), (1 << 63) - 1), np.full(len(number), SEVERAL), np.zeros(len(number), np.int64)
            np.minimum.at(low, ids, owners)
            np.maximum.at(high, ids, owners)
            np.add.at(total, ids, counts)
            recurs = (low != high) | (low == SEVERAL)
            crowded = (total > crowd) | (crowd == 0)
            out: dict[int, list] = {}
            for shard, k, x in zip(shards, of, sent):
                hit = np.flatnonzero(recurs[k])
                if len(hit):
                    out.setdefault(shard, []).append((x[0][hit], crowded[k[hit]], x[2][hit], [x[3][i] for i in hit.tolist()]))
            rows = [(shard, _pack(*(np.concatenate([x[c] for x in parts]) for c in range(3)), [p for x in parts for p in x[3]])) for shard, parts in out.items()]
            if rows:
                shard, block = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(block, pa.binary())], ["shard", "block"])

    sent = docs.select("shard", "key", "text").mapInArrow(send, "bucket long, shard long, block binary")
    return dealt(sent, tasks, F.col("bucket")).mapInArrow(confirm, "shard long, block binary")


class Automata:
    """Finds confirmed phrases in sequences of words."""

    def __init__(self, phrases: list[bytes], most: int = SHARD_PHRASES):
        import ahocorasick

        self.codes: dict[bytes, str] = {}
        coded = ["".join([self._code(w) for w in p.split(b" ")]) for p in phrases]
        self.none = self._letters(len(self.codes))  # a code that no phrase has
        self.machines = []
        for at in range(0, len(coded), most):
            machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for k, p in enumerate(coded[at : at + most], at):
                machine.add_word(p, k)
            machine.make_automaton()
            self.machines.append(machine)

    @staticmethod
    def _letters(n: int) -> str:
        # Letters of the three places are different, so that a phrase is found at a word's beginning only.
        return chr(0x100 + n % BASE) + chr(0x200 + n // BASE % BASE) + chr(0x10000 + n // BASE // BASE)

    def _code(self, word: bytes) -> str:
        if (code := self.codes.get(word)) is None:
            code = self.codes[word] = self._letters(len(self.codes))
        return code

    def occurrences(self, words: list[bytes]) -> tuple[list[int], list[int]]:
        """The first word of every occurrence of a phrase, and which phrase it is."""
        get, none = self.codes.get, self.none
        text = "".join([get(w, none) for w in words])
        at, which = [], []
        for machine in self.machines:
            for end, k in machine.iter(text):
                at.append(end // 3 - GRAM + 1)
                which.append(k)
        return at, which


def _located(docs: DataFrame, confirmed: DataFrame, tasks: int, buckets: int) -> DataFrame:
    """The windows of every document around the phrases that automata find in it, as in repeats._slices."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        gathered = Gathered(TaskContext.get().partitionId() << 24)
        now, blocks, automata = None, [], None
        hashes = crowded = np.zeros(0, np.uint64)
        for batch in batches:
            rows = []
            for shard, block, doc, mark, text in zip(*(batch.column(c).to_pylist() for c in ("shard", "block", "doc", "mark", "text"))):
                if shard != now:
                    now, blocks, automata = shard, [], None
                if block is not None:
                    blocks.append(block)
                    continue
                if not blocks:
                    continue
                if automata is None:
                    told = [_unpack(b) for b in blocks]
                    hashes = np.concatenate([x[0] for x in told])
                    crowded = np.unique(hashes[np.concatenate([x[1] for x in told]) == 1])
                    automata = Automata([p for x in told for p in x[3]])
                words = text.encode("utf-8", "replace").split()
                if len(words) < WINDOW:
                    continue
                at, which = automata.occurrences(words)
                if at:
                    least = np.full(len(words) - GRAM + 1, NOWHERE)
                    least[at] = hashes[which]
                    least = _sliding_min(least, WINDOW - GRAM + 1)
                    first = _begins(least)
                    last = np.append(first[1:], len(least)) - 1
                    held = least[first] != NOWHERE
                    first, last = first[held], last[held]
                    if len(first):
                        name = least[first]
                        rows.append((doc, mark, *gathered.runs(doc, (name & np.uint64(CROWDED - 1)).view(np.int64), first, last, np.isin(name, crowded) if len(crowded) else np.zeros(len(name), bool), lambda a, b: b" ".join(words[a:b]), buckets)))
            yield from gathered.found(rows, buckets)
            if gathered.size >= SLICE_BYTES:
                yield from gathered.flush()
        yield from gathered.flush()

    none = lambda kind: F.lit(None).cast(kind)
    told = confirmed.select("shard", F.lit(0).alias("kind"), "block", none("long").alias("doc"), none("long").alias("mark"), none("string").alias("text"))
    texts = docs.select("shard", F.lit(1).alias("kind"), none("binary").alias("block"), "doc", "mark", "text")
    # Shards of short texts are numbered within the partitions they come from, long texts lie anywhere.
    number = F.when(F.col("shard") < 0, F.xxhash64("shard")).otherwise(numbered_by_task(F.col("shard"), 33 - SHARD_ROWS.bit_length() + 1))
    both = dealt(told.unionByName(texts).withColumn("bucket", F.col("shard")), tasks, number, "kind")
    return both.drop("kind", "bucket").mapInArrow(stream, SLICES)


def first_owners(pieces: list[bytes], low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every window of every piece the least owner of a piece that has the same window, and windows per piece."""
    number: dict[bytes, int] = {}
    of, lengths = [], []
    for piece in pieces:
        spaces = [-1, *np.flatnonzero(np.frombuffer(piece, np.uint8) == 32).tolist(), len(piece)]
        n = len(spaces) - WINDOW
        lengths.append(n)
        of += [number.setdefault(piece[spaces[w] + 1 : spaces[w + WINDOW]], len(number)) for w in range(n)]
    lengths = np.array(lengths, np.int64)
    first = np.full(len(number), (1 << 63) - 1)
    np.minimum.at(first, of, np.repeat(low, lengths))
    return first[of], lengths


def sharded(docs: DataFrame) -> DataFrame:
    """docs with shard: up to SHARD_ROWS short texts that lie side by side, or one long text."""
    place = F.monotonically_increasing_id()
    alone = F.octet_length("text") >= LONG_TEXT
    return docs.withColumn("_place", place).withColumn("shard", F.when(alone, -1 - F.col("_place")).otherwise(F.floor(F.col("_place") / SHARD_ROWS))).drop("_place")


def removed_word_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = SLICES_OF_NAME) -> DataFrame:
    """doc_id, text, starts, ends: of every document the runs of words to remove; null where there are none."""
    small_batches(docs.sparkSession)
    tasks, buckets = spread(docs)
    rows = staged(sharded(keyed(docs, id_col, text_col)), "sharded")
    confirmed = staged(_confirmed(rows, tasks, buckets, crowd), "confirmed")
    spans = judged(_located(rows, confirmed, tasks, buckets), first_owners, tasks)
    discard(confirmed)
    return with_spans(rows, spans)


def phrase_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: one row per document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "starts", "ends"))):
                words, runs = text.encode("utf-8", "replace").split(), runs_of(starts, ends)
                kept, at = [], 0
                for a, b in runs:
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                rows.append((doc, len(words), sum(b - a for a, b in runs), hashlib.sha256(b" ".join(kept)).hexdigest()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [*[pa.int64()] * 3, pa.string()])], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return removed_word_spans(docs, id_col, text_col).mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string")
