import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.llm import phrases, repeats, suffix_array
from pairloom.llm.common import PARTITION_BYTES, file_bytes
from pairloom.llm.phrases import phrase_dedup
from pairloom.llm.repeats import keyed, spread
from pairloom.llm.suffix_array import suffix_dedup


def removed_by_hand(rows, tokens):
    first = {}
    sequences = [(i if i is not None else 1 << 63, tokens(t or "")) for i, t in rows]
    for i, s in sequences:
        for p in range(len(s) - 49):
            k = tuple(s[p : p + 50])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, s in sequences:
        gone = np.zeros(len(s), bool)
        for p in range(len(s) - 49):
            if first[tuple(s[p : p + 50])] < i:
                gone[p : p + 50] = True
        out.append(gone)
    return out


@pytest.fixture(scope="module")
def small_odd(odd):
    rows = [(i, t if t is None or len(t) < 2000 else t[:1500]) for i, t in odd]
    return rows + [(12, "ab" * 300), (13, "z" + "ab" * 80 + "q" * 60), (14, "q" * 49), (15, "q" * 50), (16, "\x00" * 60), (17, "x\x00" * 5 + "\x00" * 55)]


@pytest.mark.parametrize("data", ["prose", "small_odd"])
def test_bytes(make_docs, data, request):
    rows = request.getfixturevalue(data)
    want = []
    for (i, t), gone in zip(rows, removed_by_hand(rows, lambda t: t.encode())):
        kept = np.frombuffer((t or "").encode(), np.uint8)[~gone].tobytes()
        want.append((i, len(gone), int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    got = [tuple(r) for r in suffix_array.suffix_dedup(make_docs(rows, clashes=True)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("data", ["prose", "small_odd"])
def test_words(make_docs, data, request):
    rows = request.getfixturevalue(data)
    if data == "small_odd":
        rows = rows + [(20, "r " * 120), (21, "r " * 60 + "s"), (22, "r " * 49), (23, "  é " * 60), (24, "x   é " * 60)]
    want = []
    for (i, t), gone in zip(rows, removed_by_hand(rows, lambda t: t.encode().split())):
        kept = b" ".join(w for w, g in zip((t or "").encode().split(), gone) if not g)
        want.append((i, len(gone), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    got = [tuple(r) for r in phrases.phrase_dedup(make_docs(rows, clashes=True)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_long_texts(make_docs, odd):
    """Two equal texts of 60 000 words, and one byte 70 000 times."""
    rows = {r.doc_id: r for r in suffix_array.suffix_dedup(make_docs(odd)).collect() if r.doc_id in (5, 6, 7)}
    assert rows[7].n_removed == rows[7].n_bytes == rows[6].n_bytes and rows[6].n_removed == 0 == rows[5].n_removed
    rows = {r.doc_id: r for r in phrases.phrase_dedup(make_docs(odd)).collect() if r.doc_id in (6, 7)}
    assert rows[7].n_removed == rows[7].n_words == 60_000 and rows[6].n_removed == 0


def test_long_texts_are_shards_of_their_own(make_docs, prose, monkeypatch):
    """Texts on either side of the length share passages with each other."""
    plain = sorted(map(tuple, phrase_dedup(make_docs(prose)).collect()))
    monkeypatch.setattr(phrases, "LONG_TEXT", 700)
    rows = phrases.sharded(keyed(make_docs(prose))).collect()
    assert {r.shard < 0 for r in rows if len(r.text.encode()) >= 700} == {True} and {r.shard < 0 for r in rows if len(r.text.encode()) < 700} == {False}
    assert len({r.shard for r in rows if r.shard < 0}) == sum(len(t.encode()) >= 700 for _, t in prose)
    assert sorted(map(tuple, phrase_dedup(make_docs(prose)).collect())) == plain


def test_a_source_without_statistics(spark, make_docs, prose):
    """Rows that no file tells the size of are counted, so work is spread by their bytes."""
    docs = make_docs(prose)
    bare = spark.createDataFrame(docs.rdd.repartition(2), docs.schema)
    leaves = bare._jdf.queryExecution().optimizedPlan().collectLeaves()
    assert int(str(leaves.apply(0).stats().sizeInBytes())) >= 1 << 60
    size = sum(len(t.encode()) for _, t in prose)
    assert size / 2 <= file_bytes(bare) <= size
    wide = bare.withColumn("text", F.repeat("text", 400)).repartition(2)
    assert spread(wide)[0] >= size * 400 // PARTITION_BYTES > 1
    for dedup in (suffix_dedup, phrase_dedup):
        assert sorted(map(tuple, dedup(bare).collect())) == sorted(map(tuple, dedup(docs).collect()))


def test_tasks_do_not_matter(make_docs, prose):
    rows = [tuple(r) for r in suffix_array.suffix_dedup(make_docs(prose)).collect()]
    wide = [tuple(r) for r in suffix_array.suffix_dedup(make_docs(prose).repartition(9)).collect()]
    assert sorted(rows) == sorted(wide)


@pytest.mark.parametrize("tokens", ["bytes", "words"])
@pytest.mark.parametrize("crowd", [0, 40])
def test_crowded_names(make_docs, tokens, crowd):
    """A passage in many different surroundings; crowd 0 makes every name crowded, 40 that passage's ends."""
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    line = " ".join(word() for _ in range(60))
    rows = [(k, " ".join([*(word() for _ in range(60)), line, *(word() for _ in range(60))])) for k in range(120)]
    docs = make_docs(rows).coalesce(2)
    if tokens == "bytes":
        found = repeats.removable(repeats.keyed(docs), repeats.byte_tokens, suffix_array.first_owners, crowd).withColumnRenamed("doc", "doc_id")
    else:
        found = phrases.removed_word_spans(docs, crowd=crowd)
    spans = {r.doc_id: list(zip(r.starts or (), r.ends or ())) for r in found.collect()}
    units = (lambda t: t.encode()) if tokens == "bytes" else (lambda t: t.split(" "))
    for (k, t), gone in zip(rows, removed_by_hand(rows, units)):
        got = np.zeros(len(units(t)), bool)
        for a, b in spans.get(k, []):
            got[a:b] = True
        assert (got == gone).all()
        assert k == 0 or gone.any()


def test_many_rows_without_an_id(make_docs, prose):
    """They count as one document after all others: they lose what others have, and nothing to each other."""
    rows = prose[:20] + [(None, t) for _, t in prose[:20]] + [(None, " ".join(f"only{k % 61}" for k in range(90)))] * 30
    for run, units, n in ((suffix_array.suffix_dedup, lambda t: t.encode(), "n_bytes"), (phrases.phrase_dedup, lambda t: t.split(), "n_words")):
        want = sorted((str(i), len(gone), int(gone.sum())) for (i, _), gone in zip(rows, removed_by_hand(rows, units)))
        assert sorted((str(r.doc_id), r[n], r.n_removed) for r in run(make_docs(rows)).collect()) == want
    keys = {r["key"] for r in repeats.keyed(make_docs(rows)).where("doc_id is null").collect()}
    assert len(keys) == 21


def test_empty(make_docs):
    empty = make_docs([(1, "a")]).limit(0)
    assert suffix_array.suffix_dedup(empty).count() == 0 and phrases.phrase_dedup(empty).count() == 0


@pytest.mark.parametrize("alphabet", [b"a", b"ab", b"abcd", bytes(range(256))])
def test_suffix_array(alphabet):
    rng = np.random.default_rng(len(alphabet))
    for n in (1, 2, 3, 60, 800):
        text = rng.choice(np.frombuffer(alphabet, np.uint8), n)
        order = suffix_array.suffix_array(text)
        assert sorted(order.tolist()) == list(range(n))
        padded = text.tobytes() + b"\0" * 80
        assert [padded[i : i + 56] for i in order] == sorted(padded[i : i + 56] for i in range(n))
        common = suffix_array.common_prefixes(order, suffix_array._words(text))
        for k in range(1, n):
            a, b = padded[order[k - 1] : order[k - 1] + 56], padded[order[k] : order[k] + 56]
            assert common[k] == next((j for j in range(56) if a[j] != b[j]), 56)
        raw = text.tobytes()
        assert suffix_array.smaller_than_next(text).tolist() == [raw[k:] < raw[k + 1 :] for k in range(n)]


def test_names_depend_on_the_window_alone():
    rng = np.random.default_rng(0)
    shared = rng.integers(0, 1 << 63, 80, np.uint64)
    names = []
    for _ in range(2):
        own = np.concatenate([rng.integers(0, 1 << 63, rng.integers(5, 90), np.uint64), shared, rng.integers(0, 1 << 63, 30, np.uint64)])
        name, first, last, _ = repeats.name_runs(own)
        at = len(own) - 30 - 80
        each = np.repeat(name, last - first + 1)
        names.append(each[at : at + 31].tolist())
    assert names[0] == names[1]


def test_automata_find_whole_words():
    phrase = lambda *w: b" ".join([*w, *[b"x"] * (repeats.GRAM - len(w))])
    machine = phrases.Automata([phrase(b"a", b"b"), phrase(b"b", b"c")], most=1)
    assert len(machine.machines) == 2
    words = [b"x", b"a", b"b", *[b"x"] * 14, b"y", b"b", b"c", *[b"x"] * 20]
    at, which = machine.occurrences(words)
    assert sorted(zip(at, which)) == [(1, 0), (18, 1)]
    assert machine.occurrences([b"xa", b"b", *[b"x"] * 14]) == ([], [])


def test_words_are_found_by_the_automata_alone(make_docs, prose, monkeypatch):
    """Without occurrences nothing is removed; with them what a plain search removes is."""
    docs = make_docs(prose)
    rows = keyed_shards(docs)
    told = phrases._confirmed(rows, 2, 8, repeats.SLICES_OF_NAME).collect()
    assert told
    blocks = [phrases._unpack(r.block) for r in told]
    texts = {}
    for i, t in prose:
        texts.setdefault(i, []).append(f" {' '.join(t.split())} ")
    for p in {p for b in blocks for p in b[3]}:
        assert sum(any(f" {p.decode()} " in t for t in ts) for ts in texts.values()) > 1
    slices = phrases._located(rows, rows.sparkSession.createDataFrame([], "shard long, block binary"), 2, 8)
    assert slices.where("kind = 1").count() == 0 and phrases._located(rows, rows.sparkSession.createDataFrame(told), 2, 8).where("kind = 1").count() > 0


def keyed_shards(docs):
    from pyspark.sql import functions as F

    return repeats.keyed(docs.coalesce(1)).withColumn("shard", F.lit(0).cast("long"))


def test_slices_are_no_table_and_texts_travel_compressed(make_docs, prose, monkeypatch):
    """Slices went to disk as a table and as a shuffle, and texts travelled as they are."""
    written, cut = [], []
    staged, verdicts = repeats.staged, repeats._verdicts
    monkeypatch.setattr(repeats, "staged", lambda df, name, *more: written.append(name) or staged(df, name, *more))
    monkeypatch.setattr(repeats, "_verdicts", lambda slices, *more: cut.append(slices) or verdicts(slices, *more))
    rows = suffix_array.removed_spans(make_docs(prose))
    assert written == ["recurring", "spans"] and len(cut) == 1
    assert dict(rows.dtypes)["text"] == "binary"
    assert {r.doc_id: repeats.unsqueezed(r.text).decode() for r in rows.collect()} == {i: t or "" for i, t in prose}


def test_packed_slices_and_numbers():
    nos, low, high = np.array([0, 3, 4]), np.array([-(1 << 63), 5, 7]), np.array([(1 << 63) - 1, 5, 9])
    got = repeats._unpack_slices(repeats._pack_slices(nos, low, high, [b"a", b"", b"bcd"]))
    assert [x.tolist() for x in got[:3]] == [nos.tolist(), low.tolist(), high.tolist()] and got[3] == [b"a", b"", b"bcd"]
    for columns in ([[5, 1, -(1 << 63)], [(1 << 63) - 1, 0, -2]], [[], []]):
        assert [x.tolist() for x in repeats._unpack_numbers(repeats._pack_numbers(*map(np.array, columns)), 2)] == columns
    assert repeats._names(repeats._short(np.array([1, repeats.CROWDED + 2]))).tolist() == [1, repeats.CROWDED + 2]


def test_one_compressor_for_many_documents(monkeypatch):
    """Making a compressor costs as much as packing the numbers of a document, so a process makes one for each level."""
    import zstandard

    made, real = [], zstandard.ZstdCompressor
    monkeypatch.setattr(zstandard, "ZstdCompressor", lambda **how: made.append(how) or real(**how))
    rng = np.random.default_rng(5)
    for n in range(60):
        columns = [rng.integers(-5, 1 << 40, n) for _ in range(2)]
        assert [x.tolist() for x in repeats._unpack_numbers(repeats._pack_numbers(*columns), 2)] == [c.tolist() for c in columns]
    assert len(made) <= 1


def test_gathered_numbers_and_extremes():
    """A slice that several documents have keeps its number and takes their least and greatest, in whatever order they come."""
    gathered, text = repeats.Gathered(0), bytes(range(120))
    at, last = np.array([0, 10]), np.array([9, 20])
    for doc in (5, 9, 2):
        first, nos = gathered.runs(doc, np.array([7, 8]), at, last, np.zeros(2, bool), lambda a, b: text[a:b], 4)
        assert nos == [0, 1] and first.tolist() == [0, 10]
    assert gathered.low == [2, 2] and gathered.high == [9, 9] and gathered.to == [3, 0] and gathered.size == 59 + 60 + 400


def test_words_without_a_table_of_words():
    """Words, joined by one space, and hashes that tell them apart and are equal for equal words, wherever they stand."""
    rng = np.random.default_rng(8)
    letters = ["a", "b", "\x01", "\xe9", "\u3000", "\x85", "\x1c"]
    words = sorted({"".join(rng.choice(letters, rng.integers(1, n))) for n in (2, 4, 9, 10, 18, 66, 70, 300) for _ in range(60)})
    seen = {}
    for gap in (" ", "\n\n", "\t \x0b\x0c\r"):
        order = rng.permutation(len(words))
        text = gap.join(["", *(words[k] for k in order), ""])
        hashes, cut = repeats.word_tokens(text)
        own = text.encode().split()
        assert len(hashes) == len(own) == len(words) and hashes.dtype == np.uint64
        assert [cut(k, k + 5) for k in range(0, 300, 7)] == [b" ".join(own[k : k + 5]) for k in range(0, 300, 7)]
        for w, h in zip(own, hashes.tolist()):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(words) and not hasattr(repeats, "_WORDS")
    assert [len(repeats.word_tokens(t)[0]) for t in ("", " \n", "x", " x")] == [0, 0, 1, 1]
