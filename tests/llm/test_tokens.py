import random

import pytest

from pairloom.llm import token_counts as tc


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tc.vocabulary())


def test_counts_like_the_library(library, prose, odd):
    rng = random.Random(1)
    bits = [*"aàrestlvdm'''' \n\t\r 019½٣.,!?$日本é̀  　​🎉_-", "<|endoftext|>", "<|endof", "'re", "'ll", "'S", "  ", "\n\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(6000)]
    texts += [t or "" for _, t in prose + odd] + ["'r", "x'", "'l", "don't", "9's", "a 's", "!'s", "\n's", "''ve", " " * 1000 + "x", "a" * 3000, "<|endoftext|>" * 3]
    counter = tc.counter(tc.vocabulary())
    got = [n for k in range(0, len(texts), 500) for n in counter.counts(texts[k : k + 500]).tolist()]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [(t, g, w) for t, g, w in zip(texts, got, want) if g != w] == []


def test_small_bounds_change_nothing(prose, odd):
    """Compiling anew, in the middle of a pretoken too, gives the same counts."""
    texts = [t or "" for _, t in prose[:30] + odd] + ["ab" * 2000, "x" * 5000 + "yz" * 700]
    want = tc.counter(tc.vocabulary()).counts(texts)
    small = tc.TokenCounter(tc.vocabulary(), most_letters=50)
    small.merger.most_states, small.merger.most_pairs = 20, 10
    assert (small.counts(texts) == want).all() and (small.counts(texts[::-1]) == want[::-1]).all()
    assert len(small.merger.states) <= 60 and len(small.merger.pairs) <= 10
    assert max(map(len, small.words)) <= tc.LONG


def test_several_special_strings(tmp_path):
    """The longest of those that begin at a place counts."""
    import json

    spec = json.load(open(tc.vocabulary(), encoding="utf-8"))
    spec["added_tokens"] = [{"content": "<a"}, {"content": "<a>"}, {"content": "|"}]
    path = tmp_path / "v.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    assert tc.TokenCounter(str(path))._parts("x<a>y|<a") == ["x", "y", "", ""]


def test_chunks_and_scan_agree():
    text = "it's  a test \n\n of 123 we'll 'r ''  x" * 40
    base = tc.Splitter(chunk=10_000)
    kinds = base.classes(text + "\n")
    kinds[-1] = tc.CLASSES.index("end")
    for chunk in (1, 2, 7, 64):
        assert (tc.Splitter(chunk).starts(kinds) == base.starts(kinds)).all()


def test_composition_is_associative():
    import numpy as np

    maps = np.random.default_rng(0).integers(0, len(tc.STATES), (9, len(tc.STATES)))
    got, state = tc.Splitter._scan(maps), np.arange(len(tc.STATES))
    for k in range(9):
        state = maps[k][state]
        assert (got[k] == state).all()


def test_states_are_dropped_and_compiled_anew(library):
    small = tc.TokenCounter(tc.vocabulary(), most_letters=10)
    small.merger.most_states = 50
    words = [f"word{k}ing" for k in range(300)]
    for k in range(0, 300, 20):
        part = words[k : k + 20]
        assert small.counts(part).tolist() == [len(e.ids) for e in library.encode_batch(part)]


def test_query_rows(make_docs, odd):
    docs = make_docs(odd, clashes=True)
    rows = tc.token_counts(docs).collect()
    assert len(rows) == len(odd)
    assert sorted(r.n_bytes for r in rows) == sorted(len((t or "").encode()) for _, t in odd)
    assert all(r.over_limit == (r.n_tokens > 512) for r in rows) and any(r.over_limit for r in rows)
    assert tc.token_counts(docs.limit(0)).count() == 0
