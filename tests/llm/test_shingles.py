"""Near-duplicates by shingle similarity against brute force over all pairs."""

import random

import pytest

import corpus_pipeline
from pairloom.llm import shingles


def kept_by_hand(rows, similarity=0.8, k=5):
    """The ids that stay, of rows whose ids are all different and not null."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        n = min(k, len(w))
        sets.append({b" ".join(w[a : a + n]) for a in range(len(w) - n + 1)} if w else set())
    label = list(range(len(rows)))

    def root(a):
        while label[a] != a:
            a = label[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] == sets[b] or common * 10 >= similarity * 10 * (len(sets[a]) + len(sets[b]) - common):
                label[root(a)] = root(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        least[root(a)] = min(i, least.get(root(a), i))
    return sorted(least.values())


@pytest.fixture(scope="module")
def edited():
    """Texts of many lengths, each with copies in which more and more words differ, a common line, and a large group."""
    rng = random.Random(5)
    text = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    line, out = text(30), []
    for n in (1, 3, 5, 6, 9, 20, 60, 150, 400):
        base = text(n)
        out.append(base)
        for changes in range(0, max(2, n // 12)):
            w = list(base)
            for at in rng.sample(range(n), min(n, changes)):
                w[at] = "changed"
            out.append(w)
    out += [text(rng.randrange(5, 60)) + line for _ in range(60)]
    group = text(80)
    out += [group[:at] + ["other"] + group[at:] for at in range(0, 80, 2)]
    ids = rng.sample(range(10_000), len(out) + 2)
    return list(zip(ids, [" ".join(w) for w in out] + [None, " \n"]))


@pytest.mark.parametrize("options", [{}, {"share": 1, "cell": 7}, {"share": 1, "most": 3}], ids=str)
def test_near_keep(make_docs, edited, options):
    docs = make_docs(edited, clashes=True)
    kept = shingles.near_keep(docs, **options)
    assert kept.dtypes == docs.dtypes
    assert sorted(r.doc_id for r in kept.collect()) == kept_by_hand(edited)


def test_stage_against_brute_force(spark, make_docs, prose, edited):
    """The stage removes what is alike by five-word shingles, however far apart the fingerprints are."""
    used = {i for i, _ in edited}
    rows = edited + [(i + 20_000, t) for i, t in prose]
    assert len(used) == len(edited)
    kept = corpus_pipeline.without_near_copies(spark, make_docs(rows), "")
    assert sorted(r.doc_id for r in kept.collect()) == kept_by_hand(rows)


def test_rows_without_an_id(make_docs):
    """One row of a component stays where ids are null or repeated, and no other row goes."""
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    docs = make_docs([(None, a), (None, a + " x"), (1, b), (2, b + " x"), (2, "a text of its own"), (None, b + " y")])
    got = [(r.doc_id, r.text) for r in shingles.near_keep(docs).collect()]
    assert sorted(i or 0 for i, _ in got) == [0, 1, 2] and (1, b) in got and (2, "a text of its own") in got
    assert shingles.near_keep(docs.limit(0)).count() == 0


def test_a_large_group_makes_few_pairs(make_docs, monkeypatch):
    """Copies that are alike only by the text that all were made from: pivots find that text, so no pairs of all with all are checked."""
    rng, n, checked = random.Random(8), 300, []
    base = [f"w{k}" for k in range(146)]
    out = [base]
    for k in range(n):
        w = list(base)
        for part, at in enumerate(rng.sample(range(5, 140, 5), 3)):
            w[at] = f"x{k}.{part}"
        out.append(w)
    alike = shingles._alike

    def counted(pairs, *rest):
        checked.append(pairs.count())
        return alike(pairs, *rest)

    monkeypatch.setattr(shingles, "_alike", counted)
    rows = [(k, " ".join(w)) for k, w in enumerate(out)]
    kept = shingles.near_keep(make_docs(rows)).select("doc_id").collect()
    assert sorted(r.doc_id for r in kept) == kept_by_hand(rows) == [0]
    assert sum(checked) < 16 * n, checked
