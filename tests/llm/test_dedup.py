import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.llm import simhash
from pairloom.llm.components import components
from pairloom.llm.exact_dedup import exact_groups, exact_keep


def groups_by_hand(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return groups


@pytest.mark.parametrize("data", ["prose", "odd"])
def test_exact_groups(make_docs, data, request):
    rows = request.getfixturevalue(data)
    groups = groups_by_hand(rows)
    want = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids) if ids else None
        want.append((i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    got = [tuple(r) for r in exact_groups(make_docs(rows, clashes=True)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("data", ["prose", "odd"])
def test_exact_keep(make_docs, data, request):
    rows = request.getfixturevalue(data)
    docs = make_docs(rows, clashes=True)
    kept = exact_keep(docs)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    got = [(r.doc_id, r.text) for r in kept.collect()]
    groups = groups_by_hand(rows)
    assert sorted((i, t or "") for i, t in got if i is not None) == sorted((max(x for x in ids if x is not None), t) for t, ids in groups.items() if any(x is not None for x in ids))
    assert len(got) == len(groups)


@pytest.mark.parametrize("data", ["prose", "odd"])
def test_texts_with_one_digest_stay_apart(make_docs, data, request):
    """A digest of one letter has many clashes; groups are still those of the texts."""
    rows = request.getfixturevalue(data)
    docs = make_docs(rows, clashes=True)
    short = exact_groups(docs, digest=lambda t: F.substring(F.sha2(t, 256), 1, 1))
    whole = exact_groups(docs)
    assert short.select("text_sha256").distinct().count() < whole.select("text_sha256").distinct().count()
    columns = ["doc_id", "keep_id", "group_size", "kept"]
    assert sorted(map(str, short.select(columns).collect())) == sorted(map(str, whole.select(columns).collect()))


def test_empty_tables(make_docs):
    empty = make_docs([(1, "a")]).limit(0)
    assert exact_groups(empty).count() == 0 and exact_keep(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0


def test_fingerprint_by_definition():
    from xxhash import xxh64

    def plain(text):
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
        if not words:
            return 0
        shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
        hashes = [xxh64(s, seed=42).intdigest() for s in shingles]
        return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))

    for t in ("", " \n", "One", "A b C", "a b c d", "É É é X y\x0bz \x1c q", "w " * 99, "the end of the end of the end of it"):
        assert simhash.fingerprint(t) == plain(t), t


@pytest.mark.parametrize("code", simhash.CODES, ids=lambda c: c.name)
def test_codes_cover(code):
    """Every syndrome has a leader within the radius, and spread() meets for every pair within the threshold."""
    for _, _, bits in code.blocks:
        errors, first, last = code.patterns(bits, code.radius)
        assert (last > first).all()
        leaders = errors[first]
        assert (code.syndromes(leaders, bits) == np.arange(len(first))).all()
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, 200, np.uint64) * np.uint64(2) + rng.integers(0, 2, 200, np.uint64)
    y = x.copy()
    for k in range(200):
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            y[k] ^= np.uint64(1 << int(b))
    both = np.concatenate([x, y]).view(np.int64)
    anchor, index, home = code.spread(both, 4)
    homes = defaultdict(set)
    visits = defaultdict(set)
    for a, i, h in zip(anchor.tolist(), index.tolist(), home.tolist()):
        visits[i].add(a)
        if h:
            homes[i].add(a)
    assert all(homes[k] & visits[k + 200] for k in range(200))
    assert all(len(homes[k]) == len(code.blocks) for k in range(400))


def test_codes_are_taken_by_size():
    """A true covering code at every size, and the bounds that the docstring gives."""
    assert all(c.radius > 0 and c.parts for c in simhash.CODES)
    sizes = [simhash.most_fingerprints(c) for c in simhash.CODES]
    assert [simhash.code_for(n).name for n in (0, sizes[0], sizes[0] + 1, sizes[1], sizes[1] + 1, 10**12)] == ["golay"] * 2 + ["hamming"] * 2 + ["hamming-halves"] * 2
    assert 1.2e6 < sizes[0] < 1.4e6 and 1.3e7 < sizes[1] < 1.6e7 and 1.8e9 < sizes[2] < 2.1e9 and round(simhash.CODES[2].replicas(4)) == 343


@pytest.mark.parametrize("code", simhash.CODES, ids=lambda c: c.name)
def test_links_by_every_code(spark, code):
    """Clusters with up to six differing bits, some beyond the threshold, and single ones."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 62, 60, np.int64)
    flips = [sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 7), replace=False)) for _ in range(180)]
    fps = sorted({int(base[k % 60]) ^ f for k, f in enumerate(flips)})
    edges = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), code=code)
    got = {r.vertex: r.root for r in components(edges).collect()}
    label = {f: f for f in fps}
    for _ in fps:
        for a in fps:
            for b in fps:
                if (a ^ b).bit_count() <= 4:
                    label[a] = label[b] = min(label[a], label[b])
        if all(label[a] == label[b] for a in fps for b in fps if (a ^ b).bit_count() <= 4):
            break
    assert {f: got.get(f, f) for f in fps} == label


def links_by_hand(rows):
    prints = [simhash.fingerprint(t or "") for _, t in rows]
    label = list(range(len(rows)))

    def root(a):
        while label[a] != a:
            a = label[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                label[root(a)] = root(b)
    least = defaultdict(list)
    for a, (i, _) in enumerate(rows):
        least[root(a)].append(i)
    smallest = {r: min((i for i in ids if i is not None), default=None) for r, ids in least.items()}
    return [(i, f"{p:016x}", smallest[root(a)]) for a, ((i, _), p) in enumerate(zip(rows, prints))]


@pytest.mark.parametrize("data", ["prose", "odd"])
@pytest.mark.parametrize("cell", [3, 20_000])
def test_near_duplicates(make_docs, data, cell, request):
    rows = request.getfixturevalue(data)
    got = [tuple(r) for r in simhash.near_duplicates(make_docs(rows, clashes=True), cell=cell).collect()]
    assert sorted(got, key=str) == sorted(links_by_hand(rows), key=str)


def test_chain_of_links(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "u long, v long")
    got = {r.vertex: r.root for r in components(edges).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}
    assert components(edges.limit(0)).count() == 0
