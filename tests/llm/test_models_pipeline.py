"""Held-out accuracy of the classifiers, and the pipeline against plain versions of its stages."""

import os
import pickle
import subprocess
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from pairloom.llm import quality, queries, toxicity
from pairloom.llm.common import held_out, table
from tests.llm.test_shingles import kept_by_hand

LARGER = "/root/testdata/sf0.01"


def scored(spark, sf_dir, name, label):
    got = queries.QUERIES[name](spark, sf_dir)
    return got.join(table(spark, sf_dir, "labels"), "doc_id").where("held_out").select("predicted", F.col(label).alias("label"), "score").toPandas(), got


@pytest.mark.skipif(not os.path.exists(LARGER), reason="needs the larger tables")
@pytest.mark.parametrize(("name", "label", "least"), [("op7_quality", "quality", 0.95), ("op8_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    rows, got = scored(spark, LARGER, name, label)
    assert (rows.predicted == rows.label).mean() >= least
    assert got.count() == table(spark, LARGER, "documents").count()
    low, high = got.agg(F.min("score"), F.max("score")).first()
    assert 0 <= low <= high <= 1


def test_held_out_labels_are_not_learned(spark, make_docs):
    """Turning the labels that are held out changes no score."""
    docs = make_docs([(k, ("good words here " if k % 3 else "bad %%% junk### ") * (k % 7 + 1)) for k in range(200)])
    labels = docs.select("doc_id", (F.col("doc_id") % 3 != 0).cast("int").alias("quality"), (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    turned = labels.select("doc_id", *(F.when(held_out(F.col("doc_id")), 1 - F.col(c)).otherwise(F.col(c)).alias(c) for c in ("quality", "toxic")))
    assert labels.exceptAll(turned).count() > 0
    for module, score in ((quality, quality.quality_scores), (toxicity, toxicity.toxicity)):
        a, b = ({r.doc_id: r.score for r in score(docs, module.fit(docs, x)).collect()} for x in (labels, turned))
        assert a == b
        name = "quality" if module is quality else "toxic"
        right = [(a[r.doc_id] >= 0.5) == bool(r[name]) for r in labels.collect()]
        assert np.mean(right) > 0.95


def test_odd_documents(make_docs, spark, odd):
    docs = make_docs(odd, clashes=True)
    some = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (4, 1, 0), (5, 0, 1), (5, 0, 1), (7, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for labels in (some, some.limit(0)):
        q = quality.quality_scores(docs, quality.fit(docs, labels)).collect()
        t = toxicity.toxicity(docs, toxicity.fit(docs, labels)).collect()
        assert len(q) == len(t) == len(odd)
        assert all(0 <= r.score <= 1 for r in q + t)
        kept = toxicity.without_toxic(docs, toxicity.fit(docs, labels))
        assert kept.columns == docs.columns
    empty = docs.limit(0)
    assert quality.quality_scores(empty, quality.fit(empty, some)).count() == 0
    assert toxicity.toxicity(empty, toxicity.fit(empty, some)).count() == 0


def test_crf_against_enumeration():
    """Marginals and expected transitions equal sums over all tag sequences."""
    rng = np.random.default_rng(0)
    crf = toxicity.Crf(np.zeros(1), rng.standard_normal((2, 2)))
    e = rng.standard_normal((5, 1))
    mask = np.ones((5, 1), bool)
    p, moves = crf.expected(e, mask)
    weights, marginal, pairs = 0.0, np.zeros(5), np.zeros((2, 2))
    for code in range(32):
        tags = [code >> k & 1 for k in range(5)]
        w = np.exp(sum(e[k, 0] * tags[k] for k in range(5)) + sum(crf.trans[a, b] for a, b in zip(tags, tags[1:])))
        weights += w
        marginal += w * np.array(tags)
        for a, b in zip(tags, tags[1:]):
            pairs[a, b] += w
    assert np.allclose(p[:, 0], marginal / weights) and np.allclose(moves, pairs / weights)
    mask[3:] = False
    short = toxicity.Crf(np.zeros(1), crf.trans).expected(e[:3], np.ones((3, 1), bool))
    long = crf.expected(e, mask)
    assert np.allclose(long[0][:3], short[0]) and np.allclose(long[1], short[1]) and not long[0][3:].any()


def test_spans_are_offsets(spark):
    words = ["calm"] * 40
    docs, labels = [], []
    for k in range(120):
        w = list(words)
        if k % 2:
            w[5] = w[6] = "vileword,"
        docs.append((k, " ".join(w) + f" n{k}"))
        labels.append((k, k % 2))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    rows = {r.doc_id: r for r in toxicity.toxicity(df, model).collect()}
    assert all((rows[k].score >= 0.5) == bool(k % 2) for k, _ in docs)
    assert all(docs[k][1][s.start : s.end] == "vileword, vileword," for k in range(1, 120, 2) for s in rows[k].spans)
    assert rows[1].spans and not rows[0].spans


def test_votes_against_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), sample=60, k=5)
    texts = [r.text or "" for r in docs.limit(40).collect()]
    v = model.project(quality._terms(model.terms).matrix(texts))
    want = []
    for row in v:
        cos = model.vectors @ row
        near = np.argsort(-cos)[:5]
        w = np.maximum(cos[near], 0).astype(float) ** 8
        want.append((w * model.labels[near]).sum() / w.sum())
    assert np.allclose(model.scores(texts), want, atol=1e-5)


def test_scores_do_not_depend_on_the_batch(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    texts = [r.text or "" for r in docs.collect()] + ["", "Aa-1" * 10 + "!", "x9" * 40]
    whole = model.scores(texts)
    assert all(model.scores([t])[0] == s for t, s in zip(texts, whole))
    assert (model.scores(texts[3:] + texts[:3]) == np.roll(whole, -3)).all()


SCORED = """
import pickle, sys
model, texts = pickle.load(open(sys.argv[1], "rb"))
scores = model.scores(texts)
assert all(model.scores([t])[0] == s for t, s in zip(texts[:300], scores))
assert (model.scores(texts[5:] + texts[:5])[:-5] == scores[5:]).all()
sys.stdout.write(scores.tobytes().hex())
"""


def test_scores_do_not_depend_on_the_processor(spark, sf_dir, tmp_path):
    """Kernels of several processors, whose sums have other orders, give the same bits."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    with open(tmp_path / "model", "wb") as f:
        pickle.dump((model, [r.text or "" for r in docs.collect()]), f)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    found = set()
    for kernel in ("Haswell", "Nehalem", "Prescott", ""):
        env = {**os.environ, "PYTHONPATH": root} | ({"OPENBLAS_CORETYPE": kernel} if kernel else {})
        said = subprocess.run([sys.executable, "-c", SCORED, str(tmp_path / "model")], capture_output=True, text=True, env=env)
        assert said.returncode == 0, said.stderr
        found.add(said.stdout)
    assert len(found) == 1


def test_shapes_are_whole():
    assert quality._shape("a1" * 20) == "x0" * 20 and quality._shape("ABcd--") == "Xx-"


def test_every_segment_trains(monkeypatch):
    """A document of twenty toxic segments trains with all of them, and with its clean ones, in however many blocks."""
    bad = [f"vile{k}" for k in range(20)]
    long = " ".join(" ".join(["calm"] * (toxicity.SEGMENT - 1) + [b]) for b in bad) + " calm" * 3 * toxicity.SEGMENT
    suspect = np.zeros(toxicity.FEATURES, bool)
    suspect[[toxicity.word_features(b)[1] for b in bad]] = True
    texts = [(long, 1), ("", 0), (bad[0], 0), (bad[0], 1)]
    (whole,) = toxicity.labelled_blocks(iter(texts), suspect)
    assert whole.lengths.tolist() == [23 * toxicity.SEGMENT, 1, 1] and whole.labels.sum() == 21 and whole.labels[-2:].tolist() == [0, 1]
    assert (np.flatnonzero(whole.labels[:-2]) // toxicity.SEGMENT).tolist() == list(range(20))
    begins, sizes = toxicity._segments(whole.lengths)
    assert sizes.sum() == whole.lengths.sum() and len(begins) == 25 and sizes.max() == toxicity.SEGMENT
    covered = np.concatenate([np.arange(a, a + n) for a, n in zip(begins, sizes)])
    assert covered.tolist() == list(range(whole.lengths.sum()))
    assert toxicity._segments(np.array([130, 0, 64]))[1].tolist() == [64, 64, 2, 64]
    monkeypatch.setattr(toxicity, "BLOCK_TOKENS", 3 * toxicity.SEGMENT + 5)
    parts = list(toxicity.labelled_blocks(iter(texts), suspect))
    assert len(parts) == 5 and sum(len(b.ids) for b in parts) == len(whole.ids) and max(len(b.ids) for b in parts) < 2 * toxicity.BLOCK_TOKENS
    crf = toxicity.Crf(np.random.default_rng(0).standard_normal(toxicity.FEATURES), np.array([[0.1, 0.2], [0.3, -0.4]]))
    assert np.abs(whole.gradient(crf) - sum(b.gradient(crf) for b in parts)).max() <= 2
    assert list(toxicity.labelled_blocks(iter([]), suspect)) == []


def test_training_against_the_whole_likelihood():
    """The gradient over grids of segments moves the weights as one that is summed segment by segment."""
    rng = np.random.default_rng(3)
    features = np.array([toxicity.word_features(w) for w in ("aa", "bb", "cc", "dd")], np.int32)
    lengths = np.array([5, 70, 1, 130])
    ids = rng.integers(0, 4, lengths.sum()).astype(np.int32)
    block = toxicity.Block(features, ids, (ids == 2).astype(np.int8), lengths)
    a, b = (toxicity.train_crf(lambda crf, n=n: block.gradient(crf, n), np.unique(features), len(ids), rounds=5) for n in (1, 1000))
    assert np.allclose(a.weights, b.weights) and np.allclose(a.trans, b.trans)
    scores = a.weights[features].sum(1)
    assert scores[2] == scores.max()


def test_training_does_not_depend_on_partitions(spark, sf_dir):
    """Long sampled texts too: the same weights, however documents are dealt out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    long = docs.where("doc_id % 9 = 0").select("doc_id", F.repeat(F.concat("text", F.lit(" ")), 60).alias("text"))
    docs = docs.where("doc_id % 9 <> 0").unionByName(long)
    models = [toxicity.fit(docs.repartition(n), table(spark, sf_dir, "labels")) for n in (1, 7)]
    assert np.abs(models[0].crf.weights - models[1].crf.weights).max() < 1e-9 and np.abs(models[0].blend - models[1].blend).max() < 1e-9


def test_pipeline_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kinds, names = docs.dtypes, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    kept, tables = docs.cache(), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf_dir).cache()
        assert dict(kept.dtypes) == dict(kinds)
        tables.append(kept)
    clean, distinct, apart, mixed = ([tuple(r) for r in t.select("doc_id", "text").collect()] for t in tables)
    scores = {r.doc_id: r.score for r in toxicity.toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))).collect()}
    assert sorted(i for i, _ in clean) == sorted(i for i, s in scores.items() if s < 0.5)
    last = {}
    for i, t in clean:
        last[t or ""] = max(i, last.get(t or "", i))
    assert sorted(i for i, _ in distinct) == sorted(last.values())
    assert sorted(i for i, _ in apart) == kept_by_hand(distinct)
    assert set(mixed) <= set(apart) and max(Counter(i for i, _ in mixed).values()) <= 3
    packed = corpus_pipeline.STAGES[-1][1](spark, tables[-1], sf_dir).toPandas()
    assert packed.length.sum() == sum(len((t or "").encode().split()) + 1 for _, t in mixed)


def test_pipeline_stages_on_odd_documents(spark, sf_dir, make_docs, odd, prose):
    """Nulls, empty and very long texts, repeated rows and clashing columns go through every stage."""
    for docs in (make_docs(odd + prose[:20], clashes=True), make_docs(odd, clashes=True).limit(0)):
        texts = {(r.text or "") for r in docs.collect()}
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before, docs = docs, stage(spark, docs, sf_dir).cache()
            assert dict(docs.dtypes) == dict(before.dtypes), name
            assert {(r.text or "") for r in docs.collect()} <= {(r.text or "") for r in before.collect()}, name
            if name == "exact_dedup":
                assert docs.count() == len({(r.text or "") for r in before.collect()}) <= len(texts)
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
        assert packed.agg(F.sum("length")).first()[0] == (sum(len((r.text or "").encode().split()) + 1 for r in docs.collect()) or None)


def test_pipeline_runs(spark, sf_dir):
    assert __spark_entry__.queries()["pipeline"](spark, sf_dir).count() > 0


def plain(v):
    return round(v, 6) if isinstance(v, float) else int(v) if isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, sf_dir, duck, name):
    df, want = queries.QUERIES[name](spark, sf_dir), duck.sql(queries.SQL[name])
    k = sorted(df.columns)
    assert k == sorted(want.columns)
    got = sorted((tuple(plain(r[c]) for c in k) for r in df.collect()), key=str)
    assert got == sorted((tuple(plain(r[want.columns.index(c)]) for c in k) for r in want.fetchall()), key=str)


def test_every_operator_is_registered():
    found = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in found) for k in range(1, 11)) and "pipeline" in found
