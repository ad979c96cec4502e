"""Both jobs over growing and broken-off input, against plain counts."""

import collections
import json
import math
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from jobs import pair_scores, text_study
from jobs.common import config
from pairloom.operators import pairs
from pairloom.operators.scorers import similarity
from pairloom.sources.analogues import impressions, read

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def files(path):
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(path) for n in names if n.startswith("part-")}


def histogram(rows):
    return sorted((r.pair_class, r.score, r.n) for r in rows)


@pytest.fixture(scope="module")
def whole(spark, sf_dir):
    """What all pairs at once give."""
    counts = pairs.class_histogram(impressions(spark, sf_dir), [similarity], pairs.THREE_WAY)
    top = pairs.best_pairs(impressions(spark, sf_dir), [similarity], 20, pairs.THREE_WAY, "impostor").orderBy(F.desc("similarity"), "i", "j").limit(20)
    return histogram(counts.withColumnRenamed("similarity", "score").collect()), [(r.i, r.j, r.similarity) for r in top.collect()]


def grow(spark, sf_dir, to, part):
    """A third of the index as one more file."""
    read(spark, sf_dir, "embeddings").where(F.col("vec_id") % 3 == part).coalesce(1).write.mode("append").parquet(to)


def test_growing_index(spark, sf_dir, tmp_path, whole):
    source, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    settings = config("pair_scores") | {"best": 20, "files_per_batch": 1, "tile_rows": 64}
    grow(spark, sf_dir, source, 2)
    grow(spark, sf_dir, source, 0)
    pair_scores.run(spark, source, out, marks, settings)
    before = {p: t for p, t in files(out).items() if "/report/" not in p and "/top/" not in p}
    assert {p.split("/batch=")[1][0] for p in before} == {"0", "1"}
    grow(spark, sf_dir, source, 1)
    # A file that brings known ids again, and rows that are no items.
    read(spark, sf_dir, "embeddings").limit(50).union(spark.sql("SELECT id, x, l FROM VALUES (1L, NULL, 1), (NULL, array(1f), 1), (70000L, array(1f, NULL), 1), (70001L, array(1f), NULL) AS t(id, x, l)")).coalesce(1).write.mode("append").parquet(source)
    report = pair_scores.run(spark, source, out, marks, settings)
    after = files(out)
    assert before.items() <= after.items()
    assert histogram(report.collect()) == whole[0]
    assert sorted((r.a, r.b, r.score) for r in spark.read.parquet(f"{out}/top").collect()) == sorted(whole[1])
    for rows in ({c: [r for r in report.collect() if r.pair_class == c]} for c in ("impostor", "genuine")):
        ((_, own),) = rows.items()
        assert max(r.rate for r in own) == 1.0 and min(own, key=lambda r: r.rate).score == max(r.score for r in own)
    # Nothing new: the same report, and no partition written again.
    assert histogram(pair_scores.run(spark, source, out, marks, settings).collect()) == whole[0]
    assert {p: t for p, t in files(out).items() if "/batch=" in p} == {p: t for p, t in after.items() if "/batch=" in p}


@pytest.mark.parametrize("broken", ["histogram", "best", "report"])
def test_broken_off_run_goes_on(spark, sf_dir, tmp_path, monkeypatch, whole, broken):
    source, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    settings = config("pair_scores") | {"best": 20, "files_per_batch": 1}
    for part in range(3):
        grow(spark, sf_dir, source, part)
    put, seen = pair_scores.put, []

    def fails(df, path, *by, **named):
        if path.endswith(broken):
            seen.append(path)
            if len(seen) == (1 if broken == "report" else 2):
                raise OSError("lost")
        put(df, path, *by, **named)

    monkeypatch.setattr(pair_scores, "put", fails)
    with pytest.raises(Exception, match="lost"):
        pair_scores.run(spark, source, out, marks, settings)
    monkeypatch.setattr(pair_scores, "put", put)
    assert histogram(pair_scores.run(spark, source, out, marks, settings).collect()) == whole[0]
    items = spark.read.parquet(f"{out}/items")
    assert items.count() == items.select("item").distinct().count() == items.agg(F.max("idx") + 1).first()[0]


def test_empty_index(spark, sf_dir, tmp_path):
    source, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    read(spark, sf_dir, "embeddings").limit(0).write.parquet(source)
    assert pair_scores.run(spark, source, out, marks).collect() == []
    grow(spark, sf_dir, source, 1)
    n = read(spark, sf_dir, "embeddings").where("vec_id % 3 = 1").count()
    assert sum(r.n for r in pair_scores.run(spark, source, out, marks).collect()) == n * (n - 1) // 2


def test_measures(spark):
    text = "Two words,\n and 12 more-Two words, "
    got = spark.createDataFrame([(1, text)], "doc_id int, text string").select(*(c.alias(m) for m, c in text_study.measures(F.col("text")).items())).first()
    words = text.split()
    assert got.asDict() == {
        "chars": len(text), "words": 6.0, "lines": 2.0, "word_length": sum(map(len, words)) / 6, "digits": 2 / len(text), "capitals": 2 / len(text), "marks": 3 / len(text), "distinct": len(set(words)) / 6,
    }


def documents(spark, rows, path):
    spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3).write.mode("overwrite").parquet(path)
    return path


def test_text_study(spark, tmp_path):
    """Copies count once; partitions of other languages stay; odd rows are left out."""
    rows = [(k, "en", " ".join(f"w{j * k % 7}," for j in range(k % 13 + 1)) + "A1"[: k % 3]) for k in range(40)]
    odd = [(None, "en", "x"), (50, None, "x"), (51, "en", None), (52, "en", " \n"), (53, "de", "allein"), (54, "en", rows[3][2]), (55, "en", rows[3][2])]
    out = str(tmp_path / "out")
    first = text_study.run(spark, documents(spark, rows + odd, str(tmp_path / "in")), out).collect()
    table = {r.doc_id: r for r in spark.read.parquet(f"{out}/features").collect()}
    texts = collections.defaultdict(list)
    for i, lang, text in rows + odd:
        if None not in (i, lang, text) and text.strip():
            texts[text].append(i)
    assert {i: r.copies for i, r in table.items()} == {min(ids): len(ids) for ids in texts.values()}
    n = sum(1 for r in table.values() if r.lang == "en")
    assert {(r.version, r.lang, r.n) for r in first} == {(v, "en", n) for v in ("raw", "adjusted")} and len(first) == 2 * 28
    # Rank correlation of two measures by hand: with normal scores it has the sign and the order of the ranks.
    pair = next(r for r in first if (r.a, r.b, r.version) == ("chars", "words", "raw"))
    assert pair.rho > 0.9 and math.isclose(pair.mi, -0.5 * math.log(1 - pair.rho**2), rel_tol=1e-9)
    kept = files(f"{out}/features/lang=de")
    # More German texts: the English partition is not touched.
    before = files(f"{out}/features/lang=en")
    german = [(100 + k, "de", "wort " * (k + 1) + "B" * (k % 4)) for k in range(12)]
    both = text_study.run(spark, documents(spark, german, str(tmp_path / "more")), out).collect()
    assert files(f"{out}/features/lang=en") == before and not kept.items() <= files(f"{out}/features/lang=de").items()
    assert {r.lang for r in both} == {"de", "en"}
    again = text_study.run(spark, str(tmp_path / "more"), out).collect()
    key = lambda r: (r.version, r.lang, r.a, r.b)
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, both), key=str) and len(set(map(key, both))) == len(both)
    assert text_study.run(spark, documents(spark, [], str(tmp_path / "none")), str(tmp_path / "nothing")).collect() == []


def test_config(tmp_path):
    given = tmp_path / "c.json"
    given.write_text(json.dumps({"best": 7}))
    assert config("pair_scores", str(given)) == config("pair_scores") | {"best": 7}
    given.write_text(json.dumps({"besst": 7}))
    with pytest.raises(ValueError, match="besst"):
        config("pair_scores", str(given))


def test_command_lines(spark, sf_dir, tmp_path):
    """Both run by themselves; the languages of the config are the only ones written."""
    documents(spark, [(k, lang, f"{lang} word " * (k % 17 + 1)) for k in range(60) for lang in ("en", "fr")], str(tmp_path / "texts"))
    grow(spark, sf_dir, str(tmp_path / "index"), 0)
    (tmp_path / "c.json").write_text(json.dumps({"languages": ["fr"]}))
    runs = {"text_study": ["--source", "texts", "--target", "study", "--config", "c.json"], "pair_scores": ["--source", "index", "--target", "scores", "--checkpoint", "marks"]}
    for name, given in runs.items():
        said = subprocess.run([sys.executable, "-m", f"jobs.{name}", *given], cwd=tmp_path, capture_output=True, text=True, timeout=300, env={**os.environ, "PYTHONPATH": ROOT})
        assert said.returncode == 0, said.stderr
        assert "wrote" in said.stderr and "read" in said.stderr
    assert sorted(os.listdir(tmp_path / "study" / "features"))[-1] == "lang=fr" and not (tmp_path / "study" / "features" / "lang=en").exists()
    assert spark.read.parquet(str(tmp_path / "scores" / "report")).agg(F.sum("n")).first()[0] > 0
