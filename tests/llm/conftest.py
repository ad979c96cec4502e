import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHES = ["fp", "size", "place", "block", "draws", "sha", "salt", "row", "kept", "bucket", "names", "spans", "score", "media", "frames", "label", "u", "v", "mark", "doc", "target", "component_id", "keep_id"]
CLASHES += ["__place", "__draws", "__s", "__d", "__b", "__row", "__block", "__blocks", "__target", "__source_size", "__toxicity", "_id", "c0"]


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows, clashes=False):
        """Documents from (doc_id, text) or (doc_id, text, source)."""
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] is not None else None) for r in rows]
        df = spark.createDataFrame(full, DOCS).repartition(3)
        for k, c in enumerate(CLASHES if clashes else ()):
            df = df.selectExpr("*", f"{k} AS `{c}`")
        return df

    return make


@pytest.fixture(scope="session")
def prose():
    """Random documents with copies, near copies and shared passages, as (doc_id, text)."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [text(rng.randint(1, 300)) for _ in range(60)]
    shared = [text(70), text(55), text(50), text(49)]
    docs += [d + " " + shared[k % 4] + "\n" + text(5) for k, d in enumerate(docs[:24])]
    docs += docs[:6] + docs[:3]
    for d in docs[10:16]:
        w = d.split(" ")
        w[len(w) // 2] = "changed"
        docs.append(" ".join(w))
    ids = rng.sample(range(1000), len(docs))
    return list(zip(ids, docs))


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty and long texts, ties and repeated rows."""
    long = " ".join(f"w{k % 977}" for k in range(60_000))
    return [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (4, "a"), (4, "b"), (None, "a"), (None, None), (5, "x" * 70_000), (6, long), (7, long), (8, "ab" * 500), (9, "same words here now"), (10, "SAME words  here\nnow"), (11, "é中\U0001f600   '")]
