"""The driver's contract, with and without the training-data subpackage."""

import os
import re
import shutil
import subprocess
import sys

import __spark_entry__
from pairloom.plans import catalog

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert sum(r.n for r in rows) > 0 and {r.pair_class for r in rows} == {"genuine", "impostor"}


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())


def test_without_the_subpackage(tmp_path):
    """The entry point imports and offers all other queries where the subpackage and its pipeline are deleted."""
    for name in ("pairloom", "jobs", "__spark_entry__.py"):
        source = os.path.join(ROOT, name)
        (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "pairloom" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q); print(len(q))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert said.returncode == 0, said.stderr
    assert int(said.stdout) == len(catalog.QUERIES)


def test_where_a_module_is_missing(tmp_path):
    """What the subpackage needs and cannot be imported takes none of the other queries with it."""
    (tmp_path / "xxhash.py").write_text("raise ImportError('not here')")
    (tmp_path / "zstandard.py").write_text("raise ImportError('not here')")
    (tmp_path / "pairloom").mkdir()
    for name in os.listdir(os.path.join(ROOT, "pairloom")):
        if name not in ("llm", "__pycache__"):
            os.symlink(os.path.join(ROOT, "pairloom", name), tmp_path / "pairloom" / name)
    (tmp_path / "pairloom" / "llm").mkdir()
    (tmp_path / "pairloom" / "llm" / "queries.py").write_text("import xxhash")
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    shutil.copytree(os.path.join(ROOT, "jobs"), tmp_path / "jobs")
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert said.returncode == 0, said.stderr
    assert int(said.stdout) == len(catalog.QUERIES)


def test_nothing_else_imports_the_subpackage():
    places = [x for top in ("pairloom", "jobs") for x in os.walk(os.path.join(ROOT, top))]
    for folder, _, names in places:
        if os.path.basename(folder) not in ("llm", "__pycache__"):
            for n in names:
                if n.endswith(".py"):
                    assert not re.search(r"\bllm\b", open(os.path.join(folder, n), encoding="utf-8").read()), n
