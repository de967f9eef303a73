import math
import os
import shutil
import subprocess
import sys
from difflib import SequenceMatcher

import duckdb
import pytest

import __spark_entry__ as registry
from storyloom.operators import clustering
from storyloom.plans import catalog, desk  # noqa: F401

from conftest import DATA, ROOT

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    return repr(round(value, 6) + 0.0) if isinstance(value, float) else str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    found = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_rows(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_gestalt_of_every_title_pair(spark):
    m = catalog.Model(spark, DATA)
    want = {r["id"]: (r["left"], r["right"]) for r in catalog._title_pairs(m).collect()}
    got = catalog.QUERIES["gestalt_title_pairs"](spark, DATA).collect()
    assert len(got) == len(want) and {r["id"] for r in got} == set(want)
    keys = {r["id"]: (r["left_key"], r["right_key"]) for r in clustering.pair_scores(catalog._title_pairs(m)).collect()}
    assert all(r["ratio"] == round(SequenceMatcher(None, *keys[r["id"]]).ratio() if all(keys[r["id"]]) else 0.0, 6) for r in got)
    assert any(r["jaccard"] == 0 and r["ratio"] > 0 for r in got)


def test_stories_of_each_source_as_stream(spark):
    rows = catalog.QUERIES["stream_clusters_equal_batch"](spark, DATA).collect()
    ids = {r["id"] for r in rows}
    assert len(rows) == len(ids) == catalog.Model(spark, DATA).table("documents").count()
    assert all(r["same"] and r["cluster_id"] in ids for r in rows) and len({r["route"] for r in rows}) > 1


def test_entry(spark):
    assert registry.entry(spark).count() > 0
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("gone", [["storyloom/llm", "tests/llm"], ["storyloom/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_registry_without_the_training_data_part(tmp_path, gone):
    """The rest imports and registers its queries whichever half of that part is deleted."""
    root = tmp_path / "copy"
    shutil.copytree(ROOT, root, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.md", "*.json"))
    for name in gone:
        path = root / name
        shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)
    code = "import __spark_entry__ as r; q, o = r.queries(), r.oracle_sql(); assert set(o) <= set(q) and 'feed_page' in q; print(*q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", code], cwd=root, env=env, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr
    names = run.stdout.split()
    assert "pipeline" not in names and any(n.startswith("op1_") for n in names) == (gone == ["corpus_pipeline.py"])
