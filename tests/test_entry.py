import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_names():
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries) and len(oracle) > 50


def test_entry(spark):
    assert entry.entry(spark).count() == 10


@pytest.mark.parametrize("name", ["catalog_dedup", "rec_overall_top", "fullrank_latent_cosine", "agg_borda", "metric_ranking", "agreement"])
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    found = entry.queries()[name](spark, SMALL).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    columns = sorted(found.columns)
    assert columns == sorted(want.columns) and len(found) == len(want)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (found, want))
    for c in columns:
        if a[c].dtype.kind == "f":
            assert (a[c] - b[c].astype(float)).abs().max() < 2e-6
        else:
            assert a[c].tolist() == b[c].tolist()


@pytest.mark.parametrize("left", [True, False], ids=["pipeline stays", "pipeline goes"])
def test_without_the_corpus_part(tmp_path, left):
    """The rest stands on its own when the corpus folders are deleted."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", *([] if left else ["corpus_pipeline.py"])))
    assert not (copy / "latora/llm").exists() and (copy / "corpus_pipeline.py").exists() == left
    code = "import __spark_entry__ as e; q = e.queries(); assert not [n for n in q if n.startswith('op') or n == 'pipeline']; assert set(e.oracle_sql()) <= set(q); print(len(q))"
    found = subprocess.run([sys.executable, "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=300, check=False)
    assert found.returncode == 0, found.stderr
    assert int(found.stdout) == len([n for n in entry.queries() if not n.startswith("op") and n != "pipeline"])
