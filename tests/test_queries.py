"""Each registered query of the engine against its SQL in DuckDB."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from chainlens.plans import chains, evidence, fleet, streams  # noqa: F401
from chainlens.plans.queries import QUERIES, SQL

SMALL = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in SMALL.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, tables, name):
    got, want = QUERIES[name](spark, str(SMALL)), tables.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda row: tuple((v is None, str(v)) for v in row)
    rows = sorted((tuple(r) for r in got.select(*want.columns).collect()), key=key)
    assert list(map(key, rows)) == sorted(map(key, want.fetchall()))
    assert rows


def test_entry_without_corpus_operators(tmp_path):
    """The whole repository but for the corpus operators and their tests: the entry point imports, lists and runs the engine's queries."""
    root = Path(__file__).resolve().parent.parent
    gone = {root / "chainlens" / "llm", root / "tests" / "llm"}
    shutil.copytree(root, tmp_path / "repo", ignore=lambda folder, names: [n for n in names if Path(folder) / n in gone or n in (".git", "__pycache__", ".pytest_cache", "spark-warehouse")])
    code = """
import __spark_entry__ as e
from pyspark.sql import SparkSession
q, s = e.queries(), e.oracle_sql()
assert 'diff_customer_pair' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q)
assert set(s) <= set(q)
assert e.entry(SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()).count() > 0
"""
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "repo", check=True, env={**os.environ, "PYTHONPATH": ""})


@pytest.mark.parametrize("name", ["diff_section_filter", "chain_fold_events"])
def test_no_group_is_gathered_into_one_row(spark, name):
    assert "collect_list" not in QUERIES[name](spark, str(SMALL))._jdf.queryExecution().toString()
