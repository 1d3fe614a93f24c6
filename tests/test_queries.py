"""Every registered query with SQL gives the rows DuckDB gives on the same files."""

import os
import shutil
import subprocess
import sys

import pytest
from compare import compare, connect
from conftest import SMALL

from fleetspark import catalog


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows_as_duckdb(spark, duck, name):
    equal, _, difference = compare(spark, duck, catalog.QUERIES[name], catalog.ORACLES[name], SMALL)
    assert equal, difference


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


def test_entry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("gone", [["fleetspark/llm", "corpus_pipeline.py"], ["fleetspark/llm"]])
def test_entry_imports_without_the_optional_part(tmp_path, gone):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    kept = tmp_path / "repo"
    shutil.copytree(root, kept, ignore=shutil.ignore_patterns(".git", "__pycache__", "tests", *[os.path.basename(g) for g in gone]))
    (kept / "fleetspark" / "llm" / "__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op1_') or n == 'pipeline' for n in e.queries()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=kept, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert done.stdout.split() == [str(len(catalog.QUERIES)), str(len(catalog.ORACLES)), "False"]
