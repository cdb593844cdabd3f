"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from cohortlab.plans import catalog, sql

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(sql.ORACLE) and not set(catalog.MORE) & set(sql.ORACLE)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(sql.ORACLE))
def test_query_equals_sql(spark, con, name):
    df = catalog.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted((tuple(map(plain, (r[c] for c in cols))) for r in df.collect()), key=str)
    rel = con.execute(sql.ORACLE[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted((tuple(map(plain, (r[i] for i in at))) for r in rel.fetchall()), key=str)
    assert got == want


def test_the_rest_stands_without_the_training_data_operators(tmp_path):
    """The subpackage, its tests and the pipeline go; or the first two only."""
    root = Path(entry.__file__).parent
    shutil.copytree(root / "cohortlab", tmp_path / "cohortlab", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(entry.__file__, tmp_path)
    code = "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(__import__('cohortlab.plans.catalog', fromlist=['x']).queries()), set(e.oracle_sql()) <= set(e.queries()))"
    for left in (True, False):
        if left and (root / "corpus_pipeline.py").exists():
            shutil.copy(root / "corpus_pipeline.py", tmp_path)
        done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
        assert done.stdout.split() == ["True", "True"], done.stderr
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)


def test_entry(spark):
    assert entry.entry(spark).count() == 4
