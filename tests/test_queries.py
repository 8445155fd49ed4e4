"""Every query that has SQL gives what DuckDB gives on the smallest tables; the others give rows."""

import math
import os

import pandas as pd
import pytest

from panelyard.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x):
    if x is None or x is pd.NaT:
        return None
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5) + 0.0
    if isinstance(x, pd.Timestamp):
        return x.date().isoformat() if x == x.normalize() else x.isoformat()
    return x.isoformat() if hasattr(x, "isoformat") else x


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(cell(x) for x in r) for r in df.where(df.notna(), None).itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(FOLDER):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    got = pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns)
    want = duck.execute(registry.ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["portfolio_metrics", "breakout_boxes", "fundamentals_pit", "stat_quantile_returns"])
def test_rows(spark, duck, name):
    assert registry.QUERIES[name](spark, FOLDER).count() >= 0


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(registry.QUERIES) > 80
    assert e.entry(spark).count() > 0


def test_import_needs_no_session():
    import subprocess
    import sys
    from pathlib import Path

    top = Path(__file__).resolve().parent.parent
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=top, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0 and int(said.stdout) > 80, said.stderr
