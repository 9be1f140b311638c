"""Every query of the engine against its SQL, on the smallest tables."""

import math
import os

import pytest

import __spark_entry__
from tallyloom.plans import catalogue


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (bool, str)):
        return v
    try:
        return float(v)
    except (TypeError, ValueError):
        return str(v)


@pytest.fixture(scope="session")
def duck(sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_against_sql(name, spark, sf_dir, duck):
    df = catalogue.QUERIES[name](spark, sf_dir)
    want = duck.sql(catalogue.SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=str)
    rows = want.select(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert got == sorted((tuple(map(plain, r)) for r in rows), key=str)


def test_entry(spark, sf_dir):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_pushdown(spark, sf_dir):
    plan = catalogue.QUERIES["changes_since"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "ReadSchema" in plan


def test_queries_are_listed_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__spark_entry__.__file__).parent
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"], cwd=root, check=True, timeout=120)
