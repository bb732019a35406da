"""Every query against its SQL in DuckDB on the smallest tables, and all of them for stable columns."""

import math
from pathlib import Path

import pytest

from tarnweave.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="needs the tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value + 0.0:.6f}"
    if type(value).__name__ == "Decimal":
        return f"{float(value):.6f}"
    return value.isoformat() if hasattr(value, "isoformat") else str(value)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    rows, cols = df.collect(), sorted(df.columns)
    if name not in catalogue.ORACLE:
        return
    found = duck.execute(catalogue.ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    ours = sorted(tuple(plain(r[c]) for c in cols) for r in rows)
    theirs = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall())
    assert ours == theirs


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["conv_id", "reason"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.QUERIES) <= set(entry.queries())
