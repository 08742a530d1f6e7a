"""Every query with an oracle gives what DuckDB gives, at the smallest scale."""

from pathlib import Path

import duckdb
import pytest

import mudlark.queries_files  # noqa: F401
from mudlark.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")


def shown(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "hour"):
        return v.isoformat()
    return str(v) if isinstance(v, str) or hasattr(v, "year") else f"{float(v):.4f}"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    rows = sorted(tuple(shown(v) for v in r) for r in want.fetchall())
    assert sorted(tuple(shown(r[c]) for c in columns) for r in df.collect()) == rows
