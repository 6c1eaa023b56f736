"""Every analytics query against its SQL, on the smallest tables."""

import glob
import os

import pytest

from weekloom import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p).removesuffix('.parquet')} AS SELECT * FROM read_parquet('{p}')")
    return c


def plain(v):
    """One form for the values of both engines."""
    if v is None or v != v:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return round(v, 9) + 0.0
    return str(v) if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    cur = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = [tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_rows_only(spark):
    for name in sorted(set(queries.QUERIES) - set(queries.ORACLES)):
        assert queries.QUERIES[name](spark, SF).count() >= 1, name


def test_entry(spark):
    import __spark_entry__ as e

    assert len(e.entry(spark).columns) == 7 and set(e.oracle_sql()) <= set(e.queries())
