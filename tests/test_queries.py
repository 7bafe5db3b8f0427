"""Every registered query against its SQL equivalent, on whole tables."""

import glob
import math
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from catalog import comparing, generating, profiling  # noqa: E402,F401  (they register their queries)
from catalog.registry import ORACLES, QUERIES  # noqa: E402

NAMES = sorted(QUERIES)  # before the entry module adds the queries of subpackages, which have their own tests
import __spark_entry__ as registered  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not found")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def comparable(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    rows = [r.asDict() for r in df.collect()]
    sql = ORACLES.get(name)
    if sql is None:
        assert rows
        return
    cursor = duck.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    expected = sorted(tuple(comparable(dict(zip(names, r))[c]) for c in order) for r in cursor.fetchall())
    assert sorted(tuple(comparable(r[c]) for c in order) for r in rows) == expected


def test_every_query_has_sql():
    assert set(NAMES) <= set(registered.oracle_sql()) & set(registered.queries())


def test_entry(spark):
    assert registered.entry(spark).count() == 1
