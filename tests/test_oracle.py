"""Every registered query against its DuckDB oracle on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, duck
from tests.conftest import SMALL

QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


def test_every_query_has_an_oracle():
    own = {n for n in QUERIES if n != "pipeline" and not n.startswith("op")}
    assert own <= set(ORACLES) <= set(QUERIES)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns[0] == "run_id"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    want = con.sql(ORACLES[name]).df()
    ok, msg = compare(got, want)
    assert ok, msg
