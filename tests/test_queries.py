"""Every named query against its DuckDB statement on the same files."""

import compare
import pytest

import __spark_entry__ as contract
from oracles import ORACLES
from tickerloom.plans.queries import QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    return compare.connect(sf_dir)


def test_every_query_has_a_statement():
    assert set(QUERIES) == set(ORACLES) and set(QUERIES) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    columns, types, rows = compare.oracle_rows(duck, contract.oracle_sql()[name])
    frame = contract.queries()[name](spark, sf_dir)
    mine = compare.canonical(frame.columns, frame.collect())
    assert compare.differences(mine, compare.canonical(columns, rows)) == []
    spark_types = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
                   "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}
    assert {c: spark_types[t] for c, t in frame.dtypes} == types


def test_entry(spark, sf_dir):
    frame = contract.entry(spark)
    assert frame.count() > 0 and "bm_band" in frame.columns
