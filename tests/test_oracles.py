"""Every registered query against its SQL cross-check, over the whole small tables."""

import check
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return check.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    problem = check.compare(spark, con, name, QUERIES[name], ORACLES.get(name), FOLDER)
    assert problem is None, problem


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"apid", "packets", "gaps", "missing", "worst"}
