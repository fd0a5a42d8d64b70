"""Every registered query against its SQL, and rules for all plans."""

import re

import pytest
from oracle import compare, connect

import __spark_entry__ as entry
from rowferry.plans import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
# no pair of tables multiplied, no Python in the row path
UNWANTED = re.compile(
    r"CartesianProduct|BroadcastNestedLoopJoin|PythonUDF|EvalPython|InPandas|InArrow"
)


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    plans = []

    def build(session, directory):
        df = QUERIES[name](session, directory)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    assert compare(spark, con, build, ORACLES[name], DATA) == []
    assert not UNWANTED.search(plans[0])


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
