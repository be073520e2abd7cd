"""Every registered query against its SQL in DuckDB, with plan checks."""

import os

import pytest
from check import compare, connect

from undulate.plans import ORACLES, QUERIES, load_all

load_all()
SF = os.environ.get("TEST_SF", "0.001")
DIR = f"/root/testdata/sf{SF}"
BANNED = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")


@pytest.fixture(scope="module")
def con():
    return connect(DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    seen = []

    def run(s, d):
        df = QUERIES[name](s, d)
        seen.append(df)
        return df

    status, n, _, _, msg = compare(spark, con, DIR, name, run, ORACLES.get(name))
    assert status in ("ok", "rows"), msg
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert not [b for b in BANNED if b in plan]


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) > 200
