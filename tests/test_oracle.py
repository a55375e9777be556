"""Each registered query against its DuckDB oracle on sf0.01 (the driver's
correctness gate), and its plan: no cartesian product, no Python UDF, and no
generated code that fails to compile (conftest turns the fallback off).
Queries without an oracle are held in test_models.py."""

import dataclasses

import pytest

from kiln.registry import entries
from tests.conftest import SF01
from tools.check_oracle import compare, duck

E = entries()
WITH_SQL = sorted(k for k, e in E.items() if e.sql)


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


@pytest.mark.parametrize("key", WITH_SQL)
def test_oracle(spark, con, key):
    seen = []

    def fn(s, sf_dir):
        seen.append(E[key].fn(s, sf_dir))
        return seen[0]

    status, msg, _ = compare(spark, con, dataclasses.replace(E[key], fn=fn), SF01)
    assert status == "ok", msg
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan, bad
