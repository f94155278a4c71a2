"""Plan guards over every batch query: no nested-loop or Cartesian joins and no
row-at-a-time Python anywhere (Arrow-batched mapInArrow is the only Python)."""

import pytest

from conftest import SF_SMALL
from terrastate.plans import load_all

FORBIDDEN = ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython")
BATCH = sorted(n for n, q in load_all().items() if q.build.__module__ != "terrastate.plans.stream_queries")


@pytest.mark.parametrize("name", BATCH)
def test_plan_has_no_pairwise_join_or_row_python(spark, name):
    df = load_all()[name].build(spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    found = [op for op in FORBIDDEN if op in plan]
    assert not found, f"{name}: {found}"
