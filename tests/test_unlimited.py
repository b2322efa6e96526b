"""The bound query of references has no limit, as its SQL has none."""

import os

import pytest

from lodestone.plans import bound

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_references_have_no_limit(spark):
    plan = bound.QUERIES["find_references"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit" not in plan
