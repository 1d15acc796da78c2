"""What no registered plan may contain."""

import pytest
from conftest import SF

from typeloom.plans.queries import QUERIES

LAZY = [n for n in QUERIES if not n.startswith("stream_") and n not in ("type_closure", "commit_serial")]


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join_and_no_python_rows(spark, name):
    text = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text
