"""Components that don't settle in the given rounds are an error, not a result."""

import pytest

from tracewell.llm.components import connected_components


def test_rounds_that_run_out_are_an_error(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "u long, v long").repartition(7)
    with pytest.raises(RuntimeError, match="1 rounds"):
        connected_components(edges, "u", "v", max_rounds=1)
    assert {r.component for r in connected_components(edges, "u", "v").collect()} == {0}
