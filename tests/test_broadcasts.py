"""Tables of ids that are small as files do not pass through the driver."""

import pytest

from tripleforge.sources import store


def test_written_tables_count_as_large_as_in_memory(spark):
    rows = 300_000
    t = store.written(spark.range(rows).selectExpr("id", "id * 7 % 1000 as x"))
    assert t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() >= 8 * rows
    j = t.join(store.written(spark.range(2 * rows)), "id")
    assert j.count() == rows
    j.collect()
    assert "BroadcastHashJoin" not in j._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("size, number", [("10485760b", 10 << 20), ("256k", 256 << 10), ("-1", -1), ("1MB", 1 << 20), ("5", 5)])
def test_sizes(size, number):
    assert store._bytes(size) == number
