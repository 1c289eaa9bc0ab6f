"""Small files of many rows aren't broadcast; small tables still are."""

from pyspark.sql import functions as F

from keyloom.llm.common import Scratch


def _plan(s, rows):
    """The plan that ran of a right join, of which only the left side, which repeats itself, can be broadcast."""
    big = s.table(s.spark.range(rows).select((F.col("id") % 1000).alias("k"), F.repeat(F.lit("x"), F.lit(200)).alias("t")), "big")
    other = s.table(s.spark.range(1000).select(F.col("id").alias("o")), "other")
    assert int(str(big._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 1 << 20
    out = big.join(other, F.col("k") == F.col("o"), "right")
    assert len(out.collect()) == rows
    return out._jdf.queryExecution().executedPlan().toString()


def test_small_files_of_many_rows_are_not_broadcast(spark):
    with Scratch(spark) as s:
        assert "BroadcastHashJoin" not in _plan(s, 100_000)  # 20 MB of rows


def test_a_small_table_is_broadcast_once_its_rows_are_counted(spark):
    with Scratch(spark) as s:
        assert "BroadcastHashJoin" in _plan(s, 1000)
