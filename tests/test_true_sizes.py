"""Tables of the review engine whose files are small and whose rows are many aren't broadcast."""

from pyspark.sql import functions as F

from keyloom.operators.tables import cut


def test_small_files_of_many_rows_are_not_broadcast(spark):
    big = cut(spark.range(100_000).select((F.col("id") % 1000).alias("k"), F.repeat(F.lit("x"), F.lit(200)).alias("t")))
    other = cut(spark.range(1000).select(F.col("id").alias("o")))
    assert int(str(big._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 1 << 20
    out = big.join(other, F.col("k") == F.col("o"), "right")  # only the left side can be broadcast
    assert len(out.collect()) == 100_000
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
