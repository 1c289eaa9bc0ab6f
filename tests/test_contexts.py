"""Contexts are picked without a group for each term and text."""

from pyspark.sql import functions as F

from keyloom.operators import glossary


def test_nothing_is_grouped_by_term_and_text(spark):
    rows = [(1, "a b"), (2, "a b"), (3, "a c d"), (3, "a c d"), (4, "a"), (5, "e"), (5, "e")]
    got = glossary.pick_contexts_of(spark.createDataFrame(rows, "pos long, text string").repartition(3), F.split("text", " "))
    assert sorted(tuple(r) for r in got.collect()) == [("a", 0, "a c d"), ("a", 1, "a"), ("a", 2, "a b"), ("a", 3, "a c d")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Aggregate [term" in x and "nth" not in x]
