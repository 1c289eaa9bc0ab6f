"""A text of very many parts: its parts have one row of it, and its review is that of small texts."""

from pyspark.sql import functions as F

from keyloom.operators import routing
from keyloom.plans.review_plan import run_review
from keyloom.queries import stub


def test_texts_of_parts_are_those_of_multipart(spark):
    rows = [("a.1", "x", "1"), ("a.0", "y", None), ("b[0]", "p", "q"), ("b[1]", None, "r"), ("lone.1", "z", "z"), ("plain", "w", "w")]
    e = spark.createDataFrame(rows, "key string, en string, zh string")
    texts, keys = routing.texts_of_parts(e)
    assert sorted(keys.join(texts, "id").drop("id").collect()) == sorted(routing.multipart(e).select("key", "full_en", "full_zh").collect())
    assert texts.count() == 2


def test_a_text_of_many_parts_is_reviewed(spark):
    # 20,000 parts of 400 characters: 160 GB if each part had the whole
    n = 20_000
    e = spark.range(n).select(F.concat(F.lit("item."), F.col("id").cast("string")).alias("key"), F.repeat(F.lit("long text "), F.lit(40)).alias("en"), F.concat(F.lit("译"), F.col("id").cast("string")).alias("zh"), F.lit("m").alias("namespace"), F.col("id").alias("pos"))
    assert run_review(e, stub).merged.select("key").distinct().count() == n
