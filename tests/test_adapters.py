"""Tables are dealt over more tasks as they grow."""

from keyloom import adapters


def test_a_table_of_one_row_group_is_many_tasks(spark, tmp_path):
    spark.range(400_000).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    df = adapters.table(spark, str(tmp_path), "part")
    sizes = df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(sizes) == 20 and max(sizes) < 30_000 and sum(sizes) == 400_000


def test_a_word_of_many_translations_meets_few(spark):
    from keyloom.operators import routing

    d = spark.range(3000).selectExpr("'red' AS origin_name", "concat('t', cast(id % 1000 AS string)) AS trans_name", "cast(id AS string) AS modid")
    got = routing.dictionary_lines(spark.createDataFrame([("k", "Red red Red")], "key string, en string"), d)
    assert [x.count("->") for x in got.toPandas()["known"]] == [3]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "2147483647" not in plan  # not all translations of a word
