"""An external dictionary: translations of words, with the modules that use them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lookup(words: DataFrame, dictionary: DataFrame, lemmas: DataFrame | None = None, top: int = 3, mods: int = 5) -> DataFrame:
    """word, nth, zh, n_mods, mods: a word's translations by the number of modules that have them.

    words: word. dictionary: origin_name, trans_name, modid. lemmas: variant, canonical; a word without an
    entry of its own is looked up by its canonical form. mods names the first few modules and how many more there are.
    """
    d = dictionary.where("origin_name is not null and trans_name is not null").select(F.lower("origin_name").alias("origin"), F.col("trans_name").alias("zh"), "modid").distinct()  # so that a word of many rows meets few
    w = words.select(F.lower("word").alias("word")).distinct()
    found = w.join(d, w["word"] == d["origin"]).select("word", "zh", "modid")
    if lemmas is not None:
        first = Window.partitionBy("variant").orderBy("canonical")
        one = lemmas.select(F.lower("variant").alias("variant"), F.lower("canonical").alias("canonical")).withColumn("nth", F.row_number().over(first)).where("nth = 1")
        rest = w.join(d.select(F.col("origin").alias("word")).distinct(), "word", "left_anti")
        by_lemma = rest.join(one, rest["word"] == one["variant"]).select("word", "canonical")
        found = found.unionByName(by_lemma.join(d, by_lemma["canonical"] == d["origin"]).select("word", "zh", "modid"))
    pairs = found.distinct()
    n = pairs.groupBy("word", "zh").agg(F.count("modid").alias("n_mods"))
    ranked = n.withColumn("nth", F.row_number().over(Window.partitionBy("word").orderBy(F.desc("n_mods"), "zh")).cast("int")).where(F.col("nth") <= top)
    named = pairs.join(ranked.select("word", "zh"), ["word", "zh"]).where("modid is not null").withColumn("m", F.row_number().over(Window.partitionBy("word", "zh").orderBy("modid"))).where(F.col("m") <= mods)
    listed = named.groupBy("word", "zh").agg(F.array_sort(F.collect_list("modid")).alias("ids"))
    more = F.when(F.col("n_mods") > mods, F.concat(F.lit(" +"), (F.col("n_mods") - mods).cast("string"))).otherwise("")
    return ranked.join(listed, ["word", "zh"], "left").select("word", "nth", "zh", "n_mods", F.concat(F.concat_ws(", ", "ids"), more).alias("mods"))


def totals(dictionary: DataFrame) -> DataFrame:
    return dictionary.agg(F.count("*").alias("n_rows"), F.count_distinct(F.lower("origin_name")).alias("n_words"))
