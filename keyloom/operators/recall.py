"""Recall of lines by the beginnings of their words: inverted lists in order of weight, read only as deep as a query's best lines need.

A list belongs to a beginning and holds a weight (BM25, in millionths) for each line that has a word with it. A query takes the heads of its
lists, adds up the whole weights of the lines that it meets there, and is done when none of the lines it hasn't met can be
among its best: their weights are at most those at the ends of the heads, and at equal weights their keys come later. Other queries go
deeper, and with each round by STEP. So a word that all lines have costs a head and no list, however many queries ask for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from .tables import Cut

WORD = r"(?U)[\w&&[^_]]+"
#: The usual constants of BM25, the least weight of a word that half of the lines have, and parts of one that weights are counted in.
K1, B, LEAST_IDF, UNIT = 1.2, 0.75, 1e-6, 1_000_000
#: How many times as deep the next round is; characters by which beginnings are joined (longer ones are compared then).
STEP, JOINED = 8, 16


def query_tokens(query) -> Column:
    """Words between white space, without anything but letters and digits, of two characters or more, in lower case."""
    bare = F.transform(F.split(query, r"(?U)\s+"), lambda w: F.lower(F.regexp_replace(w, r"(?U)[^\p{L}\p{N}]", "")))
    return F.array_distinct(F.filter(bare, lambda w: F.length(w) >= 2))


def index_tokens(memory: DataFrame) -> DataFrame:
    """key, token, tf, words: the distinct words of key, en and zh of each line, in lower case, how often it has each, and how many it has."""
    words = memory.select("key", t.all_matches(F.lower(F.concat_ws(" ", "key", "en", "zh")), WORD).alias("all"))
    rows = words.select("key", F.size("all").alias("words"), F.explode("all").alias("token"))
    return rows.groupBy("key", "token").agg(F.count("*").alias("tf"), F.first("words").alias("words"))


def asked(queries: DataFrame) -> DataFrame:
    """q_key, query, words: the queries with their words, in order: queries of the same words recall the same lines."""
    return queries.select("q_key", "query", F.array_sort(query_tokens(F.col("query"))).alias("words"))


def lists_of(words: DataFrame) -> DataFrame:
    """words, prefix of the distinct lists of words."""
    return words.select("words").distinct().select("words", F.explode("words").alias("prefix"))


def matching(prefixes: DataFrame, tokens: DataFrame) -> DataFrame:
    """prefix, token: the tokens that begin with each prefix (of two characters or more). A token offers its own beginnings, so none meet that don't match."""
    n = F.least(F.length("token"), F.lit(JOINED))
    offered = tokens.where(F.length("token") >= 2).select("token", F.explode(F.transform(F.sequence(F.lit(2), n), lambda i: F.substring("token", F.lit(1), i))).alias("begin"))
    return prefixes.select("prefix", F.substring("prefix", 1, JOINED).alias("begin")).join(offered, "begin").where(F.startswith("token", "prefix")).select("prefix", "token")


def inverted(known: DataFrame, lines: DataFrame) -> DataFrame:
    """prefix, key, tf, words of the lines (key, token, tf, words) that have a word with each prefix. known: prefix, token."""
    return known.join(lines, "token").groupBy("prefix", "key").agg(F.sum("tf").alias("tf"), F.first("words").alias("words"))


def weighed(lists: DataFrame, n_lines: int, mean_words: float) -> DataFrame:
    """prefix, key, weight (long): BM25 of each prefix in each line, in millionths."""
    n = lists.groupBy("prefix").agg(F.count("*").alias("n"))
    idf = F.greatest(F.log((F.lit(n_lines) - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(LEAST_IDF))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("words") / F.lit(mean_words or 1.0)))
    return lists.join(n, "prefix").select("prefix", "key", F.round(weight * UNIT).cast("long").alias("weight"))


def all_relevant(wanted: DataFrame, lists: DataFrame) -> DataFrame:
    """words, key, hits, score (in millionths) of all lines of each list of words. wanted: words, prefix. As many rows as are recalled."""
    return wanted.join(lists, "prefix").groupBy("words", "key").agg(F.count("*").alias("hits"), F.sum("weight").alias("score"))


def most_relevant(wanted: DataFrame, lists: DataFrame, most: int) -> DataFrame:
    """words, key, hits, score, nth (from 1): the ``most`` lines with the largest score, at ties the smallest keys, of each list of words.

    wanted: words, prefix. lists: prefix, key, weight. Exact: equal to ordering all_relevant, whose table isn't made.
    """
    cut, depth, found = Cut(wanted.sparkSession), most, None
    lists = cut(lists)
    size = lists.groupBy("prefix").agg(F.count("*").alias("size"))
    left = cut(wanted.join(size, "prefix"))
    by_weight = Window.partitionBy("prefix").orderBy(F.desc("weight"), "key")
    by_score = Window.partitionBy("words").orderBy(F.desc("score"), "key")
    while not left.isEmpty():
        # the limit on the row number is applied before the shuffle as well as after it, so a long list's task gets heads alone
        needed = lists.join(left.select("prefix").distinct(), "prefix", "left_semi")
        heads = cut(needed.withColumn("at", F.row_number().over(by_weight)).where(F.col("at") <= depth))
        met = left.join(heads.select("prefix", "key"), "prefix").select("words", "key").distinct()
        whole = left.select("words", "prefix").join(met, "words").join(lists, ["prefix", "key"])
        best = whole.groupBy("words", "key").agg(F.count("*").alias("hits"), F.sum("weight").alias("score"))
        best = cut(best.withColumn("nth", F.row_number().over(by_score)).where(F.col("nth") <= most))
        # what a line that wasn't met can have at most, and the largest key at the end of a head
        ends = left.join(heads.where(F.col("at") == depth).select("prefix", "weight", F.col("key").alias("end")), "prefix", "left")
        open_ = (F.col("size") > depth) & F.col("weight").isNotNull()
        bound = ends.groupBy("words").agg(F.bool_or(open_).alias("open"), F.sum(F.when(open_, F.col("weight"))).alias("bound"), F.max(F.when(open_, F.col("end"))).alias("end"))
        last = best.where(F.col("nth") == most).select("words", "score", "key")
        state = bound.join(last, "words", "left")
        sure = ~F.col("open") | F.coalesce((F.col("score") > F.col("bound")) | ((F.col("score") == F.col("bound")) & (F.col("key") <= F.col("end"))), F.lit(False))
        state = cut(state.select("words", sure.alias("sure")))
        done = best.join(state.where("sure"), "words", "left_semi")
        found = done if found is None else found.unionByName(done)
        left, depth = cut(left.join(state.where("not sure"), "words", "left_semi")), depth * STEP
    if found is None:
        return all_relevant(wanted, lists).withColumn("nth", F.lit(1)).where(F.lit(False))
    return found.select("words", "key", "hits", "score", "nth")
