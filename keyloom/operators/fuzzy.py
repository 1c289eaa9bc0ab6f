"""Translation memory: candidates that share a word beginning, ranked by relevance and then by edit distance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions import text as t
from . import recall as r
from .recall import index_tokens  # noqa: F401  what callers keep
from .recall_index import RecallIndex

# Fixed value: what stands for a translation that isn't there.
NO_TRANSLATION = "(无翻译)"


def _lists(wanted: DataFrame, memory: DataFrame, index: DataFrame | RecallIndex | None) -> tuple[DataFrame, int, float]:
    """prefix, key, tf, words of the wanted prefixes, and the number of lines and their mean words."""
    prefixes = wanted.select("prefix").distinct()
    if isinstance(index, RecallIndex):
        return r.inverted(index.matching(prefixes), index.postings()), *index.size()
    lines = index if index is not None else index_tokens(memory)
    size = lines.groupBy("key").agg(F.first("words").alias("words")).agg(F.count("*").alias("n"), F.avg("words").alias("mean")).first()
    return r.inverted(r.matching(prefixes, lines.select("token").distinct()), lines), size["n"], size["mean"]


def recall(queries: DataFrame, memory: DataFrame, index: DataFrame | RecallIndex | None = None) -> DataFrame:
    """q_key, query, key, hits, score: all lines that each query recalls, with their relevance (BM25, each word of the query being a beginning of words)."""
    asked = r.asked(queries)
    wanted = r.lists_of(asked)
    found = r.all_relevant(wanted, r.weighed(*_lists(wanted, memory, index)))
    return asked.join(found, "words").select("q_key", "query", "key", "hits", (F.col("score") / r.UNIT).alias("score"))


def recall_best(queries: DataFrame, memory: DataFrame, most: int, index: DataFrame | RecallIndex | None = None) -> DataFrame:
    """q_key, query, key, hits, score, nth: the ``most`` most relevant lines of each query, at ties those of the smallest keys."""
    asked = r.asked(queries)
    wanted = r.lists_of(asked)
    found = r.most_relevant(wanted, r.weighed(*_lists(wanted, memory, index)), most)
    return asked.join(found, "words").select("q_key", "query", "key", "hits", (F.col("score") / r.UNIT).alias("score"), "nth")


def fuzzy_search(queries: DataFrame, memory: DataFrame, settings: Settings = DEFAULTS, limit_recall: bool = True, index: DataFrame | RecallIndex | None = None, translations: DataFrame | None = None) -> DataFrame:
    """q_key, nth, similarity, key, en, zh: each query's most similar lines at or over the threshold.

    queries: q_key, query. memory: key, en, zh (unique keys; a null zh is empty). translations: key, zh, where a line has none of its
    own; one that has none there either says so. Of the candidates, the most relevant ones are compared (limit_recall),
    as many as the settings say; without the limit all that a query recalls. The top is taken before a query's own line is left out,
    which is the caller's to do. index: a memory's tokens or a kept index, where it is searched again and again.
    """
    queries = queries.where(t.strip(F.coalesce("query", F.lit(""))) != "")
    if limit_recall:
        found = recall_best(queries, memory, max(settings.recall_factor * settings.fuzzy_top, settings.recall_min), index).select("q_key", "query", "key")
    else:
        # nothing is weighed, as all are compared
        asked = r.asked(queries)
        wanted = r.lists_of(asked)
        lists, *_ = _lists(wanted, memory, index)
        found = asked.join(wanted.join(lists.select("prefix", "key"), "prefix").select("words", "key").distinct(), "words").select("q_key", "query", "key")
    if translations is not None:
        other = translations.groupBy("key").agg(F.max("zh").alias("other"))
        memory = memory.join(other, "key", "left").withColumn("zh", F.coalesce(F.nullif("zh", F.lit("")), "other", F.lit(NO_TRANSLATION)))
    rows = found.join(memory.select("key", F.coalesce("en", F.lit("")).alias("en"), F.coalesce("zh", F.lit("")).alias("zh")), "key")
    # the distance is at least the difference of lengths
    longer, shorter = F.greatest(F.length("query"), F.length("en")), F.least(F.length("query"), F.length("en"))
    rows = rows.where((100.0 * shorter) >= ((settings.fuzzy_threshold - 0.01) * longer))
    rows = rows.withColumn("similarity", t.similarity(F.col("query"), F.col("en"))).where(F.col("similarity") >= settings.fuzzy_threshold)
    w = Window.partitionBy("q_key").orderBy(F.desc("similarity"), "key")
    return rows.withColumn("nth", F.row_number().over(w).cast("int")).where(F.col("nth") <= settings.fuzzy_top).select("q_key", "nth", "similarity", "key", "en", "zh")
