"""From terms and entries to a glossary: consensus of translations, conflicts, consistency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, FAIL, Settings
from ..functions import text as t
from .substrings import contained, containing
from .tables import by_key, cut, tasks_for

VARIANTS = "variants"


def candidate_translations(buckets: DataFrame, entries: DataFrame, settings: Settings = DEFAULTS, keys: DataFrame | None = None) -> DataFrame:
    """norm, zh, pos of the entries (key, en, zh, pos) that can tell a term's translation: keys are exploded and joined by equality.

    keys: norm, key, where a term has more keys than a row should hold.
    """
    keys = buckets.select("norm", VARIANTS, F.explode("keys").alias("key")) if keys is None else keys.join(buckets.select("norm", VARIANTS), "norm")
    zh = t.strip(F.coalesce("zh", F.lit("")))
    usable = ~t.has_any(F.col("key"), settings.description_parts) & (zh != "") & (zh != F.col("en")) & (F.length(zh) <= settings.max_zh_len) & (F.length("en") <= settings.max_en_len)
    rows = keys.join(entries.select("key", "en", "zh", "pos"), "key").where(usable)
    return rows.where(F.regexp_like("en", t.word_pattern(F.col(VARIANTS)))).select("norm", zh.alias("zh"), "key", "pos")


def histogram(candidates: DataFrame) -> DataFrame:
    """norm, zh, cnt, first (the earliest position)."""
    return candidates.groupBy("norm", F.substring("zh", 1, 120).alias("zh")).agg(F.count("*").alias("cnt"), F.min("pos").alias("first"))


def mode_translation(hist: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """norm, zh, share, total: the most frequent translation (the earliest at ties) of terms with enough candidates; agreed: whether its share suffices."""
    node = Window.partitionBy("norm")
    rows = hist.select("*", F.sum("cnt").over(node).alias("total"), F.row_number().over(node.orderBy(F.desc("cnt"), "first", "zh")).alias("nth"))
    share = F.col("cnt") / F.col("total")
    return rows.where((F.col("nth") == 1) & (F.col("total") >= settings.consensus_min_total)).select("norm", "zh", share.alias("share"), "total", (share >= settings.min_consensus).alias("agreed"))


def common_substring(hist: DataFrame, ratio: float = DEFAULTS.min_consensus) -> DataFrame:
    """norm, zh: the longest translation of two characters or more that others contain, these being a large enough share of all.

    A translation whose rarest piece isn't in so large a share meets no other.
    """
    node, hist = Window.partitionBy("norm"), cut(hist)  # read several times
    total = hist.groupBy("norm").agg(F.sum("cnt").alias("total"))
    rows = hist.where(F.length("zh") >= 2).join(total, "norm").select("norm", "zh", "first", "total", (F.col("total") * ratio).alias("need"))
    others = hist.select("norm", F.col("zh").alias("other"), F.col("cnt").alias("n"))
    support = containing(rows, others, "norm", "zh", "other", "n", "need").where(F.col("other") != F.col("zh"))
    found = support.groupBy("norm", "zh", "total", "first").agg(F.sum("n").alias("support")).where(F.col("support") / F.col("total") >= ratio)
    best = found.withColumn("nth", F.row_number().over(node.orderBy(F.desc(F.length("zh")), "first", "zh")))
    return best.where("nth = 1").select("norm", "zh")


def build_glossary(buckets: DataFrame, entries: DataFrame, settings: Settings = DEFAULTS, keys: DataFrame | None = None) -> DataFrame:
    """norm, en (the shortest variant), zh of terms with enough keys whose translation is agreed on, in whole or in part. keys: as in candidate_translations."""
    if keys is None:
        enough = buckets.where(F.size("keys") >= settings.min_freq)
    else:
        enough = buckets.join(keys.groupBy("norm").count().where(F.col("count") >= settings.min_freq).select("norm"), "norm")
    enough = enough.where(t.valid_term(F.col("norm"), settings))
    hist = cut(histogram(candidate_translations(enough, entries, settings, keys)))
    mode = mode_translation(hist, settings)
    part = common_substring(hist, settings.min_consensus).withColumnRenamed("zh", "part")
    shortest = F.array_sort(VARIANTS, lambda a, b: F.when(F.length(a) != F.length(b), F.length(a) - F.length(b)).when(a < b, -1).when(a > b, 1).otherwise(0))[0]
    rows = mode.join(part, "norm", "left").withColumn("zh", F.when(F.col("agreed"), F.col("zh")).otherwise(F.col("part"))).where("zh is not null")
    return rows.join(enough.select("norm", shortest.alias("en")), "norm").select("norm", "en", "zh")


def _containing(terms: DataFrame, *keep: str) -> DataFrame:
    """Pairs of terms (en, of one zh) of which long_en contains en, in any case: short and long with the columns of keep."""
    long = terms.select("zh", *[F.col(c).alias(f"long_{c}") for c in ("en", *keep)], F.lower("en").alias("long_low"))
    return containing(terms.select("zh", "en", *keep, F.lower("en").alias("low")), long, "zh", "low", "long_low").where(F.length("long_en") >= F.length("en")).drop("low", "long_low")


def conflicts(glossary: DataFrame) -> DataFrame:
    """short_en, long_en, zh: terms of one translation of which one contains the other. glossary: en, zh."""
    return _containing(glossary.select("en", "zh")).where(F.col("en") != F.col("long_en")).select(F.col("en").alias("short_en"), "long_en", "zh")


def resolve_conflicts(glossary: DataFrame, buckets: DataFrame, entries: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The glossary (norm, en, zh) without short terms that only repeat a longer one's translation.

    A short term is kept with another translation if its keys that the long term doesn't have agree on one.
    """
    pairs = _containing(glossary, "norm").where(F.col("norm") != F.col("long_norm")).withColumnRenamed("long_norm", "long")
    keys = buckets.select("norm", VARIANTS, "keys")
    rest = pairs.join(keys, "norm").join(keys.select(F.col("norm").alias("long"), F.col("keys").alias("long_keys")), "long", "left")
    left = rest.groupBy("norm", VARIANTS, "zh").agg(F.array_distinct(F.flatten(F.collect_list(F.coalesce("long_keys", F.array().cast("array<string>"))))).alias("taken"), F.first("keys").alias("keys"))
    left = left.select("norm", VARIANTS, F.col("zh").alias("was"), F.array_except("keys", "taken").alias("keys"))
    again = mode_translation(histogram(candidate_translations(left, entries, settings)), settings).where("agreed")
    rescued = again.join(left.select("norm", "was"), "norm").where("zh <> was").select("norm", F.col("zh").alias("new_zh"))
    return glossary.join(left.select("norm").withColumn("short", F.lit(True)), "norm", "left").join(rescued, "norm", "left").where("short is null or new_zh is not null").select("norm", "en", F.coalesce("new_zh", "zh").alias("zh"))


def term_hits(entries: DataFrame, glossary: DataFrame) -> DataFrame:
    """Entries (key, en, zh) with the glossary terms (term, variants, std_zh) whose variants they have as whole words.

    One pass over a text finds all variants that it contains, by an automaton; whether they are whole words is then checked by a pattern. Keys are unique.
    Hits and texts are dealt by key over tasks of as many entries each, whatever the number of entries.
    """
    tasks = tasks_for(entries)
    named = glossary.select("term", "std_zh", VARIANTS, F.explode(F.transform(VARIANTS, lambda v: F.lower(v))).alias("pattern")).distinct()
    met = contained(entries.select("key", F.lower("en").alias("low")), named.select("pattern"), "key", "low").join(named, "pattern")
    met = by_key(met.select("key", "term", "std_zh", VARIANTS), "key", tasks).distinct().join(by_key(entries.select("key", "en", "zh"), "key", tasks), "key")
    return met.where(F.regexp_like("en", t.word_pattern(F.col(VARIANTS)))).select("key", "en", "zh", "term", "std_zh").distinct()


def check_consistency(entries: DataFrame, glossary: DataFrame) -> DataFrame:
    """A FAIL row for each entry and term where the entry has the term but not its translation. glossary: term, variants, std_zh."""
    rows = entries.where((t.strip(F.coalesce("zh", F.lit(""))) != "") & F.col("en").isNotNull() & ~t.music_disc(F.col("key")))
    reason = F.concat(F.lit("术语不一致——“"), "term", F.lit("”在术语表中译为“"), "std_zh", F.lit("”，此处未使用"))
    return term_hits(rows, glossary).where(~F.contains("zh", "std_zh")).select("key", F.col("en").alias("en_current"), F.col("zh").alias("zh_current"), F.lit(FAIL).alias("verdict"), F.col("std_zh").alias("suggestion"), reason.alias("reason"), F.lit("terminology_check").alias("source"))


def pick_contexts(hits: DataFrame, shortest: int = 4) -> DataFrame:
    """term, nth, text: the longest and the shortest distinct texts with a term, for terms with two texts or more.

    hits: term, text, pos.
    """
    texts = hits.groupBy("text").agg(F.min("pos").alias("pos")).withColumn("of", F.sha2("text", 256))
    rows = hits.select("term", F.sha2("text", 256).alias("of"), "pos", F.length("text").alias("n"))
    rows = rows.groupBy("term", "of").agg(F.min("pos").alias("pos"), F.first("n").alias("n"))
    return _picked(rows, shortest).join(texts.select("of", "text"), "of").select("term", "nth", "text")


def pick_contexts_of(texts: DataFrame, terms: Column, shortest: int = 4) -> DataFrame:
    """As pick_contexts, of texts (pos, text) and the terms that each has.

    Of equal texts that at the first place is looked at alone, so nothing has to be grouped by term and text: terms travel no further than their task but
    for those that are picked in it. A text is moved twice.
    """
    rows = texts.withColumn("of", F.unhex(F.sha2("text", 256)))
    known = rows.join(rows.groupBy("of").agg(F.min("pos").alias("pos")), ["of", "pos"], "left_semi")
    each = known.select("of", "pos", F.length("text").alias("n"), F.explode(F.array_distinct(terms)).alias("term"))
    return _picked(each, shortest).join(known.select("of", "text").dropDuplicates(["of"]), "of").select("term", "nth", "text")


def _picked(rows: DataFrame, shortest: int) -> DataFrame:
    """term, nth, of: 0 the longest and from 1 the shortest texts of terms that have several. rows: term, of (a text's digest), pos, n (its length), which may repeat as a whole. Texts of one length go by their first place.

    Of a term's texts each task moves only the first in each order, so a term of all texts is no hot group.
    """
    w = Window.partitionBy("term")
    up = rows.withColumn("nth", F.dense_rank().over(w.orderBy("n", "pos", "of"))).where(F.col("nth") <= shortest).select("term", "nth", "of").distinct()
    down = rows.withColumn("nth", F.row_number().over(w.orderBy(F.desc("n"), F.desc("pos"), F.desc("of")))).where("nth = 1").select("term", F.lit(0).alias("nth"), "of")
    several = F.count_if(F.col("nth") == 2).over(w) > 0
    return down.unionByName(up).withColumn("several", several).where("several").drop("several")
