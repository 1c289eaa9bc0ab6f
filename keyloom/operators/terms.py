"""Term mining: n-gram document frequencies, buckets of variants, merging, and clusters of similar terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions import text as t
from .graph import connected
from .numbering import numbered
from .substrings import edit_candidates
from .tables import cut


def first_keys(pos: str, key: str, n: int, distinct: bool = False) -> Column:
    """The first n keys by position, as an aggregate; at most what the group holds is gathered, so pre-limit big groups."""
    keys = F.transform(F.array_sort(F.collect_list(F.struct(pos, key))), lambda x: x[key])
    return F.slice(F.array_distinct(keys) if distinct else keys, 1, n)


def term_occurrences(entries: DataFrame, kind: str, settings: Settings = DEFAULTS) -> DataFrame:
    """term, key, pos: each entry's distinct n-grams. kind: unigrams (without stop words), bigrams, trigrams (with whole texts of more words) or full (whole texts of two words or more).

    entries: key, value, pos.
    """
    # the words are a column of their own: inside the n-grams they would be found anew for each
    rows = entries.select("key", "pos", t.tokens(F.coalesce("value", F.lit(""))).alias("words"))
    words = F.col("words")
    if kind == "unigrams":
        stop = F.array(*[F.lit(w) for w in settings.stop_words])
        found = F.array_except(words, stop)
    elif kind == "full":
        found = F.when(F.size(words) >= 2, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>"))
    else:
        n = {"bigrams": 2, "trigrams": 3}[kind]
        found = F.array_distinct(t.ngrams(words, n))
        if kind == "trigrams":
            # whole texts of more words count among them, in the same pass; shorter ones are within a window already
            found = F.when(F.size(words) > n, F.concat(found, F.array(F.array_join(words, " ")))).otherwise(found)
    return rows.select("key", "pos", F.explode(found).alias("term"))


def extract_terms(entries: DataFrame, kind: str, min_freq: int = 2, settings: Settings = DEFAULTS) -> DataFrame:
    """term, freq (entries that have it), keys (the first of them), for terms of min_freq entries or more.

    Words repeat: of each the first keys in each task are shuffled, and frequencies are pre-aggregated apart. n-grams of several words hardly do: see _rare_terms.
    """
    rows = term_occurrences(entries, kind, settings)
    if kind != "unigrams":
        return _rare_terms(rows, min_freq, settings)
    freq = rows.groupBy("term").agg(F.count("*").alias("freq")).where(F.col("freq") >= min_freq)
    w = Window.partitionBy("term").orderBy("pos", "key")
    few = rows.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= settings.max_keys_raw)
    keys = few.groupBy("term").agg(first_keys("pos", "key", settings.max_keys_raw).alias("keys"))
    return freq.join(keys, "term").select("term", "freq", "keys")


def _rare_terms(rows: DataFrame, min_freq: int, settings: Settings) -> DataFrame:
    """term, freq, keys of occurrences (term, key, pos) most of whose terms are too rare to count.

    Each occurrence is moved and sorted once: its number among its term's tells the frequency and the first keys, and the rows around it whether there
    are enough, so rare terms are dropped before anything is gathered. Hashes stand first in the order, as they are compared faster than terms; terms
    decide. A term is a row for each entry that has it; one task reads these in order and doesn't hold them.
    """
    w = Window.partitionBy("_hash", "term").orderBy("pos", "key")
    near = F.count("*").over(w.rowsBetween(1 - min_freq, min_freq - 1))  # at least min_freq wherever a row stands among so many
    often = rows.withColumn("_hash", F.xxhash64("term")).withColumns({"_nth": F.row_number().over(w), "_near": near}).where(F.col("_near") >= min_freq)
    first = F.array_sort(F.collect_list(F.when(F.col("_nth") <= settings.max_keys_raw, F.struct("_nth", "key"))))
    return often.groupBy("_hash", "term").agg(F.max("_nth").cast("long").alias("freq"), F.transform(first, lambda x: x["key"]).alias("keys")).drop("_hash")


def extract_all(entries: DataFrame, min_freq: int = 2, settings: Settings = DEFAULTS) -> DataFrame:
    """All kinds, with ngram_type and ord (the order of mining: by kind, frequency and term)."""
    out = None
    for i, kind in enumerate(("unigrams", "bigrams", "trigrams")[: settings.max_ngram]):
        part = extract_terms(entries, kind, min_freq, settings).withColumns({"ngram_type": F.lit(kind), "kind": F.lit(i)})
        out = part if out is None else out.unionByName(part)
    return out.withColumn("ord", F.struct("kind", (-F.col("freq")).alias("f"), "term")).drop("kind")


def in_order(terms: DataFrame) -> DataFrame:
    """The terms (term, freq, ...) with rank, from 1: by frequency, then by name; terms of several kinds by kind too. Only names and frequencies are sorted. The terms are computed once."""
    terms = cut(terms)
    by = [c for c in ("term", "ngram_type") if c in terms.columns]
    nth = numbered(terms.select(*by, "freq"), [F.desc("freq"), *by], name="rank").select(*by, (F.col("rank") + 1).alias("rank"))
    return terms.join(nth, by)


def bucket_terms(terms: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Buckets of terms that are equal in lower case without white space at the ends: norm, normalized, variants, freq, keys, ngram_type, ord.

    terms: term, freq, keys, ngram_type, ord. A bucket holds the case variants of one term.
    """
    rows = terms.withColumn("norm", t.strip(F.lower("term")))
    listed = F.array_sort(F.collect_list(F.struct("ord", "term", "keys", "ngram_type")))
    b = rows.groupBy("norm").agg(listed.alias("all"), F.array_sort(F.collect_set("term")).alias("variants"), F.sum("freq").alias("freq"))
    first = F.col("all")[0]
    return b.select("norm", first["term"].alias("normalized"), "variants", "freq", _first_distinct("all", settings), first["ngram_type"].alias("ngram_type"), first["ord"].alias("ord"))


def _first_distinct(rows: str, settings: Settings) -> Column:
    return F.slice(F.array_distinct(F.flatten(F.transform(rows, lambda x: x["keys"]))), 1, settings.max_keys_per_term).alias("keys")


def merge_buckets(buckets: DataFrame, redirect: DataFrame, guard: bool = True, settings: Settings = DEFAULTS) -> DataFrame:
    """Buckets regrouped under the targets of a map (norm, target); freq becomes the number of keys.

    guard: a term isn't merged into one whose words are a proper subset or superset of its own.
    """
    rows = buckets.join(redirect.select("norm", F.col("target").alias("to")), "norm", "left")
    to = F.coalesce("to", "norm")
    if guard:
        to = F.when((to != F.col("norm")) & t.proper_subset(F.col("norm"), to), F.col("norm")).otherwise(to)
    listed = F.array_sort(F.collect_list(F.struct("ord", "variants", "keys", "ngram_type")))
    b = rows.withColumn("to", to).groupBy("to").agg(listed.alias("all"))
    variants = F.array_sort(F.array_distinct(F.flatten(F.transform("all", lambda x: x["variants"]))))
    merged = b.select(F.col("to").alias("norm"), F.col("to").alias("normalized"), variants.alias("variants"), _first_distinct("all", settings), F.col("all")[0]["ngram_type"].alias("ngram_type"), F.col("all")[0]["ord"].alias("ord"))
    return merged.withColumn("freq", F.size("keys").cast("long")).select("norm", "normalized", "variants", "freq", "keys", "ngram_type", "ord")


def cache_redirects(buckets: DataFrame, cache: DataFrame) -> DataFrame:
    """norm, target of the buckets that a cache (canonical, variants) knows under another name; the first mapping of a variant counts."""
    v = cache.select("canonical", F.explode("variants").alias("variant")).unionByName(cache.select("canonical", F.col("canonical").alias("variant")))
    w = Window.partitionBy("variant").orderBy("canonical")
    v = v.withColumn("nth", F.row_number().over(w)).where("nth = 1")
    rows = buckets.select("norm").join(v, F.col("norm") == F.col("variant")).where(F.col("canonical") != F.col("norm"))
    return rows.where(~t.proper_subset(F.col("norm"), F.col("canonical"))).select("norm", F.col("canonical").alias("target"))


def similar_pairs(terms: DataFrame, threshold: float = DEFAULTS.cluster_threshold) -> DataFrame:
    """a, b, sim of terms (id, term) at or over the threshold; a is the earlier id.

    Pairs meet by segments that so few edits leave unchanged (edit_candidates). Terms that share a word or whose lengths differ less
    than 0.4 to 1 count; a term isn't paired with one whose words are a proper subset.
    """
    pairs = edit_candidates(terms, threshold).withColumn("sim", t.similarity(F.col("ta"), F.col("tb"))).where(F.col("sim") >= threshold)
    shared = F.arrays_overlap(F.split("ta", " "), F.split("tb", " "))
    ratio = F.least(F.length("ta"), F.length("tb")) / F.greatest(F.length("ta"), F.length("tb"), F.lit(1))
    first = F.col("a") < F.col("b")
    either = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    pairs = pairs.where((shared | (ratio > 0.4)) & ~t.proper_subset(F.col("ta"), F.col("tb")))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), either("ta", "tb").alias("term_a"), either("tb", "ta").alias("term_b"), "sim")


def top_buckets(buckets: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """norm and rank (from 1) of the buckets with the most keys, at ties in the order of mining; how many is a setting of this operator."""
    order = [F.desc(F.size("keys")), F.col("ord") if "ord" in buckets.columns else F.col("norm")]
    few = buckets.orderBy(*order).limit(settings.cluster_top)
    return few.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long")).select("norm", "rank")


def cluster_terms(buckets: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Clusters of similar terms among the top buckets: norm, cluster (its first member by rank)."""
    return clusters_of(top_buckets(buckets, settings).select(F.col("rank").alias("id"), F.col("norm").alias("term")), settings.cluster_threshold)


def clusters_of(terms: DataFrame, threshold: float = DEFAULTS.cluster_threshold) -> DataFrame:
    """norm, cluster of the terms (id, term) that are similar to another, over any number of links."""
    groups = connected(similar_pairs(terms, threshold).select("a", "b"))
    name = terms.select(F.col("id").alias("root"), F.col("term").alias("cluster"))
    return groups.join(terms, groups["node"] == terms["id"]).join(name, "root").select(F.col("term").alias("norm"), "cluster")
