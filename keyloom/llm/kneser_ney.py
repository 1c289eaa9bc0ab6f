"""Quality classification by an interpolated modified Kneser-Ney model of byte n-grams.

The model is trained on trusted texts; its counts and continuation counts are sums over shards, its
probabilities one join and one window for each length of context (groups of at most 257 rows), and each
text's n-grams are looked up in the shards. A text is rejected where its perplexity, smoothed for short texts, is
over a quantile of those of trusted texts in its language that the model has not learned from.

Trusted are labelled rows of quality 1 that aren't toxic. Half of them, by a hash of the ids, are held out; all others are learned from. Up to
SENT ids of these are sent to the tasks; where there are more, texts and ids are joined by a shuffle.
The rows that are held out set the limits: a language's limit is the median of its held-out rows and, over it, the distance from the median to the
KEPT quantile, which counts as often as the language has held-out rows, beside that of all held-out rows, which counts SHRINK times. Quantiles
are interpolated. So the rule is one at every size, and a language of few rows borrows the spread of all.

Null and empty texts are the end symbol alone and are rejected (they hold nothing). A language without
held-out texts, and null, take the quantile over all of them; without any, nothing but empty texts
is rejected. Where all trusted rows fall into one half, they are learned from and set the limits too. Repeated rows are answered each; labels for ids that don't exist do nothing; an id with
several labels is trusted if no label speaks against it; an empty table gives no rows; a long text is read whole, in slices; further
columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .ngrams import SYMBOLS, gram_answers, gram_counts, levels, make_blocks, score_blocks, with_shorter

#: Bytes of context; most ids that are sent to the tasks; the quantile of trusted rows' perplexities that is still kept.
ORDER, SENT, KEPT = 3, 200_000, 0.998
#: Share of trusted rows that is held out; rows' worth that the spread of all languages has in a language's limit.
HELD, SHRINK = 0.5, 10
#: Width of the histogram of log perplexities that quantiles are read from.
BIN = 0.001
#: Bytes of the language's median perplexity that are added to each text: a few words say little about quality.
PRIOR = 64


def discounts(n: list[int]) -> tuple[float, float, float]:
    """What is taken off counts of 1, 2 and more, by the numbers of n-grams with counts 1 to 4; within (0, count)."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    raw = [j + 1 - (j + 2) * y * n[j + 1] / n[j] if n[j] else (j + 1) / 2 for j in range(3)]
    return tuple(min(max(d, 0.05), j + 0.95) for j, d in enumerate(raw))


def log_probabilities(counts: DataFrame, order: int, scratch: Scratch) -> DataFrame:
    """code, shard, number (natural logarithm of the n-gram's last symbol after the others) of every n-gram in counts."""
    raw, below = levels(counts, order), None
    node = Window.partitionBy("ctx")
    for k in range(order + 1):
        if k < order:
            # continuation count: after how many longer contexts the symbol was seen
            cut = F.col("ctx").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("ctx")
            rows = raw[k + 1].select(cut, "sym", (F.col("c") > 0).cast("long").alias("c")).groupBy("ctx", "sym").agg(F.sum("c").alias("c"))
            rows = seen = scratch.table(rows, f"continuations{k}")
        else:
            rows = raw[k]
        d = discounts(list(rows.agg(*[F.count_if(F.col("c") == j) for j in (1, 2, 3, 4)]).first()))
        off = F.when(F.col("c") == 0, 0.0).when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        lower = F.lit(1.0 / SYMBOLS) if k == 0 else F.col("p1")
        rows = (rows if k == 0 else with_shorter(rows, below, k)).select("*", F.sum("c").over(node).alias("n"), F.sum(off).over(node).alias("freed"))
        p = F.when(F.col("n") > 0, F.try_divide(F.col("c") - off + F.col("freed") * lower, F.col("n"))).otherwise(lower)
        if k < order:
            done, below = below, scratch.table(rows.select("ctx", "sym", p.alias("p1")), f"level{k}")
            for t in (seen, done):
                if t is not None:
                    scratch.drop(t)
        else:
            return rows.select("code", "shard", F.log(p).alias("number"))


def trusted_rows(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """The distinct ids of trusted rows."""
    return labels.where(F.col(key).isNotNull()).groupBy(key).agg(F.bool_and(F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False))).alias("good")).where("good").select(key)


def trusted_ids(labels: DataFrame, key: str = "doc_id", most: int = SENT) -> np.ndarray:
    """Sorted ids of trusted rows, at most ``most`` (those with the smallest hashes): to look at, the operator takes all."""
    return np.sort(trusted_rows(labels, key).orderBy(F.xxhash64(key)).limit(most).toArrow()[key].to_numpy())


def folds(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and held (whether it is kept from the model) of each trusted id that docs has."""
    rows = docs.join(trusted_rows(labels, key).hint("shuffle_hash"), key, "left_semi").select(key).distinct()
    return rows.select(key, (F.pmod(F.xxhash64(key, F.lit("held")), F.lit(1 << 20)) < HELD * (1 << 20)).alias("held"))


def flagged(docs: DataFrame, ids: DataFrame, key: str, name: str) -> DataFrame:
    """docs with a column that says whether the key is among ids (a column of the same name, distinct). Up to SENT of them are broadcast, more are met in a shuffle."""
    few = ids.limit(SENT + 1).count() <= SENT
    ids = ids.select(F.col(key).alias("_id"), F.lit(True).alias(name)).hint("broadcast" if few else "shuffle_hash")
    return docs.join(ids, F.col(key) == F.col("_id"), "left").drop("_id").withColumn(name, F.coalesce(name, F.lit(False)))


def perplexities(docs: DataFrame, train: str, scratch: Scratch, order: int = ORDER, keys: tuple[str, ...] = ("doc_id", "lang"), text: str = "text") -> DataFrame:
    """The columns of keys, trusted (train), n_bytes, log_perplexity (natural, for each byte and the end) of each row."""
    docs = docs.select(F.struct(*keys).alias("id"), F.col(text).alias("text"), F.coalesce(F.col(train), F.lit(False)).alias("train"))
    blocks = scratch.table(make_blocks(docs, order, "id", "text", "train", lower=False, with_words=False), "blocks")
    counts = scratch.table(gram_counts(blocks), "counts")
    model = scratch.table(log_probabilities(counts, order, scratch), "model")
    scratch.drop(counts)
    answers = gram_answers(blocks, model)
    scored = score_blocks(blocks, answers, order, lambda *_: [], "id", "")
    return scored.select(*[F.col(f"id.{k}") for k in keys], F.col("flag").alias("trusted"), (F.col("n_symbols") - 1).alias("n_bytes"), (-F.col("sum_number") / F.col("n_symbols")).alias("log_perplexity"))


def quantile(bins: list[tuple[int, int]], at: float) -> float:
    """The interpolated quantile of values that are known as (bin, how many); a bin stands for its upper edge."""
    values, n = np.array(sorted(bins)).T
    place, last = at * (n.sum() - 1), np.cumsum(n) - 1
    low, high = (BIN * values[np.searchsorted(last, k)] for k in (np.floor(place), np.ceil(place)))
    return float(low + (high - low) * (place - np.floor(place)))


def limits(histogram: dict[str | None, list[tuple[int, int]]], at: float) -> tuple[dict[str, float], float | None]:
    """The limit of each language, and that of all others. histogram: bins of the held-out rows' values, by language."""
    every = [x for bins in histogram.values() for x in bins]
    if not every:
        return {}, None
    overall = quantile(every, at)
    spread, out = overall - quantile(every, 0.5), {}
    for lang, bins in histogram.items():
        if lang is not None:
            n, middle = sum(n for _, n in bins), quantile(bins, 0.5)
            out[lang] = middle + (n * (quantile(bins, at) - middle) + SHRINK * spread) / (n + SHRINK)
    return out, overall


def by_language(scored: DataFrame, value: Column) -> dict[str | None, list[tuple[int, int]]]:
    """Bins of the held-out rows' values: a number for each language and bin is all that reaches the driver."""
    out: dict[str | None, list[tuple[int, int]]] = {}
    for r in scored.where("held and n_bytes > 0").groupBy("lang", F.ceil(value / BIN).alias("bin")).agg(F.count("*").alias("n")).collect():
        out.setdefault(r["lang"], []).append((r["bin"], r["n"]))
    return out


def chosen(numbers: dict[str, float], other: float | None) -> Column:
    """The number of the row's language, or the other."""
    out = F.lit(other).cast("double")
    for lang in sorted(numbers):
        out = F.when(F.col("lang") == lang, numbers[lang]).otherwise(out)
    return out


def classify(docs: DataFrame, labels: DataFrame, scratch: Scratch, order: int = ORDER, kept: float = KEPT) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity, smoothed, threshold, keep of each row.

    smoothed: the perplexity if PRIOR more bytes had the median of the language; it is what is compared.
    """
    fold = scratch.table(folds(docs.select("doc_id"), labels), "folds")
    learned = fold.where("not held")
    if learned.isEmpty():  # a few rows that are all held out
        learned = fold
    scored = perplexities(flagged(docs.select("doc_id", "lang", "text"), learned.select("doc_id"), "doc_id", "train"), "train", scratch, order)
    known = fold.select(F.col("doc_id").alias("known"), "held").hint("shuffle_hash")
    alone = F.col("held") if not fold.where("held").isEmpty() else F.lit(True)
    scored = scored.join(known, F.col("doc_id") == F.col("known"), "left").withColumn("held", F.col("known").isNotNull() & (alone | ~F.col("trusted"))).drop("known")
    scored = scratch.table(scored, "scored")
    raw = by_language(scored, F.col("log_perplexity"))
    middle = F.coalesce(chosen({k: quantile(v, 0.5) for k, v in raw.items() if k is not None}, quantile([x for v in raw.values() for x in v], 0.5) if raw else None), F.col("log_perplexity"))
    scored = scored.withColumn("smoothed", (F.col("log_perplexity") * F.col("n_bytes") + middle * PRIOR) / (F.col("n_bytes") + PRIOR))
    limit = chosen(*limits(by_language(scored, F.col("smoothed")), kept))
    keep = (F.col("n_bytes") > 0) & F.coalesce(F.col("smoothed") <= limit, F.lit(True))
    return scored.select("doc_id", "lang", "n_bytes", F.exp("log_perplexity").alias("perplexity"), F.exp("smoothed").alias("smoothed"), F.exp(limit).alias("threshold"), keep.alias("keep"))


def quality(docs: DataFrame, labels: DataFrame, order: int = ORDER, kept: float = KEPT) -> DataFrame:
    """As classify, in scratch of its own."""
    with Scratch(docs.sparkSession) as s:
        return s.keep(classify(docs, labels, s, order, kept))
