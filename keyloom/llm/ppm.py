"""Language-model scoring by prediction by partial matching over bytes.

A trie of contexts of up to ``order`` bytes has, at each node, the symbols seen after it. A symbol that a
node hasn't seen is escaped to the next shorter context, where all symbols of the node are excluded;
escapes are estimated as in method D (half a count for each distinct symbol). Below the empty context,
the symbols left are equally likely.

Pretrained: every occurrence in the training texts counts at all its contexts, so the nodes of a trie are
the rows of one n-gram table for each length. As a node's symbols are among those of its shorter
contexts, what is excluded at a node is known from one sum over the node above it, and each level is one
join and one window over groups of at most 257 rows. Adaptive: each text starts with an empty trie.

Null and empty texts are the end symbol alone; repeated rows are scored each; a null key counts as the
empty text for the choice of held-out rows; with nothing to learn from, all symbols are equally likely;
further columns are not read; a long text is scored whole, in slices. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bound_batches
from .ngrams import END, SYMBOLS, Answers, gram_answers, gram_counts, levels, make_blocks, score_blocks, unpack, with_shorter, word_answers, word_hashes
from .textvec import ragged_sum

ORDER = 5


class Trie:
    """A trie of byte contexts in memory: for adaptive scoring, and as the plain form of what the tables compute."""

    def __init__(self, order: int = ORDER):
        self.order, self.nodes = order, {}

    def context(self, data: bytes, i: int) -> bytes:
        return data[max(0, i - self.order) : i].rjust(self.order, b"\0")

    def learn(self, ctx: bytes, sym: int) -> None:
        for k in range(self.order + 1):
            node = self.nodes.setdefault(ctx[self.order - k :], {})
            node[sym] = node.get(sym, 0) + 1

    def log_probability(self, ctx: bytes, sym: int) -> float:
        """Natural logarithm of the symbol's probability after the context."""
        total, out = 0.0, set()
        for k in range(self.order, -1, -1):
            seen = {s: c for s, c in self.nodes.get(ctx[self.order - k :], {}).items() if s not in out}
            if not seen:
                continue
            n = 2 * sum(seen.values())
            if sym in seen:
                return total + math.log((2 * seen[sym] - 1) / n)
            total += math.log(len(seen) / n)
            out |= set(seen)
        return total - math.log(SYMBOLS - len(out))

    def score(self, data: bytes, learn: bool) -> float:
        total = 0.0
        for i in range(len(data) + 1):
            ctx, sym = self.context(data, i), data[i] if i < len(data) else END
            total += self.log_probability(ctx, sym)
            if learn:
                self.learn(ctx, sym)
        return total


def adaptive_scores(docs: DataFrame, order: int = ORDER, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score (log10) of each row by a model that starts empty and learns as it goes along the text."""
    bound_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            out = [Trie(order).score((t or "").encode(), True) / math.log(10) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], names=[key, "score"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, score double")


def log_probabilities(counts: DataFrame, order: int, scratch: Scratch) -> DataFrame:
    """code, shard, number (natural logarithm of the n-gram's last symbol after the others) of every n-gram in counts."""
    below = None
    node = Window.partitionBy("ctx")
    for k, level in enumerate(levels(counts, order)):
        rows = level if k == 0 else with_shorter(level, below, k)
        n, d = F.sum("c").over(node), F.sum((F.col("c") > 0).cast("long")).over(node)
        if k == 0:
            rows = rows.select("*", n.alias("n"), d.alias("d")).withColumn("rest", -F.log(F.greatest(F.lit(SYMBOLS) - F.col("d"), F.lit(1))))
        else:
            # of the shorter context, what this node doesn't exclude
            q = F.sum(F.when(F.col("c") > 0, F.col("c1")).otherwise(0)).over(node)
            rows = rows.select("*", n.alias("n"), d.alias("d"), q.alias("q")).withColumn("m", 2 * (F.col("n1") - F.col("q"))).withColumn("e", F.col("d1") - F.col("d"))
            # probability of the symbol there, if this node hasn't seen it (null for those it has, where none is needed)
            escaped = F.when(F.col("e") > 0, F.log(F.try_divide("e", "m"))).otherwise(0.0) + F.col("rest1")
            rows = rows.withColumn("rest", F.when(F.col("c1") > 0, F.log(F.try_divide(2 * F.col("c1") - 1, F.col("m")))).otherwise(escaped))
        if k < order:
            done, below = below, scratch.table(rows.select("ctx", "sym", F.col("c").alias("c1"), F.col("n").alias("n1"), F.col("d").alias("d1"), F.col("rest").alias("rest1")), f"level{k}")
            if done is not None:
                scratch.drop(done)
        else:
            unseen = F.when(F.col("d") > 0, F.log(F.try_divide(F.col("d"), 2 * F.col("n")))).otherwise(0.0) + F.col("rest")
            return rows.select("code", "shard", F.when(F.col("c") > 0, F.log(F.try_divide(2 * F.col("c") - 1, 2 * F.col("n")))).otherwise(unseen).alias("number"))


def score_texts(docs: DataFrame, train: str, order: int = ORDER, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score of each row.

    train: a boolean column of the rows to learn from. A-Z is lower-cased. score: log10 of the probability
    that the model gives to the text's bytes and its end; base_score: that of words by add-one counts.
    """
    with Scratch(docs.sparkSession) as s:
        blocks = s.table(make_blocks(docs, order, key, text, train, lower=True, with_words=True), "blocks")
        counts = s.table(gram_counts(blocks), "counts")
        model = s.table(log_probabilities(counts, order, s), "model")
        s.drop(counts)
        grams = gram_answers(blocks, model)
        tokens = s.table(word_answers(blocks), "words")
        distinct = total = 0
        for r in tokens.where("block is null").select("asked").toLocalIterator():  # two numbers for each shard
            v, n = unpack(r["asked"], float)
            distinct, total = distinct + int(v), total + int(n)
        ends = docs.where(F.col(train)).count()
        distinct, total = distinct + bool(ends), total + ends
        base = lambda c: np.log10((c + 1) / (total + distinct + 1))

        def score(data: np.ndarray, off: np.ndarray, known: Answers) -> list[np.ndarray]:
            h, woff = word_hashes(data, off)
            c = known[h] if len(h) else np.zeros(0)
            n = np.diff(woff)
            return [n + 1, ragged_sum((c > 0).astype(np.int64), woff) + bool(ends), ragged_sum(base(c), woff) + base(np.float64(ends))]

        answers = grams.unionByName(tokens.where("block is not null"))
        scored = score_blocks(blocks, answers, order, score, key, "n_tokens long, n_known long, base_score double")
        return s.keep(scored.select(key, (~F.col("flag")).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", (F.col("sum_number") / math.log(10)).alias("score")))


