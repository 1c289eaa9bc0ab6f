"""Texts that contain others: joins by rare pieces, and automata of many patterns.

``containing`` joins short texts with long ones of the same group. A short text offers its rarest piece (of 4, 2 or 1 characters) and long texts all of
theirs, so the pairs that are compared are as many as long texts with that piece, and none of a group's texts that have nothing in common meet.

``contained`` and ``spans`` look for all patterns of a glossary in one pass over each text, by an Aho-Corasick automaton. Patterns are
dealt to shards of SHARD characters at most; a shard is what is sent to the tasks at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lengths of the pieces that texts are joined by.
PIECES = (4, 2, 1)
#: Characters of the patterns of a shard, with 16 for each pattern.
SHARD = 8 << 20


def _piece_length(text: Column) -> Column:
    n, out = F.length(text), F.lit(PIECES[-1])
    for k in sorted(PIECES[:-1]):
        out = F.when(n >= k, k).otherwise(out)
    return out


def _pieces(text: Column, k: Column) -> Column:
    """The distinct pieces of k characters, with k; none of a shorter text."""
    at = F.sequence(F.lit(1), F.length(text) - k + 1)
    found = F.array_distinct(F.transform(at, lambda i: F.struct(k.alias("k"), F.substring(text, i, k).alias("p"))))
    return F.when(F.length(text) >= k, found).otherwise(F.array().cast("array<struct<k:int,p:string>>"))


def containing(short: DataFrame, long: DataFrame, group: str, s: str, l: str, weight: str | None = None, least: str | None = None) -> DataFrame:  # noqa: E741
    """The pairs of a short row and a long row of the same group of which column l contains column s (which isn't empty).

    weight, least: a short row only counts where the weights of the long rows that contain it come to ``least``, a column of it. Rows
    whose rarest piece weighs less are left out before pairs are made; the caller still adds up what is contained.
    """
    weighs = F.col(weight) if weight else F.lit(1)
    offered = long.withColumn("_piece", F.explode(F.flatten(F.array(*[_pieces(F.col(l), F.lit(k)) for k in PIECES]))))
    have = offered.select(group, "_piece", weighs.alias("_w")).groupBy(group, "_piece").agg(F.count("*").alias("_rows"), F.sum("_w").alias("_weight"))
    rows = short.where(F.length(s) > 0).withColumn("_id", F.struct(*short.columns))
    own = _pieces(F.col(s), _piece_length(F.col(s)))
    asks = rows.select(group, "_id", F.size(own).alias("_own"), *([least] if least else []), F.explode(own).alias("_piece"))
    met = asks.join(have, [group, "_piece"])
    # a short row with a piece that no long row has is in none of them
    rarest = met.groupBy("_id").agg(F.min(F.struct("_rows", "_piece")).alias("_best"), F.min("_weight").alias("_weight"), F.count("*").alias("_found"), F.first("_own").alias("_own"), *([F.first(least).alias("_least")] if least else []))
    rarest = rarest.where(F.col("_found") == F.col("_own"))
    if least:
        rarest = rarest.where(F.col("_weight") >= F.col("_least"))
    chosen = rarest.select("_id.*", F.col("_best._piece").alias("_piece"))
    return chosen.join(offered, [group, "_piece"]).where(F.contains(l, s)).drop("_piece")


def _shards(patterns: DataFrame) -> Iterator[list[tuple]]:
    """The distinct rows of patterns (pattern, ...) shard by shard; a shard is bounded and is what the driver holds."""
    patterns = patterns.where(F.length("pattern") > 0).distinct()
    size = patterns.agg(F.sum(F.length("pattern") + 16)).first()[0] or 0
    n = int(size // SHARD + 1)
    for i in range(n):
        rows = patterns if n == 1 else patterns.where(F.pmod(F.xxhash64("pattern"), F.lit(n)) == i)
        yield [tuple(r) for r in rows.collect()]


def _scanned(texts: DataFrame, key: str, text: str, rows: list[tuple], schema: str, found: Callable) -> DataFrame:
    sent = texts.sparkSession.sparkContext.broadcast(rows)

    def run(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for row in sent.value:
            automaton.add_word(row[0], row)
        automaton.make_automaton()
        for b in batches:
            yield from found(automaton, b)

    return texts.select(key, text).mapInArrow(run, schema)


def _union(parts: list[DataFrame], empty: DataFrame) -> DataFrame:
    out = parts[0] if parts else empty
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def contained(texts: DataFrame, patterns: DataFrame, key: str, text: str) -> DataFrame:
    """key, pattern: which of the patterns (column pattern) each text has, once each. texts: key, text. Nulls and empty patterns are in none."""
    kind = texts.schema[key].dataType.simpleString()

    def found(automaton, b):
        keys, hits = [], []
        for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for w in {row[0] for _, row in automaton.iter(t)} if t else ():
                keys.append(k)
                hits.append(w)
        yield pa.RecordBatch.from_arrays([pa.array(keys, b.column(0).type), pa.array(hits, pa.string())], names=[key, "pattern"])

    schema = f"`{key}` {kind}, pattern string"
    parts = [_scanned(texts, key, text, rows, schema, found) for rows in _shards(patterns.select("pattern")) if rows]
    return _union(parts, texts.sparkSession.createDataFrame([], schema))


def spans(texts: DataFrame, patterns: DataFrame, key: str, text: str) -> DataFrame:
    """key, spans: at each place of a text where a pattern (pattern, out) begins the longest one, as (s from 1, n characters, out), in order; texts without any are left out.

    Of patterns that are equal the smallest out counts.
    """
    one = patterns.groupBy("pattern").agg(F.min("out").alias("out"))
    kind = texts.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, spans array<struct<s:int,n:int,out:string>>"
    arrow = pa.list_(pa.struct([("s", pa.int32()), ("n", pa.int32()), ("out", pa.string())]))

    def found(automaton, b):
        keys, hits = [], []
        for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            longest: dict[int, tuple[int, str]] = {}
            for end, (w, out) in automaton.iter(t) if t else ():
                at = end - len(w) + 1
                if at not in longest or longest[at][0] < len(w):
                    longest[at] = len(w), out
            if longest:
                keys.append(k)
                hits.append([{"s": at + 1, "n": n, "out": out} for at, (n, out) in sorted(longest.items())])
        yield pa.RecordBatch.from_arrays([pa.array(keys, b.column(0).type), pa.array(hits, arrow)], names=[key, "spans"])

    parts = [_scanned(texts, key, text, rows, schema, found) for rows in _shards(one) if rows]
    every = _union(parts, texts.sparkSession.createDataFrame([], schema))
    if len(parts) <= 1:
        return every
    # a place may have a pattern in several shards
    rows = every.select(key, F.explode("spans").alias("x")).groupBy(key, "x.s").agg(F.max(F.struct("x.n", "x.out")).alias("x"))
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("s", "x.n", "x.out"))).alias("spans"))


def edit_candidates(terms: DataFrame, threshold: float) -> DataFrame:
    """a, ta, b, tb: pairs of terms (id, term) that may have an edit similarity of ``threshold`` (in hundredths) or more; each pair once, a the shorter or earlier.

    With d edits at most, one of d + 1 segments of the shorter text stands unchanged in the longer one, moved by no more than what edits before and
    behind it allow. So pairs meet by (lengths, number of the segment, segment). Where so many edits are allowed that segments would be empty
    (a threshold near 50 and below), pairs of these lengths all meet.
    """
    # d of a longer length m; half a hundredth is lost in rounding similarities
    far = f"cast(floor((100.005D - {float(threshold)}D) * m / 100 + 1e-9D) as int)"
    cut = """if(far + 1 > n, array(named_struct('i', 0, 'p', 1, 'w', 0)), transform(sequence(1, far + 1), i -> named_struct('i', i,
      'p', cast((i - 1) * (n div (far + 1)) + greatest(0, i - 1 - (far + 1 - n % (far + 1))) + 1 as int), 'w', cast(n div (far + 1) as int) + if(i > far + 1 - n % (far + 1), 1, 0))))"""
    reach = f"cast(floor(length(term) * 100 / ({float(threshold)}D - 0.005D) + 1e-9D) as int)"
    x = terms.selectExpr("id as a", "term as ta", "cast(length(term) as int) as n", f"explode(sequence(cast(length(term) as int), greatest(cast(length(term) as int), {reach}))) as m").selectExpr("*", f"{far} as far").where("m - far <= n")
    x = x.selectExpr("a", "ta", "n", "m", f"explode({cut}) as g").selectExpr("a", "ta", "n", "m", "g.i as i", "substring(ta, g.p, g.w) as seg")
    y = terms.selectExpr("id as b", "term as tb", "cast(length(term) as int) as m").selectExpr("*", f"{far} as far").selectExpr("*", "explode(sequence(greatest(m - far, 0), m)) as n")
    y = y.selectExpr("*", f"explode({cut}) as g").selectExpr("b", "tb", "m", "n", "g.i as i", "g.p as p", "g.w as w", "far + 1 - g.i as behind", "m - n as more")
    ends = "greatest(1, p - (i - 1), p + more - behind)", "least(m - w + 1, p + (i - 1), p + more + behind)"
    y = y.selectExpr("*", f"{ends[0]} as lo", f"if(i = 0, 1, {ends[1]}) as hi").selectExpr("b", "tb", "m", "n", "i", "w", "explode(if(i = 0, array(1), if(hi >= lo, sequence(lo, hi), cast(array() as array<int>)))) as at")
    y = y.selectExpr("b", "tb", "n", "m", "i", "substring(tb, at, w) as seg").distinct()
    pairs = x.join(y, ["n", "m", "i", "seg"]).where("a <> b and (n < m or a < b)")
    return pairs.groupBy("a", "b").agg(F.first("ta").alias("ta"), F.first("tb").alias("tb"))

