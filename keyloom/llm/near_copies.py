"""Near copies by word shingles and Jaccard similarity: SimHash balls first, then a prefix filter for what they leave.

Ball hashing of SimHash fingerprints (of the same shingles) finds the closest texts cheaply, but two bits are no bound on a
similarity of 0.8. So a prefix filter makes the result whole. The distinct shingles of each text are put in one order that all texts
share; two texts of similarity t share k of the first n - ceil(t n) + k shingles of each, whatever was changed, cut or
added; so these prefixes are what is shuffled, and pairs that share fewer are let go. k is 1 to DEEP, more for longer texts. Where a text has MANY
shingles, k is a quarter of them, and only shingles whose further hash is small are looked at, which leaves a long text about as many rows as
a short one: of two similar texts KEPT shared ones or more are expected there (however much their sizes may differ), so that fewer than
DEEP are is about as likely as two 64-bit hashes being equal. The order
puts shingles last that are common in a sample of the texts: that makes groups small and changes no result.

First each text is compared with those in its balls and one neighbour at each of its shingles, in an order of the shingle's own; the
most similar one before it and the most similar one after it are verified. That costs the rows of the prefixes, and makes a crowd one
component, or nearly. The copies of one text may be similar to it and not to one another; so then each text that still meets other components is compared
with the text that has the most links, and with one neighbour in another order, at each of its shingles. Last all pairs that meet often enough and aren't connected yet are
compared; a pair is made once, at the first shingle that both have. So a large group of
copies costs its rows and not their square, and no pair that could join two components is left out. Pairs are verified: first by
an upper bound of the similarity from a bitmap of parities, which loses none, then by the similarity of their sets of
shingles. Texts and shingles that meet are told apart by 64 bits, the shingles of two texts that are compared by 32.

Copies that differ in case of A-Z or in white space only are one text. A text of fewer words than a
shingle has is one shingle; texts without words are copies of each other; null counts as empty; rows with
a null key take part, but are nobody's representative unless all of its copies have null keys; an empty
table gives no rows; a long text is read whole, and its prefix is as long as its share asks; further columns, of whatever names,
are not read but for the order's sample.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bound_batches, rechunk
from .components import components
from .simhash import ball_links, fingerprints_of
from .textvec import LOWER, SPACES, U, mix, spaced, texts, words, xxh64

SHINGLE, LEAST = 5, 0.8
#: Texts that are looked at for common shingles, and most of those that are put last: these set the order only.
SAMPLE, COMMON = 5_000, 200_000
#: Longs of the bitmap of parities (a power of two); texts of more shingles than LONG have another one, that has half a bit for each shingle at least.
BITMAP, LONG = 8, 1024
#: Differing bits of fingerprints that are compared first.
RADIUS = 2
#: Shingles that texts share in their prefixes if they are similar: one more for every STEP of their number, up to DEEP. From MANY shingles on
#: they share a quarter of that number, and of such prefixes only a share is looked at, in which KEPT shared ones at least are expected.
DEEP, STEP, MANY, KEPT = 8, 32, 512, 64
_ODD = [U((0x9E3779B97F4A7C15 * (2 * i + 1)) & (2**64 - 1)) for i in range(16)]


def _hashed(column: pa.Array, shingle: int):
    """Word hashes with each text's offsets, a hash of each whole text, and shingle hashes with their offsets."""
    data, off = texts(column)
    s, e, woff = words(LOWER[data], off, ~SPACES)
    data, s, e = spaced(LOWER[data], s, e)
    h, n = xxh64(data, s, e), np.diff(woff)
    whole = np.zeros(len(n), U)
    some = np.flatnonzero(n)
    whole[some] = xxh64(data, s[woff[some]], e[woff[some + 1] - 1])
    ns = np.where(n == 0, 0, np.maximum(1, n - shingle + 1))
    soff = np.zeros(len(n) + 1, np.int64)
    np.cumsum(ns, out=soff[1:])
    first = np.arange(soff[-1]) - np.repeat(soff[:-1], ns) + np.repeat(woff[:-1], ns)
    g, short = np.zeros(len(first), U), np.repeat(n < shingle, ns)
    for i in range(shingle):
        g += h[np.minimum(first + i, len(h) - 1)] * _ODD[i] if len(h) else U(0)
    g = mix(g)
    g[short] = np.repeat(whole, ns)[short]
    return h, woff, whole, g, soff


def common_shingles(docs: DataFrame, text: str, shingle: int) -> np.ndarray:
    """At most COMMON shingles that several texts of a sample have, the rarest first."""
    bound_batches(docs.sparkSession)
    every = max(1, docs.count() // SAMPLE)

    def run(batches):
        for b in rechunk(batches):
            *_, g, soff = _hashed(b.column(0), shingle)
            own = np.repeat(np.arange(len(soff) - 1), np.diff(soff))
            at = np.lexsort((g, own))
            g, own = g[at], own[at]
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (own[1:] != own[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(g[new].view(np.int64))], names=["g"])

    some = docs.where(F.pmod(F.xxhash64(*docs.columns), F.lit(every)) == 0).select(text)
    counts = some.mapInArrow(run, "g long").groupBy("g").count().where("count > 1").orderBy(F.desc("count"), "g").limit(COMMON)
    return counts.select("g").toArrow()["g"].to_numpy()[::-1].view(U)


def depths(n: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """How many shingles similar texts share in their prefixes, and of how many of these one is looked at.

    The larger of two similar texts, which has the smaller share, is at most 1 / least times as large.
    """
    deep = np.where(n < MANY, np.minimum(DEEP, n // STEP + 1), n // 4)
    return deep, np.maximum(1, (deep * least / KEPT + 1e-9).astype(np.int64))


def _parities(h: np.ndarray) -> np.ndarray:
    """The parities of a long text's hashes; folded in halves, they are those of a shorter bitmap."""
    size = 1 << int(np.ceil(np.log2(len(h) / 128)))
    out = np.zeros(size, U)
    np.bitwise_xor.at(out, ((h >> U(6)) % U(size)).astype(np.int64), U(1) << (h & U(63)))
    return out.view(np.int64)


def sketches(docs: DataFrame, key: str, text: str, shingle: int, least: float) -> DataFrame:
    """key, same (a hash of the text's words), n (distinct shingles), fp (fingerprint), bits (parities), more (those of a long text) and prefix of each row; one pass."""
    common = common_shingles(docs.select(key, text), text, shingle)
    by = np.argsort(common)
    known, rank = common[by], by + 1
    bound_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for b in rechunk(batches):
            _, _, whole, g, soff = _hashed(b.column(1), shingle)
            m, fp = b.num_rows, fingerprints_of(g, soff)
            own, late = np.repeat(np.arange(m), np.diff(soff)), np.zeros(len(g), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, g), len(known) - 1)
                late = np.where(known[at] == g, rank[at], 0)
            order = np.lexsort((g, late, own))
            g, own = g[order], own[order]
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (own[1:] != own[:-1])
            g, own = g[new], own[new]
            n = np.bincount(own, minlength=m)
            off = np.zeros(m + 1, np.int64)
            np.cumsum(n, out=off[1:])
            full = np.flatnonzero(n)
            bits = np.zeros((m, BITMAP), U)
            h = mix(g ^ _ODD[15])
            if len(full):
                bit, place = U(1) << (h & U(63)), (h >> U(6)) % U(BITMAP)
                for k in range(BITMAP):
                    bits[full, k] = np.bitwise_xor.reduceat(np.where(place == k, bit, U(0)), off[full])
            more = [_parities(h[off[i] : off[i + 1]]) if n[i] > LONG else None for i in range(m)]
            deep, one_of = depths(n, least)
            first = np.where(n > 0, n - np.ceil(least * n - 1e-9).astype(np.int64) + deep, 0)
            inside = np.arange(len(g)) - np.repeat(off[:-1], n) < np.repeat(first, n)
            inside &= mix(g ^ _ODD[7]) <= np.repeat(U(2**64 - 1) // one_of.astype(U), n)
            ends = np.concatenate([[0], np.cumsum(np.bincount(own[inside], minlength=m))]).astype(np.int32)
            prefix = pa.ListArray.from_arrays(pa.array(ends), pa.array(g[inside].view(np.int64)))
            parities = pa.FixedSizeListArray.from_arrays(pa.array(bits.view(np.int64).ravel()), BITMAP).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(whole.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(fp.view(np.int64)), parities, pa.array(more, pa.list_(pa.int64())), prefix], names=[key, "same", "n", "fp", "bits", "more", "prefix"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, same long, n long, fp long, bits array<long>, more array<long>, prefix array<long>")


def shingle_sets(docs: DataFrame, text: str, shingle: int) -> DataFrame:
    """same (a hash of the text's words) and shingles (distinct, by half of their hashes) of each row."""
    bound_batches(docs.sparkSession)

    def run(batches):
        for b in rechunk(batches):
            _, _, whole, g, soff = _hashed(b.column(0), shingle)
            yield pa.RecordBatch.from_arrays([pa.array(whole.view(np.int64)), pa.array([np.unique((g[soff[i] : soff[i + 1]] >> U(32)).astype(np.uint32)).view(np.int32) for i in range(b.num_rows)], pa.list_(pa.int32()))], names=["same", "shingles"])

    return docs.select(text).mapInArrow(run, "same long, shingles array<int>")


def _apart() -> Column:
    """Parities that differ between a and b: each is a shingle of one of them alone at least."""
    return sum((F.bit_count(F.col("bits_a")[k].bitwiseXOR(F.col("bits_b")[k])) for k in range(BITMAP)), F.lit(0))


def _near(least: float) -> Column:
    """Whether the sizes and the parities of a and b allow the similarity."""
    sizes = F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b") - 1e-6
    return sizes & (_apart() <= (F.col("n_a") + F.col("n_b")) * ((1 - least) / (1 + least)) + 1e-6)


def _far_apart() -> Column:
    """The same by the bitmaps of two long texts, folded to the shorter one."""
    m = F.least(F.size("more_a"), F.size("more_b"))

    def at(c: str, i: Column) -> Column:
        return F.aggregate(F.sequence(i, F.size(c) - 1, m), F.lit(0).cast("long"), lambda x, j: x.bitwiseXOR(F.col(c)[j]))

    return F.aggregate(F.sequence(F.lit(0), m - 1), F.lit(0), lambda n, i: n + F.bit_count(at("more_a", i).bitwiseXOR(at("more_b", i))))


def _side(rows: DataFrame, c: str, *more: str) -> DataFrame:
    return rows.select(F.col("same").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in more])


def meetings(distinct: DataFrame, scratch: Scratch) -> DataFrame:
    """shingle, same of the prefixes' shingles that several texts have there."""
    rows = distinct.select("same", F.explode("prefix").alias("shingle"))
    return scratch.table(rows.withColumn("texts", F.count("*").over(Window.partitionBy("shingle"))).where("texts > 1").drop("texts"), "meetings")


def plausible(pairs: DataFrame, distinct: DataFrame, least: float) -> DataFrame:
    """a, b, rep_a, rep_b, apart (differing parities) of the pairs that may be similar."""
    both = pairs.join(_side(distinct, "a", "n", "bits", "more", "rep"), "a").join(_side(distinct, "b", "n", "bits", "more", "rep"), "b").where(_near(least))
    long = F.col("more_a").isNotNull() & F.col("more_b").isNotNull()
    rows = both.select("a", "b", "rep_a", "rep_b", (F.col("n_a") + F.col("n_b")).alias("n"), F.when(long, _far_apart()).otherwise(_apart()).alias("apart"))
    return rows.where(F.col("apart") <= F.col("n") * ((1 - least) / (1 + least)) + 1e-6).drop("n")


def closest(pairs: DataFrame) -> DataFrame:
    """a, b, rep_a, rep_b: of each text's pairs, the one with the fewest differing parities in which it is a, and that in which it is b."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("x"), F.lit(True).alias("first")), F.struct(F.col("b").alias("x"), F.lit(False).alias("first"))))
    best = pairs.select(ends.alias("e"), F.struct("apart", "a", "b", "rep_a", "rep_b").alias("p")).groupBy("e").agg(F.min("p").alias("p"))
    return best.select("p.a", "p.b", "p.rep_a", "p.rep_b").distinct()


def in_balls(distinct: DataFrame, scratch: Scratch) -> DataFrame:
    """a, b: texts whose fingerprints are the same or in one ball, each with the first of its fingerprint, and these with one another."""
    first = scratch.table(distinct.groupBy("fp").agg(F.min("same").alias("first")), "fingerprints")
    copies = distinct.join(first, "fp").where("same <> first").select(F.col("same").alias("a"), F.col("first").alias("b"))
    links = ball_links(first, RADIUS, "first").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return copies.unionByName(links)


def neighbours(met: DataFrame, *salt: Column) -> DataFrame:
    """a, b: texts that are next to each other at a shingle. The order is another one at each (and for each salt), so a text has as many neighbours as shingles."""
    w = Window.partitionBy("shingle").orderBy(F.xxhash64("same", "shingle", *salt))
    rows = met.select(F.col("same").alias("x"), F.lag("same").over(w).alias("y")).where("y is not null")
    return rows.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))


def with_hubs(mixed: DataFrame, links: DataFrame) -> DataFrame:
    """a, b: at each shingle, its texts with the one that has the most links, if that is in another component."""
    n = links.select(F.explode(F.array("a", "b")).alias("same")).groupBy("same").agg(F.count("*").alias("links"))
    hub = F.max(F.struct(F.coalesce("links", F.lit(0)).alias("links"), "same", "root")).over(Window.partitionBy("shingle"))
    rows = mixed.join(n, "same", "left").select("same", "root", hub.alias("hub")).where("root <> hub.root and hub.links > 0")
    return rows.select(F.greatest("same", "hub.same").alias("a"), F.least("same", "hub.same").alias("b"))


def apart(met: DataFrame, roots: DataFrame) -> DataFrame:
    """shingle, same, root, weight of the texts that meet at a shingle where there are several components. met: shingle, same, weight.

    Of shingles that the same texts have (those of a passage that they share, say) one stands for all; weight is how many they are.
    """
    w = Window.partitionBy("shingle")
    rows = met.join(roots.select(F.col("node").alias("same"), "root"), "same", "left").withColumn("root", F.coalesce("root", "same"))
    # who is there: how many, the smallest, the largest, and all their hashes together
    who = {"n": F.count("*"), "least": F.min("same"), "most": F.max("same"), "all": F.bit_xor(F.xxhash64("same"))}
    rows = rows.select("*", F.min("root").over(w).alias("low"), F.max("root").over(w).alias("high"), *[x.over(w).alias(c) for c, x in who.items()]).where("low < high")
    one = rows.where("same = least").groupBy(*who).agg(F.min("shingle").alias("shingle"), F.sum("weight").alias("weight"))
    return rows.select("shingle", "same", "root").join(one.select("shingle", "weight"), "shingle")


def others(mixed: DataFrame, distinct: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """a, b: all pairs that meet at enough shingles, may be similar and are in different components.

    Each row has all of its text's shingles, so that a pair is made at the first that both have, and only if they are enough. The
    lowest three bits of a shingle in them are its weight, less one; more than DEEP of it says no more.
    """
    ids = mixed.withColumn("id", F.col("shingle").bitwiseAND(F.lit(-DEEP)) + F.least("weight", F.lit(DEEP)) - 1)
    of = ids.groupBy("same").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    rows = scratch.table(ids.select("id", "same", "root").join(of, "same").join(distinct.select("same", "n", "bits"), "same"), "mixed")
    more = ("id", "root", "n", "bits", "ids")
    both = F.array_intersect("ids_a", "ids_b")
    shared = F.aggregate(both, F.lit(0).cast("long"), lambda x, i: x + i.bitwiseAND(F.lit(DEEP - 1)) + 1)
    enough = shared >= F.least(F.lit(DEEP), F.floor(F.least("n_a", "n_b") / STEP) + 1)
    different = (F.col("a") > F.col("b")) & (F.col("root_a") != F.col("root_b"))
    pairs = _side(rows, "a", *more).join(_side(rows, "b", *more), (F.col("id_a") == F.col("id_b")) & different & _near(least) & (both[0] == F.col("id_a")) & enough)
    return pairs.select("a", "b")


def sets_of(reps: DataFrame, docs: DataFrame, shingle: int, key: str, text: str) -> DataFrame:
    """same, shingles of the texts of some keys (rep); a key may be null, or have other texts too."""
    keys = reps.distinct().hint("shuffle_hash")
    rows = docs.join(keys, docs[key].eqNullSafe(keys["rep"]), "left_semi").select(F.col(text).alias("text"))
    return shingle_sets(rows, "text", shingle).dropDuplicates(["same"])


def verified(pairs: DataFrame, sets: DataFrame, least: float, s: Scratch) -> DataFrame:
    """a, b: the pairs (a, b) whose sets of shingles are similar."""
    common = F.size(F.array_intersect("shingles_a", "shingles_b"))
    alike = pairs.select("a", "b").join(_side(sets, "a", "shingles"), "a").join(_side(sets, "b", "shingles"), "b")
    return s.table(alike.where(common >= least * (F.size("shingles_a") + F.size("shingles_b") - common)).select("a", "b"), "links")


def all_links(met: DataFrame, distinct: DataFrame, docs: DataFrame, shingle: int, least: float, key: str, text: str, s: Scratch) -> DataFrame:
    """a, b: similar texts, as many as make each component one."""
    pairs = s.table(closest(plausible(in_balls(distinct, s).unionByName(neighbours(met)).distinct(), distinct, least)), "candidates")
    sets = s.table(sets_of(pairs.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")), docs, shingle, key, text), "sets")
    links = verified(pairs, sets, least, s)
    s.drop(sets)
    mixed = s.table(apart(met.withColumn("weight", F.lit(1).cast("long")), components(links, s)), "apart")
    few = s.table(distinct.join(mixed.select("same").distinct(), "same", "left_semi"), "few")
    sets = s.table(sets_of(few.select("rep"), docs, shingle, key, text), "sets")
    own = mixed.select("same", "root").distinct()
    some = neighbours(mixed, F.lit("again")).unionByName(with_hubs(mixed, links)).distinct()
    some = some.join(_side(own, "a", "root"), "a").join(_side(own, "b", "root"), "b").where("root_a <> root_b").select("a", "b")
    links = links.unionByName(verified(closest(plausible(some, few, least)), sets, least, s))
    mixed = s.table(apart(mixed.select("shingle", "same", "weight"), components(links, s)), "apart")
    rest = s.table(plausible(others(mixed, few, least, s), few, least).select("a", "b"), "candidates")
    return links.unionByName(verified(rest, sets, least, s))


def near_copies(docs: DataFrame, shingle: int = SHINGLE, least: float = LEAST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and component_id (the smallest key that is reachable over copies and similar texts) of each row."""
    with Scratch(docs.sparkSession) as s:
        full = s.table(sketches(docs, key, text, shingle, least), "sketches")
        made = s.table(full.select(key, "same"), "rows")
        wide = s.table(full.groupBy("same").agg(F.min(key).alias("rep"), *[F.first(c).alias(c) for c in ("n", "fp", "bits", "more", "prefix")]), "prefixes")
        s.drop(full)
        met = meetings(wide, s)
        distinct = s.table(wide.select("same", "rep", "n", "fp", "bits", "more"), "distinct")
        s.drop(wide)
        roots = components(all_links(met, distinct, docs, shingle, least, key, text, s), s)
        lowest = roots.join(distinct.select("same", "rep"), roots["node"] == distinct["same"]).groupBy("root").agg(F.min("rep").alias("component_id"))
        linked = s.table(roots.join(lowest, "root").select(F.col("node").alias("same"), "component_id"), "linked")
        by_text = s.table(distinct.select("same", "rep").join(linked, "same", "left").select("same", F.coalesce("component_id", "rep").alias("component_id")), "by_text")
        return s.keep(made.select(key, "same").join(by_text, "same").select(key, "component_id"))
