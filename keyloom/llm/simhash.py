"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Each distinct fingerprint emits every variant within half the radius; two fingerprints within the radius
share a variant. Rows meet by a shuffle on the variant, repeated pairs are removed and the rest verified
by their true distance. Fingerprints that share a variant are at most a few dozen (the ball's size), and
with an even radius all of them are within the radius of each other; so neighbours in sorted order are
linked instead of all pairs, which loses no connection. With an odd radius, the ball of the larger half is
emitted by one copy of the fingerprint and that of the smaller half by another, and pairs are verified.

Texts with no word have fingerprint 0 (linked like any other); fewer words than a shingle has make one
shingle of all; null counts as empty; repeated rows and copies share a fingerprint; rows whose key is
null get a fingerprint and, where nothing smaller is linked, a null component; an empty table gives no rows; a long text is
read whole; further columns, of whatever names, are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bound_batches, rechunk
from .components import components
from .textvec import LOWER, SPACES, U, ragged_sum, spaced, texts, words, xxh64

#: Shingles summed in lanes of one byte.
LANE = 255


def fingerprints_of(hashes: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each range of hashes: the bits set in over half of them."""
    n = np.diff(off)
    parts = -(-n // LANE)
    poff = np.zeros(len(n) + 1, np.int64)
    np.cumsum(parts, out=poff[1:])
    inside = np.arange(poff[-1]) - np.repeat(poff[:-1], parts)
    at = np.repeat(off[:-1], parts) + LANE * inside
    out = np.zeros(len(n), U)
    if not len(at):
        return out
    for k in range(8):
        lanes = np.add.reduceat((hashes >> U(k)) & U(0x0101010101010101), at)
        per = lanes.view(np.uint8).reshape(-1, 8)
        for byte in range(8):
            count = ragged_sum(per[:, byte].astype(np.int64), poff)
            out |= (2 * count > n).astype(U) << U(8 * byte + k)
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and fingerprint (a long with the 64 bits) of each row; one pass, no shuffle."""
    bound_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for b in rechunk(batches):
            data, off = texts(b.column(1))
            s, e, woff = words(LOWER[data], off, ~SPACES)
            data, s, e = spaced(LOWER[data], s, e)
            nw = np.diff(woff)
            ns = np.where(nw == 0, 0, np.maximum(1, nw - shingle + 1))
            soff = np.zeros(len(ns) + 1, np.int64)
            np.cumsum(ns, out=soff[1:])
            first = np.arange(soff[-1]) - np.repeat(soff[:-1], ns) + np.repeat(woff[:-1], ns)
            last = np.minimum(first + shingle, np.repeat(woff[1:], ns)) - 1
            fp = fingerprints_of(xxh64(data, s[first], e[last]), soff)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=[key, "fp"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, fp long")


def _masks(radius: int) -> list[int]:
    """The xor masks of all variants within a radius, as signed longs."""
    found = [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(64), r)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def ball_links(prints: DataFrame, radius: int = 2, name: str = "fp") -> DataFrame:
    """Verified links (a, b) between distinct fingerprints that connect the same ones as all pairs within the radius do.

    prints: distinct fingerprints (fp); name: another column of theirs that links are given by instead. Rows grow as the fingerprints times the ball of half the
    radius (65 for radius 2), never as pairs.
    """
    from pyspark.sql import Window

    lower, upper = radius // 2, radius - radius // 2
    ball = lambda r: prints.select("fp", F.col(name).alias("name"), F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(m)) for m in _masks(r)])).alias("variant"))
    x = F.col("fp").alias("x"), F.col("name").alias("a")
    if lower == upper:
        w = Window.partitionBy("variant").orderBy("fp")
        pairs = ball(lower).select(*x, F.lag("fp").over(w).alias("y"), F.lag("name").over(w).alias("b")).where("y is not null")
    else:
        other = ball(upper).select(F.col("fp").alias("y"), F.col("name").alias("b"), "variant")
        pairs = ball(lower).select(*x, "variant").join(other, "variant").where("x > y")
    return pairs.where(F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= radius).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fingerprint (16 hexadecimal digits) and component_id (the smallest key that is reachable over links) of each row."""
    with Scratch(docs.sparkSession) as s:
        prints = s.table(fingerprints(docs, shingle, key, text), "fingerprints")
        rep = s.table(prints.groupBy("fp").agg(F.min(key).alias("rep")), "distinct")
        links = s.table(ball_links(rep.select("fp"), radius), "links")
        roots = components(links, s)
        # a fingerprint without links is its own component
        least = roots.join(rep, roots["node"] == rep["fp"]).groupBy("root").agg(F.min("rep").alias("component_id"))
        linked = s.table(roots.join(least, "root").select(F.col("node").alias("fp"), "component_id"), "linked")
        by_print = s.table(rep.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id")), "by_print")
        # copies make hot fingerprints; both sides are plain scans, so adaptive execution splits them
        out = prints.join(by_print, "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
        return s.keep(out)
