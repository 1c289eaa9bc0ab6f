"""Language identification by nearest centroids of TF-IDF vectors of byte trigrams.

A feature is a letter's byte with its two neighbours (anything but letters counts as a blank), hashed to
DIMS places. Document frequencies are counted over all training rows. Each language has several
centroids, from spherical k-means over a bounded sample of its training rows (SAMPLE rows with the
smallest hashes of their keys). A text takes the language of the centroid with the largest cosine; it is
rejected where its distance is far over that of nearly all of the centroid's own sample; the few
trigrams of a short text give a small cosine with any centroid, so less is asked of it.

Null texts and texts without letters are ``und`` with score 0 and rejected; so is everything if no row
can be learned from. A row with a null lang is predicted but not learned; a null key counts as the empty
text for the choice of held-out rows; repeated rows are answered each; ties take the first language in
alphabetical order; a long text is read whole; an empty table gives no rows; further columns are not read, but those that are to be
kept must not be named as what is added.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, rechunk
from .textvec import LOWER, texts

DIMS = 4096
#: Rows of each language that its centroids are fitted on, and centroids.
SAMPLE, CLUSTERS = 400, 4
#: A text is rejected if its cosine is under 1 - SLACK * radius, for a text of n < FULL letters times sqrt(n / FULL).
#: The radius of a centroid: the QUANTILE of the cosine distances in its sample.
SLACK, QUANTILE, FULL = 1.6, 0.95, 400
#: Texts made into dense vectors at once.
DENSE = 256

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_PLAIN = np.where(_LETTER, np.arange(256), 0x20).astype(np.uint8)


def is_held_out(key: str, mod: int, rest: int) -> Column:
    """Whether crc32 of the key as text leaves this remainder."""
    return F.crc32(F.encode(F.coalesce(F.col(key).cast("string"), F.lit("")), "utf-8")) % mod == rest


def counts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of DIMS feature counts for each text."""
    n, out = len(off) - 1, np.zeros((len(off) - 1, DIMS), np.float32)
    if not len(data):
        return out
    d = LOWER[data]
    upper = np.flatnonzero((d[:-1] == 0xC3) & (d[1:] >= 0x80) & (d[1:] <= 0x9E) & (d[1:] != 0x97)) + 1
    d = _PLAIN[d]
    d[upper] += 0x20  # capitals of Latin-1
    at = np.flatnonzero(d != 0x20)
    left, right = np.full(len(d), 0x20, np.uint8), np.full(len(d), 0x20, np.uint8)
    left[1:], right[:-1] = d[:-1], d[1:]
    left[off[:-1][off[:-1] < len(d)]] = 0x20
    right[off[1:][off[1:] > 0] - 1] = 0x20
    code = left[at].astype(np.uint32) << 16 | d[at].astype(np.uint32) << 8 | right[at]
    feature = ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - DIMS.bit_length() + 1)).astype(np.int64)
    bounds = np.searchsorted(at, off)
    for i in range(n):  # a count for each text: no array of texts times features is made by sorting
        if bounds[i + 1] > bounds[i]:
            out[i] = np.bincount(feature[bounds[i] : bounds[i + 1]], minlength=DIMS)
    return out


def vectors(column: pa.Array, idf: np.ndarray):
    """Unit vectors (or zero) of the texts and how many letters they have, in blocks."""
    for i in range(0, len(column), DENSE):
        c = counts(*texts(column.slice(i, DENSE)))
        x = np.log1p(c) * idf
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        yield x / np.where(norm == 0, 1, norm), c.sum(1)


def _frequencies(docs: DataFrame, text: str) -> np.ndarray:
    """In how many texts each feature occurs; the last number is of the texts."""

    def run(batches):
        total = np.zeros(DIMS + 1, np.int64)
        for b in rechunk(batches):
            for i in range(0, b.num_rows, DENSE):
                c = counts(*texts(b.column(0).slice(i, DENSE)))
                total[:DIMS] += (c > 0).sum(0)
                total[DIMS] += len(c)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS + 1, dtype=np.int32)), pa.array(total)], names=["feature", "n"])

    out = np.zeros(DIMS + 1, np.int64)
    for r in docs.select(text).mapInArrow(run, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect():  # DIMS + 1 rows
        out[r["feature"]] = r["n"]
    return out


def kmeans(x: np.ndarray, k: int, steps: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids of unit vectors, from far-apart first ones, and the radius of each cluster."""
    first = [0]
    near = x @ x[0]
    while len(first) < min(k, len(x)):
        first.append(int(near.argmin()))
        near = np.maximum(near, x @ x[first[-1]])
    c = x[first].copy()
    for _ in range(steps):
        own = (x @ c.T).argmax(1)
        for j in range(len(c)):
            if (own == j).any():
                m = x[own == j].sum(0)
                c[j] = m / max(np.linalg.norm(m), 1e-12)
    cos = x @ c.T
    own = cos.argmax(1)
    used = [j for j in range(len(c)) if (own == j).any()]
    return c[used], np.array([1 - np.quantile(cos[own == j, j], 1 - QUANTILE) for j in used])


def fit(train: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, clusters: int = CLUSTERS):
    """idf, then languages, centroids and radii, from all rows' frequencies and a bounded sample's vectors."""
    train = train.select(key, text, lang).where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    df = _frequencies(train, text)
    idf = (np.log((1 + df[DIMS]) / (1 + df[:DIMS])) + 1).astype(np.float32)
    # rows of each language whose hash is small enough to leave somewhat more than the sample; then exactly the smallest
    per = {r[lang]: r["n"] for r in train.groupBy(lang).agg(F.count("*").alias("n")).collect()}
    if not per:
        return idf, [], np.zeros((0, DIMS), np.float32), np.zeros(0)
    share = F.coalesce(*[F.when(F.col(lang) == k, F.lit(min(1.0, (sample + 6 * sample**0.5) / n))) for k, n in per.items()])
    h = F.xxhash64(key, text)
    some = train.withColumn("h", h).where((F.col("h") / F.lit(2.0**64) + 0.5) <= share)
    some = some.withColumn("nth", F.row_number().over(Window.partitionBy(lang).orderBy("h"))).where(F.col("nth") <= sample).select(lang, text, "h")

    def fitted(t: pa.Table) -> pa.Table:
        t = t.sort_by("h")
        x = np.concatenate([v for v, _ in vectors(t[text].combine_chunks(), idf)])
        x = x[x.any(1)]
        c, radius = kmeans(x, clusters) if len(x) else (np.zeros((0, DIMS), np.float32), np.zeros(0))
        return pa.table({"lang": pa.array([t[lang][0].as_py()] * len(c), pa.string()), "centroid": pa.array([v.tolist() for v in c], pa.list_(pa.float32())), "radius": pa.array(radius, pa.float64())})

    rows = some.groupBy(lang).applyInArrow(fitted, "lang string, centroid array<float>, radius double").collect()  # clusters for each language
    rows.sort(key=lambda r: r["lang"])
    return idf, [r["lang"] for r in rows], np.array([r["centroid"] for r in rows], np.float32).reshape(-1, DIMS), np.array([r["radius"] for r in rows])


def identify(docs: DataFrame, train: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns of keep, lang_pred, score (cosine, 0 to 1) and rejected of each row of docs; learns from all rows of train."""
    bound_batches(docs.sparkSession)
    idf, names, centroids, radii = fit(train, key, text, lang)
    first = [key, *(c for c in keep if c != key)]
    at_text = first.index(text) if text in first else len(first)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in first) + ", lang_pred string, score double, rejected boolean"

    def run(batches):
        for b in rechunk(batches):
            column, pred, score, rejected = b.column(at_text), [], [], []
            at = 0
            for x, letters in vectors(column, idf):
                cos = x @ centroids.T if names else np.zeros((len(x), 1))
                best = cos.argmax(1)
                top = cos[np.arange(len(x)), best]
                least = (1 - SLACK * radii[best]) * np.sqrt(np.minimum(1, letters / FULL)) if names else top
                for i in range(len(x)):
                    t = column[at + i].as_py()
                    if t is None or not names or not (t.isalpha() or any(map(str.isalpha, t))):
                        pred.append("und"), score.append(0.0), rejected.append(True)
                    else:
                        pred.append(names[best[i]]), score.append(float(min(1.0, max(0.0, top[i])))), rejected.append(bool(top[i] < least[i] - 1e-6))
                at += len(x)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(first)], pa.array(pred, pa.string()), pa.array(score), pa.array(rejected)], names=[*first, "lang_pred", "score", "rejected"])

    return docs.select(*first, *([] if text in first else [text])).mapInArrow(run, schema)
