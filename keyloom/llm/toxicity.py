"""Toxicity by logistic regression, trained by FTRL-proximal over hashed word n-grams and skip-grams.

Features of a text are its distinct words, beginnings of words, pairs of neighbours, and pairs with one or two words between,
hashed to 2**BITS places. Each has a rate of its own, and L1 leaves most weights at zero; the others are few enough to be sent to every task,
at most 2**BITS numbers whatever the corpus is.

Training takes at most TRAINED labelled rows (those with the smallest hashes of their ids), in SHARDS groups, ROUNDS times: each group
goes on from the common state row by row, and the state of each place becomes the mean over the groups that changed it. Groups and their order
come from hashes of ids, so the same rows give the same weights on any cluster. Scores read all rows whole.

A null or empty text has no features and the score of the bias alone; a row with a null id or label isn't learned from; an id with several
labels is toxic if one says so; without rows of both labels nothing is learned and all scores are 0 or, if all are toxic, the bias's; repeated rows
are answered each; labels of ids that don't exist do nothing; a long text is read whole; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bound_batches, rechunk, release
from .ngrams import pack, unpack
from .textvec import LOWER, U, mix, span_hashes, texts, words

#: Bits of a feature's number; bytes of the beginnings of words; words between those of a skip-gram and of a plain pair.
BITS, STEMS, GAPS = 20, (4, 5, 6), (0, 1, 2)
#: Most rows that are learned from, groups, rounds; score from which a text counts as toxic.
TRAINED, SHARDS, ROUNDS, LIMIT = 48_000, 4, 4, 0.7
#: Of FTRL-proximal: rate, its smoothing, L1 and L2.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 3.0, 1.0
#: Numbers of the state in a row that the groups' changes are joined by.
CHUNK = 1 << 16

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _lowered(data: np.ndarray) -> np.ndarray:
    d = LOWER[data]
    if len(d):
        upper = np.flatnonzero((d[:-1] == 0xC3) & (d[1:] >= 0x80) & (d[1:] <= 0x9E) & (d[1:] != 0x97)) + 1
        d[upper] += 0x20  # capitals of Latin-1
    return d


def features(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of the texts' features, kind by kind, and which text each is of; repeats included."""
    data = _lowered(data)
    s, e, woff = words(data, off, _WORD)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(woff))
    h = span_hashes(data, s, e)
    place = lambda x, salt: (mix(x + U(salt)) >> U(64 - BITS)).astype(np.int64)
    yield place(h, 1), doc
    for n in STEMS:
        longer = np.flatnonzero(e - s > n)
        yield place(span_hashes(data, s[longer], s[longer] + n), 1 + n), doc[longer]
    for gap in GAPS:
        a, b = np.arange(max(0, len(s) - gap - 1)), np.arange(gap + 1, max(gap + 1, len(s)))
        together = doc[a] == doc[b]
        a, b = a[together], b[together]
        yield place(h[a] * U(0x9E3779B97F4A7C15) + mix(h[b]), 16 + gap), doc[a]


def sorted_distinct(x: np.ndarray) -> np.ndarray:
    """As np.unique, but by sorting, which is several times as fast where most numbers are distinct."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def distinct(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct features, ascending, and the texts' offsets into them."""
    keys = sorted_distinct(np.concatenate([d << BITS | f for f, d in features(data, off)]))
    return keys & ((1 << BITS) - 1), np.searchsorted(keys, np.arange(len(off)) << BITS)


class Ftrl:
    """The state of FTRL-proximal: z and n of each place, and of the bias (which has no L1) at the end."""

    def __init__(self, z: np.ndarray | None = None, n: np.ndarray | None = None):
        self.z = np.zeros((1 << BITS) + 1, np.float32) if z is None else z.copy()
        self.n = np.zeros((1 << BITS) + 1, np.float32) if n is None else n.copy()

    @staticmethod
    def weights(z: np.ndarray, n: np.ndarray, l1: float = L1) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, y: float) -> None:
        z, n = self.z[at].astype(float), self.n[at].astype(float)
        w = self.weights(z, n)
        zb, nb = float(self.z[-1]), float(self.n[-1])
        wb = float(self.weights(np.array(zb), np.array(nb), 0.0))
        g = 1 / (1 + np.exp(-np.clip(w.sum() + wb, -35, 35))) - y
        step = (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA
        self.z[at], self.n[at] = z + g - step * w, n + g * g
        self.z[-1], self.n[-1] = zb + g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / ALPHA * wb, nb + g * g

    def final(self) -> tuple[np.ndarray, float]:
        return self.weights(self.z[:-1], self.n[:-1]).astype(np.float32), float(self.weights(self.z[-1:], self.n[-1:], 0.0)[0])


def training_rows(docs: DataFrame, labels: DataFrame, learn: Column, most: int = TRAINED, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """_h, _y, text of at most ``most`` labelled rows that may be learned from; the ids that are sent to the tasks are as many."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("_id")).agg(F.max(F.col(label).cast("int")).alias("_y"))
    known = known.withColumn("_h", F.xxhash64("_id")).where(learn)
    n = known.count()
    if n > most:  # near the smallest hashes first, then exactly them: no sort of all ids
        known = known.where(F.col("_h") / F.lit(2.0**64) + 0.5 <= (most + 6 * most**0.5) / n)
    few = known.orderBy("_h", "_id").limit(most)
    return docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(few), F.col("_key") == F.col("_id")).select("_h", "_y", "_text")


def _packed(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """shard, h, y, at: the features of each training row, compressed."""

    def run(batches):
        for b in rechunk(batches):
            f, off = distinct(*texts(b.column(2)))
            h = b.column(0).to_numpy()
            at = [pack(f[i:j].astype(np.uint32), True) for i, j in zip(off[:-1], off[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array((mix(h.view(U)) % U(SHARDS)).astype(np.int32)), b.column(0), b.column(1), pa.array(at, pa.binary())], names=["shard", "h", "y", "at"])
        release()

    return scratch.table(rows.mapInArrow(run, "shard int, h long, y int, at binary"), "rows")


def _learner(sent, nth: int):
    def learned(t: pa.Table) -> pa.Table:
        """What one group changes in the state that was sent."""
        t = t.sort_by([("h", "ascending"), ("at", "ascending")])
        own, (z, n) = Ftrl(*sent.value), sent.value
        at, y = t["at"].to_pylist(), t["y"].to_numpy()
        for i in np.random.default_rng(nth).permutation(len(t)).tolist():
            own.learn(unpack(at[i], np.uint32, True).astype(np.int64), float(y[i]))
        moved = np.flatnonzero(own.n != n)
        cut = np.searchsorted(moved, np.arange(0, len(n) + CHUNK, CHUNK))
        spans = [(k, moved[i:j]) for k, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if j > i]
        release()
        return _changes([k for k, _ in spans], [m for _, m in spans], [own.z[m] - z[m] for _, m in spans], [own.n[m] - n[m] for _, m in spans])

    return learned


def _changes(chunks: list[int], at: list[np.ndarray], z: list[np.ndarray], n: list[np.ndarray]) -> pa.Table:
    return pa.table({"chunk": pa.array(chunks, pa.int32()), "at": pa.array([pack(x.astype(np.uint32), True) for x in at], pa.binary()), "z": pa.array([pack(x) for x in z], pa.binary()), "n": pa.array([pack(x) for x in n], pa.binary())})


def _meant(t: pa.Table) -> pa.Table:
    """The mean change of each place of a chunk over the groups that changed it."""
    k = t["chunk"][0].as_py()
    total, groups = np.zeros((2, CHUNK)), np.zeros(CHUNK)
    # in the order of their bytes, so that sums don't depend on which group ended first
    for r in sorted(t.to_pylist(), key=lambda r: (r["at"], r["z"])):
        at = unpack(r["at"], np.uint32, True).astype(np.int64) - k * CHUNK
        total[0, at] += unpack(r["z"], np.float32)
        total[1, at] += unpack(r["n"], np.float32)
        groups[at] += 1
    at = np.flatnonzero(groups)
    z, n = ((x[at] / groups[at]).astype(np.float32) for x in total)
    return _changes([k], [at + k * CHUNK], [z], [n])


def train(rows: DataFrame, scratch: Scratch) -> Ftrl:
    """The state after ROUNDS rounds over the rows (shard, h, y, at). What the driver holds is the state, of 2**BITS places."""
    state, schema = Ftrl(), "chunk int, at binary, z binary, n binary"
    for nth in range(ROUNDS):
        sent = rows.sparkSession.sparkContext.broadcast((state.z, state.n))
        changed = scratch.table(rows.groupBy("shard").applyInArrow(_learner(sent, nth), schema).groupBy("chunk").applyInArrow(_meant, schema), "changed")
        for r in changed.toLocalIterator():
            at = unpack(r["at"], np.uint32, True).astype(np.int64)
            state.z[at] += unpack(r["z"], np.float32)
            state.n[at] += unpack(r["n"], np.float32)
        scratch.drop(changed)
    return state


def score_rows(docs: DataFrame, weights: np.ndarray, bias: float, keep: tuple[str, ...], text: str = "text") -> DataFrame:
    """The columns of keep, score, and predicted (1 from LIMIT on) of each row."""
    bound_batches(docs.sparkSession)
    used = np.flatnonzero(weights)
    sent = docs.sparkSession.sparkContext.broadcast((used.astype(np.int32), weights[used]))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", score double, predicted int"

    def run(batches):
        w = np.zeros(1 << BITS, np.float32)
        w[sent.value[0]] = sent.value[1]
        for b in rechunk(batches):
            data, off = texts(b.column(len(keep)))
            some = [np.zeros(0, np.int64)]
            for f, d in features(data, off):
                hit = w[f] != 0
                some.append(d[hit] << BITS | f[hit])
            keys = sorted_distinct(np.concatenate(some))
            total = np.bincount(keys >> BITS, w[keys & ((1 << BITS) - 1)], minlength=len(off) - 1) + bias
            score = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(score), pa.array((score >= LIMIT).astype(np.int32))], names=[*keep, "score", "predicted"])
        release()

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, learn: Column, keep: tuple[str, ...] = ("doc_id",), key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = TRAINED) -> DataFrame:
    """The columns of keep, score (0 to 1) and predicted of each row of docs. learn: which ids (column _id) labels may be learned from."""
    bound_batches(docs.sparkSession)
    with Scratch(docs.sparkSession) as s:
        rows = _packed(training_rows(docs, labels, learn, most, key, text, label), s)
        state = train(rows, s)
    return score_rows(docs, *state.final(), keep, text)
