"""Best-fit packing: pattern packing by non-negative least squares on the histogram of piece lengths.

Texts become token sequences; only those longer than a sequence are cut, into full pieces with the
shorter remainder first. Full pieces are sequences of their own. For the others the driver sees one
number for each length, however many documents there are: it enumerates patterns of two or three
lengths that fill a sequence exactly, fits repeat counts to the histogram by non-negative least
squares, rounds them down, and packs what is left by taking the longest length that still fits.
The n-th piece of a length (over all tasks, by a running sum of the tasks' counts) then takes the n-th
place that the plan has for that length, so no task needs more than its own rows.

Null and empty texts are the end token alone; ties and repeated rows take different places;
an empty table gives no rows; a text longer than a sequence is cut as said above, whole; further columns are not read.

The plan is compared with plain longest-first packing of the whole histogram, and the one with fewer sequences is taken (at equal numbers
the fitted one); so the result is never worse than what it is built on. Of a tokenizer's two forms beside each other (.json, and the same
ranks as .tiktoken) the faster is used for texts without special strings; the ids are the same.
"""

from __future__ import annotations

import base64
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bound_batches

#: Steps of the least-squares fit.
FIT_STEPS = 400

Plan = list[tuple[tuple[int, ...], int]]


class Ids:
    """Token ids as the tokenizers library gives them; texts without special strings go through tiktoken's faster code over the same ranks."""

    def __init__(self, path: str):
        self.path, self.slow = path, None
        self.fast, ranks = None, path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or "<|" in text:
            if self.slow is None:  # most workers never need it
                os.environ["TOKENIZERS_PARALLELISM"] = "false"
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.path)
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


_ids: dict[str, Ids] = {}


def _tokenizer(path: str) -> Ids:
    if path not in _ids:
        _ids[path] = Ids(path)
    return _ids[path]


def pieces_of(docs: DataFrame, tokenizer: str, size: int, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece, with the task that made it and its number among that task's pieces of this length."""
    bound_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, task int, nth long"

    def cut(batches):
        encode, task = _tokenizer(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for b in batches:
            keys, rows = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                ids = np.array([*(encode(t) if t else ()), end_id], "<u4")
                n = len(ids)
                first = n % size or size
                for p, at in enumerate([0, *range(first, n, size)]):
                    part = ids[at : first if not p else at + size]
                    k = len(part)
                    keys.append(i)
                    rows.append((p, at, k, zlib.crc32(part.tobytes()), seen[k]))
                    seen[k] += 1
            if rows:
                r = np.array(rows, np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keys)), pa.array(r[:, 0].astype(np.int32)), *(pa.array(np.ascontiguousarray(r[:, i])) for i in (1, 2, 3)), pa.array(np.full(len(r), task, np.int32)), pa.array(np.ascontiguousarray(r[:, 4]))], names=[key, "piece", "start", "length", "ids_crc32", "task", "nth"])

    return docs.select(key, text).mapInArrow(cut, schema)


def patterns(present: np.ndarray, size: int) -> np.ndarray:
    """All patterns of two or three of the lengths present that sum to size; unused third places are 0."""
    has = np.zeros(size + 1, bool)
    has[present] = True
    a, b = np.meshgrid(present, present, indexing="ij")
    a, b = a[a >= b], b[a >= b]
    c = size - a - b
    ok = (c >= 0) & (c <= b)
    a, b, c = a[ok], b[ok], c[ok]
    ok = (c == 0) | has[c]
    return np.stack([a[ok], b[ok], c[ok]], 1)


def fit(hist: np.ndarray, pats: np.ndarray, steps: int = FIT_STEPS) -> np.ndarray:
    """Non-negative repeat counts x that minimise |A x - hist|^2, longer lengths weighted more, by accelerated projected gradients."""
    size = len(hist) - 1
    w = np.sqrt(np.arange(size + 1) / size) + 0.1
    w[0] = 0

    def back(r):
        return (w * r)[pats].sum(1)

    def forth(x):
        return w * np.bincount(pats.ravel(), np.repeat(x, 3), size + 1)

    v = np.ones(len(pats))
    for _ in range(12):  # the largest eigenvalue, for the step
        v = back(forth(v))
        top = np.linalg.norm(v)
        v /= top
    x = y = np.zeros(len(pats))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - back(forth(y) - w * hist) / (1.05 * top))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def longest_first(left: np.ndarray, size: int) -> Plan:
    """Packs a histogram: a sequence starts with the longest length left and takes the longest that fits, again and again; repeated while counts last."""
    left, plan = left.copy(), []
    while left.any():
        take: list[int] = []
        room, spare = size, left.copy()
        while True:
            fits = np.flatnonzero(spare[: room + 1])
            if not len(fits):
                break
            take.append(int(fits[-1]))
            spare[fits[-1]] -= 1
            room -= int(fits[-1])
        used = np.bincount(take, minlength=size + 1)
        some = used > 0
        times = int((left[some] // used[some]).min())
        left -= used * times
        plan.append((tuple(take), times))
    return plan


def plan_packing(hist: np.ndarray) -> Plan:
    """Patterns and repeats that hold each piece of the histogram (index: length) exactly once."""
    size = len(hist) - 1
    if not hist.any():
        return []
    present = np.flatnonzero(hist)
    plan, left = [], hist.astype(np.int64).copy()
    if len(pats := patterns(present[present > 0], size)):
        x = fit(hist.astype(float), pats)
        for i in np.argsort(-x, kind="stable"):
            if x[i] < 1:
                break
            use = tuple(int(v) for v in pats[i] if v)
            need = np.bincount(use, minlength=size + 1)
            times = int(min(np.floor(x[i]), (left[need > 0] // need[need > 0]).min()))
            if times:
                left -= need * times
                plan.append((use, times))
    return plan + longest_first(left, size)


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece: key, piece, start, length, ids_crc32, sequence_id, offset.

    sequence_id: from 0 for packed sequences, negative for full pieces.
    """
    spark = docs.sparkSession
    with Scratch(spark) as s:
        made = s.table(pieces_of(docs, tokenizer, size, end_id, key, text), "pieces")
        part = made.where(F.col("length") < size)
        counts = s.table(part.groupBy("task", "length").count(), "counts")
        hist = np.zeros(size + 1, np.int64)
        for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect():  # at most size - 1 rows
            hist[r["length"]] = r["n"]
        starts, bases, places, used, base = [], [], [], np.zeros(size + 1, np.int64), 0
        for lengths, times in plan_packing(hist):
            at = 0
            for n in lengths:
                starts.append((n << 44) + int(used[n]))
                bases.append(base)
                places.append(at)
                used[n] += times
                at += n
            base += times
        order = np.argsort(np.array(starts, np.int64))
        starts, bases, places = (np.array(x, np.int64)[order] for x in (starts, bases, places))
        before = counts.withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("task")) - F.col("count")).drop("count")
        # full pieces need no place beside others, hence no join
        full = made.where(F.col("length") == size).withColumn("before", F.lit(0).cast("long"))
        rows = part.join(before, ["task", "length"]).select(full.columns).unionByName(full)
        kind = docs.schema[key].dataType.simpleString()

        def placed(batches):
            for b in batches:
                n, task, nth, ahead = (np.asarray(b.column(i), dtype=np.int64) for i in (3, 5, 6, 7))
                rank = (n << 44) + nth + ahead
                i = np.maximum(np.searchsorted(starts, rank, "right") - 1, 0) if len(starts) else np.zeros(len(n), np.int64)
                whole = n == size
                seq, off = -((task << 32) + nth) - 1, np.zeros(len(n), np.int64)
                if len(starts):
                    seq = np.where(whole, seq, bases[i] + rank - starts[i])
                    off = np.where(whole, 0, places[i])
                yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(off)], names=[*b.schema.names[:5], "sequence_id", "offset"])

        return s.keep(rows.mapInArrow(placed, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"))
