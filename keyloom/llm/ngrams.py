"""Counting byte n-grams of a corpus and bringing numbers about them back to each text, in shards.

Texts are put together in blocks of some MB. A block asks each shard of the n-gram space about the
n-grams that it holds, once for each distinct one, and says how often its training texts have them.
The shards add up the counts, n-gram tables are computed from the sums with DataFrame operations, and
each shard answers each block. Nothing that grows with the corpus is broadcast or sent to the driver;
what is moved is the compressed texts once and each block's distinct n-grams.

An n-gram is one long: a symbol (a byte, or 256 for the end of a text) in the lowest 9 bits, above it the
bytes before it, the nearest lowest. Before a text begins, these are zeros.

What is moved is small: sorted n-grams as differences, and all numbers byte plane by byte plane, compressed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, bound_batches, partitions_for, rechunk, release
from .textvec import LOWER, SPACES, U, mix, ragged_sum, span_hashes, texts, words

#: Bytes of text in a block, and symbols whose n-grams are made at once.
BLOCK, SLICE = 16 << 20, 1 << 20
END, SYMBOLS, BITS = 256, 257, 9
TEXT, GRAMS, WORDS = 0, 1, 2


def symbols(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes with an end symbol after each, and the texts' offsets in them."""
    soff = off + np.arange(len(off))
    s = np.empty(len(data) + len(off) - 1, np.uint16)
    at = np.ones(len(s), bool)
    at[soff[1:] - 1] = False
    s[at], s[~at] = data, END
    return s, soff


def slices(s: np.ndarray, soff: np.ndarray, order: int) -> Iterator[tuple[int, np.ndarray]]:
    """The n-grams of all symbols, in slices: first place, n-grams."""
    for a in range(0, len(s), SLICE):
        b, lo = min(a + SLICE, len(s)), max(0, a - order)
        part = s[lo:b].astype(U)
        starts = soff[np.searchsorted(soff, lo) : np.searchsorted(soff, b)] - lo
        code = part.copy()
        for j in range(1, order + 1):
            prev = np.zeros(len(part), U)
            prev[j:] = part[:-j]
            for i in range(j):  # bytes of the text before
                p = starts + i
                prev[p[p < len(part)]] = 0
            if lo == 0:
                prev[:j] = 0
            code |= prev << U(BITS + 8 * (j - 1))
        yield a, code[a - lo :]


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], (np.add.reduceat(c, first) if len(k) else c)


def _encode(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    e = pa.array(code).dictionary_encode()
    return e.dictionary.to_numpy(), e.indices.to_numpy()


def pack(x: np.ndarray, ascending: bool = False) -> bytes:
    """Numbers of 32 or 64 bits as compressed bytes: all first bytes, all second ones and so on; ascending ones as differences."""
    if ascending:
        x = np.diff(x, prepend=x.dtype.type(0))
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(packed: bytes, kind, ascending: bool = False) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    x = np.ascontiguousarray(planes.T).view(kind).ravel()
    return np.cumsum(x, dtype=kind) if ascending else x


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s, e, woff = words(data, off, ~SPACES)
    return span_hashes(data, s, e), woff


def make_blocks(docs: DataFrame, order: int, key: str, text: str, train: str, lower: bool, with_words: bool) -> DataFrame:
    """Rows of kind TEXT (keys, flags, lens, payload) and of kinds GRAMS and WORDS (shard, asked, counts), each of a block."""
    spark = docs.sparkSession
    bound_batches(spark)
    kind = docs.schema[key].dataType.simpleString()
    shards = partitions_for(spark, docs)
    names = ["block", "kind", "shard", "asked", "counts", "keys", "flags", "lens", "payload"]
    schema = f"block long, kind int, shard int, asked binary, counts binary, keys array<{kind}>, flags array<boolean>, lens binary, payload binary"

    def rows(block: int, k: int, keys: list[np.ndarray], counts: list[np.ndarray], key_type: pa.DataType) -> pa.RecordBatch:
        asked, n = _summed(keys, counts)
        to = (mix(asked) % U(shards)).astype(np.int32)
        order = np.argsort(to, kind="stable")
        asked, n, to = asked[order], n[order].astype(np.uint32), to[order]
        used, first = np.unique(to, return_index=True)
        ends = np.append(first, len(to))[1:]
        m = len(used)
        nulls = [pa.nulls(m, t) for t in (pa.list_(key_type), pa.list_(pa.bool_()), pa.binary(), pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array(np.full(m, block)), pa.array(np.full(m, k, np.int32)), pa.array(used), pa.array([pack(asked[a:b], True) for a, b in zip(first, ends, strict=True)], pa.binary()), pa.array([pack(n[a:b]) for a, b in zip(first, ends, strict=True)], pa.binary()), *nulls], names=names)

    def run(batches):
        task, nth, size = TaskContext.get().partitionId(), 0, 0
        grams, tokens, key_type = ([], []), ([], []), pa.int64()
        for b in rechunk(batches, BATCH_BYTES):
            block = task << 32 | nth
            data, off = texts(b.column(1))
            data = LOWER[data] if lower else data
            flags = pc.fill_null(b.column(2), False).to_numpy(zero_copy_only=False)
            key_type = b.column(0).type
            packed = zstandard.ZstdCompressor(level=6).compress(data.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([TEXT], pa.int32()), pa.array([0], pa.int32()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([b.column(0).to_pylist()], pa.list_(key_type)), pa.array([flags.tolist()], pa.list_(pa.bool_())), pa.array([np.diff(off).tobytes()], pa.binary()), pa.array([packed], pa.binary())], names=names)
            s, soff = symbols(data, off)
            learn = np.repeat(flags, np.diff(soff))
            for a, code in slices(s, soff, order):
                d, i = _encode(code)
                grams[0].append(d)
                grams[1].append(np.bincount(i[learn[a : a + len(code)]], minlength=len(d)).astype(np.int32))
            if with_words:
                h, woff = word_hashes(data, off)
                d, i = _encode(h)
                tokens[0].append(d)
                tokens[1].append(np.bincount(i[np.repeat(flags, np.diff(woff))], minlength=len(d)).astype(np.int32))
                tokens = tuple([x] for x in _summed(*tokens))
            grams = tuple([x] for x in _summed(*grams))
            size += len(data)
            if size >= BLOCK:
                yield rows(block, GRAMS, *grams, key_type)
                if with_words:
                    yield rows(block, WORDS, *tokens, key_type)
                grams, tokens, size, nth = ([], []), ([], []), 0, nth + 1
        if grams[0]:
            yield rows(task << 32 | nth, GRAMS, *grams, key_type)
            if with_words:
                yield rows(task << 32 | nth, WORDS, *tokens, key_type)

    return docs.select(key, text, train).mapInArrow(run, schema)


def _arrays(column: pa.ChunkedArray, kind, ascending: bool = False) -> list[np.ndarray]:
    return [unpack(x.as_py(), kind, ascending) for x in column]


def _asked(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams that blocks ask about, and the sums of their counts; folded bit by bit, so what is held is what is distinct."""
    k, c = np.zeros(0, U), np.zeros(0, np.int64)
    keys, counts, size = [], [], 0
    for a, n in zip(t["asked"], t["counts"], strict=True):
        keys.append(unpack(a.as_py(), U, True))
        counts.append(unpack(n.as_py(), np.uint32).astype(np.int64))
        size += len(keys[-1])
        if size > max(SLICE, len(k)):
            k, c = _summed([k, *keys], [c, *counts])
            keys, counts, size = [], [], 0
    return _summed([k, *keys], [c, *counts])


def gram_counts(blocks: DataFrame) -> DataFrame:
    """code, shard, c: every distinct n-gram of the corpus and how often the training texts have it."""

    def run(t: pa.Table) -> pa.Table:
        k, c = _asked(t)
        return pa.table({"code": k.view(np.int64), "shard": np.full(len(k), t["shard"][0].as_py(), np.int32), "c": c})

    return blocks.where(F.col("kind") == GRAMS).select("shard", "asked", "counts").groupBy("shard").applyInArrow(run, "code long, shard int, c long")


def gram_answers(blocks: DataFrame, numbers: DataFrame) -> DataFrame:
    """block, kind, asked, answer (doubles): each block's n-grams with their number. numbers: code, shard, number."""

    def run(asked: pa.Table, known: pa.Table) -> pa.Table:
        code, x = known["code"].to_numpy().view(U), known["number"].to_numpy()
        order = np.argsort(code)
        code, x = code[order], x[order]
        out = [pack(x[np.searchsorted(code, unpack(a.as_py(), U, True))]) for a in asked["asked"]]
        return pa.table({"block": asked["block"], "kind": pa.array([GRAMS] * len(out), pa.int32()), "asked": asked["asked"], "answer": pa.array(out, pa.binary())})

    left = blocks.where(F.col("kind") == GRAMS).select("shard", "block", "asked").groupBy("shard")
    return left.cogroup(numbers.select("shard", "code", "number").groupBy("shard")).applyInArrow(run, "block long, kind int, asked binary, answer binary")


def word_answers(blocks: DataFrame) -> DataFrame:
    """As gram_answers, the training count of each of a block's words; and a row without a block for each shard: its distinct words and count."""

    def run(t: pa.Table) -> pa.Table:
        k, c = _asked(t)
        out = [pack(c[np.searchsorted(k, unpack(a.as_py(), U, True))].astype(float)) for a in t["asked"]]
        total = pack(np.array([(c > 0).sum(), c.sum()], float))
        return pa.table({"block": pa.array([*t["block"].to_pylist(), None], pa.int64()), "kind": pa.array([WORDS] * (len(out) + 1), pa.int32()), "asked": pa.array([*t["asked"].to_pylist(), total], pa.binary()), "answer": pa.array([*out, b""], pa.binary())})

    return blocks.where(F.col("kind") == WORDS).select("shard", "block", "asked", "counts").groupBy("shard").applyInArrow(run, "block long, kind int, asked binary, answer binary")


class Answers:
    """A block's answers of one kind, by key."""

    def __init__(self, t: pa.Table, kind: int):
        rows = t.filter(pc.equal(t["kind"], kind))
        self.keys = pa.array(np.concatenate(_arrays(rows["asked"], U, True) or [np.zeros(0, U)]))
        self.values = np.concatenate(_arrays(rows["answer"], float) or [np.zeros(0)])

    def __getitem__(self, asked: np.ndarray) -> np.ndarray:
        return self.values[pc.index_in(pa.array(asked), value_set=self.keys).to_numpy()]


def score_blocks(blocks: DataFrame, answers: DataFrame, order: int, score: Callable, key: str, more: str) -> DataFrame:
    """key, flag, n_symbols and sum_number (over a text's n-grams) of each text, and the columns that score adds.

    score(data, off, word answers) gives a list of arrays, for the columns named in more.
    """
    kind = blocks.schema["keys"].dataType.elementType.simpleString()
    names = [key, "flag", "n_symbols", "sum_number", *(x.split()[0] for x in more.split(", ") if x)]

    def run(t: pa.Table, known: pa.Table) -> pa.Table:
        grams, tokens, parts = Answers(known, GRAMS), Answers(known, WORDS), []
        for r in t.to_pylist():
            n = np.frombuffer(r["lens"], np.int64)
            off = np.zeros(len(n) + 1, np.int64)
            np.cumsum(n, out=off[1:])
            data = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["payload"], int(off[-1]) or 1), np.uint8)
            s, soff = symbols(data, off)
            total = np.zeros(len(n))
            for a, code in slices(s, soff, order):
                x = grams[code]
                total += ragged_sum(x, np.clip(soff - a, 0, len(code)))
            parts.append(pa.table([pa.array(r["keys"], t.schema.field("keys").type.value_type), pa.array(r["flags"], pa.bool_()), pa.array(n + 1), pa.array(total), *map(pa.array, score(data, off, tokens))], names=names))
        grams = tokens = None
        release()
        return pa.concat_tables(parts)

    left = blocks.where(F.col("kind") == TEXT).select("block", "keys", "flags", "lens", "payload").groupBy("block")
    schema = f"`{key}` {kind}, flag boolean, n_symbols long, sum_number double" + (f", {more}" if more else "")
    return left.cogroup(answers.where("block is not null").groupBy("block")).applyInArrow(run, schema)


def levels(counts: DataFrame, order: int) -> list[DataFrame]:
    """For each length of context from 0 to order: ctx, sym, c (the sum over longer contexts); the last keeps code and shard."""
    sym = F.col("code").bitwiseAND(F.lit((1 << BITS) - 1)).cast("int").alias("sym")
    ctx = F.shiftright("code", BITS)
    low = [counts.select(ctx.bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("ctx"), sym, "c").groupBy("ctx", "sym").agg(F.sum("c").alias("c")) for k in range(order)]
    return [*low, counts.select(ctx.alias("ctx"), sym, "c", "code", "shard")]


def with_shorter(level: DataFrame, below: DataFrame, k: int) -> DataFrame:
    """The rows of a level, contexts of k bytes, with the columns of the same symbol after the context without its farthest byte."""
    cut = F.col("ctx").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))
    return level.withColumn("cut", cut).join(below.withColumnsRenamed({"ctx": "cut"}), ["cut", "sym"]).drop("cut")
