"""Phrase collocation mining by vertical positional inverted lists.

Texts are put together in blocks of some MB. Within a block, a phrase is the ascending list of the places where it
occurs; lists of phrases of k words are extended by merge-joining them with the postings of the words at the next place. Only
phrases that are frequent in the whole corpus keep their lists: a block asks a shard of the phrase space how often its phrases
occur everywhere, the shard adds up the list lengths of all blocks, which are exact frequencies, and gives numbers to those
that are frequent. A phrase of k + 1 words is looked at only where its first and its last k words are frequent.

Phrases are told apart exactly: a word by its language and bytes, a longer phrase by the numbers of the phrase without its last
word and of that word. Places have a gap where a piece or a document ends, so no phrase reaches over it. What is moved are
the block's words once, its lists, and each block's distinct phrases, compressed.

Null texts are empty; a null language is ``und``; texts and tables without words give no rows; repeated rows count each; a long text is
one block; ties go by frequency and then by the phrase's bytes; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BATCH_BYTES, Scratch, bound_batches, partitions_for, rechunk, release
from .ngrams import pack, unpack
from .textvec import LOWER, U, mix, span_hashes, texts, words

#: Least frequency of a phrase, its most words, share (in hundredths) of a longer phrase that makes a shorter one needless, and rows of a language.
LEAST, LONGEST, SHARE, TOP = 30, 4, 80, 2000
#: Bytes of text in a block, and most shards (of 64 MB each).
BLOCK, MOST_SHARDS = 16 << 20, 1 << 24

_PIECE_END = np.zeros(256, bool)
_PIECE_END[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_INSIDE = ~_PIECE_END
_INSIDE[[0x20, 0x09]] = False
LIST, ASK = 0, 1
_ROWS = "kind int, block long, shard int, lang string, names binary, keys binary, counts binary"
_SHARDED = "block long, keys binary, numbers binary, lang string, word string, before long, last long, id long, n long, total long"


def places(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and places of all words; neighbours within a piece have neighbouring places."""
    s, e, woff = words(data, off, _INSIDE)
    ends = np.flatnonzero(_PIECE_END[data])
    doc = np.repeat(np.arange(len(off) - 1), np.diff(woff))
    return s, e, np.arange(len(s)) + np.searchsorted(ends, s) + doc


def _table(schema: str, rows: list[dict]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.table({n: pa.array([r.get(n) for r in rows], kinds[k]) for n, k in (c.split() for c in schema.split(", "))})


def _tokens(docs: DataFrame, lang: str, text: str, shards: int) -> DataFrame:
    """LIST: the places and local numbers of a block's words; ASK: distinct words of a block, language and shard, their local numbers and counts."""

    def block_rows(block: int, held: dict[str, list[pa.Array]]) -> Iterator[dict]:
        at, first, all_places, all_locals = 0, 0, [], []
        for name, columns in held.items():
            data, off = texts(pa.chunked_array(columns).combine_chunks())
            data = LOWER[data]
            s, e, p = places(data, off)
            if not len(s):
                continue
            bounds = np.zeros(len(s) + 1, np.int64)
            np.cumsum(e - s, out=bounds[1:])
            bare = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(bounds), pa.py_buffer(data[_INSIDE[data]])])
            coded = bare.dictionary_encode()
            known, local = coded.dictionary, coded.indices.to_numpy()
            counts = np.bincount(local, minlength=len(known)).astype(np.uint32)
            all_places.append(p + at)
            all_locals.append((local + first).astype(np.uint32))
            at += int(p[-1]) + 2
            order = pc.array_sort_indices(known).to_numpy()
            known = known.take(pa.array(order))
            kdata, koff = texts(known)
            to = (span_hashes(kdata, koff[:-1], koff[1:]) % U(shards)).astype(np.int32)
            for k in np.unique(to):
                mine = np.flatnonzero(to == k)
                names = b"\n".join(known.take(pa.array(mine)).to_pylist())
                yield {"kind": ASK, "block": block, "shard": int(k), "lang": name, "names": zstandard.ZstdCompressor(level=3).compress(names), "keys": pack((order[mine] + first).astype(np.uint32)), "counts": pack(counts[order[mine]])}
            first += len(known)
        if all_places:
            yield {"kind": LIST, "block": block, "names": pack(np.concatenate(all_places), True), "keys": pack(np.concatenate(all_locals))}

    def run(batches):
        task, nth, size, held = TaskContext.get().partitionId(), 0, 0, {}
        for b in rechunk(batches, BATCH_BYTES):
            langs = pc.fill_null(b.column(0).cast(pa.string()), "und")
            for name in pc.unique(langs).to_pylist():
                held.setdefault(name, []).append(b.column(1).filter(pc.equal(langs, name)))
            size += b.nbytes
            if size >= BLOCK:
                yield from _table(_ROWS, list(block_rows(task << 32 | nth, held))).to_batches()
                size, nth, held = 0, nth + 1, {}
                release()
        yield from _table(_ROWS, list(block_rows(task << 32 | nth, held))).to_batches()
        release()

    return docs.select(lang, text).mapInArrow(run, _ROWS)


def _numbers(rank: np.ndarray, shards: int, shard: int) -> np.ndarray:
    out = rank * shards + shard
    if len(out) and out[-1] >> 32:
        raise ValueError("over 2**32 frequent phrases: take fewer shards or a larger least frequency")
    return out


def _word_shard(least: int, shards: int) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        shard, asks = t["shard"][0].as_py(), []
        for r in t.to_pylist():
            names = zstandard.ZstdDecompressor().decompress(r["names"]).split(b"\n")
            asks.append((r["block"], r["lang"], pa.array(names, pa.binary()), unpack(r["keys"], np.uint32), unpack(r["counts"], np.uint32)))
        out, rank = [], 0
        for name in sorted({a[1] for a in asks}):
            mine = [a for a in asks if a[1] == name]
            sums = pa.table({"w": pa.concat_arrays([a[2] for a in mine]), "c": np.concatenate([a[4] for a in mine]).astype(np.int64)}).group_by("w").aggregate([("c", "sum")])
            out.append({"lang": name, "total": pc.sum(sums["c_sum"]).as_py()})
            often = sums.filter(pc.greater_equal(sums["c_sum"], least)).sort_by("w")
            ids = _numbers(rank + np.arange(len(often)), shards, shard)
            rank += len(often)
            value_set = often["w"].combine_chunks()
            for block, _, names, keys, _ in mine:
                at = pc.index_in(names, value_set=value_set)
                ok = at.is_valid().to_numpy(zero_copy_only=False)
                if ok.any():
                    order = np.argsort(keys[ok])
                    out.append({"block": block, "keys": pack(keys[ok].astype(np.int64)[order], True), "numbers": pack(ids[at.drop_null().to_numpy()][order].astype(np.uint32))})
            out += [{"lang": name, "word": w.decode(), "id": int(i), "n": n} for w, i, n in zip(value_set.to_pylist(), ids, often["c_sum"].to_pylist(), strict=True)]
        release()
        return _table(_SHARDED, out)

    return run


def _phrase_shard(least: int, shards: int, answer: bool) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        shard, total, n = t["shard"][0].as_py(), np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, counts, size = [], [], 0

        def fold():
            k, c = np.concatenate([total, *keys]), np.concatenate([n, *counts])
            order = np.argsort(k, kind="stable")
            k, c = k[order], c[order]
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
            return k[first], (np.add.reduceat(c, first) if len(k) else c)

        for a, c in zip(t["keys"], t["counts"], strict=True):
            keys.append(unpack(a.as_py(), np.int64, True))
            counts.append(unpack(c.as_py(), np.uint32).astype(np.int64))
            size += len(keys[-1])
            if size > max(1 << 20, len(total)):
                total, n = fold()
                keys, counts, size = [], [], 0
        total, n = fold()
        keys = counts = None
        total, n = total[n >= least], n[n >= least]
        ids = _numbers(np.arange(len(total)), shards, shard)
        m, nulls = len(total), lambda k, kind: pa.nulls(k, kind)
        phrases = {"block": nulls(m, pa.int64()), "keys": nulls(m, pa.binary()), "numbers": nulls(m, pa.binary()), "lang": nulls(m, pa.string()), "word": nulls(m, pa.string()), "before": pa.array(total >> 32), "last": pa.array(total & 0xFFFFFFFF), "id": pa.array(ids), "n": pa.array(n), "total": nulls(m, pa.int64())}
        out = [pa.table(phrases)]
        if answer and m:
            rows = []
            for block, a in zip(t["block"].to_pylist(), t["keys"], strict=True):
                asked = unpack(a.as_py(), np.int64, True)
                at = np.minimum(np.searchsorted(total, asked), m - 1)
                ok = total[at] == asked
                if ok.any():
                    rows.append({"block": block, "keys": pack(asked[ok], True), "numbers": pack(ids[at[ok]].astype(np.uint32))})
            out.append(_table(_SHARDED, rows))
        release()
        return pa.concat_tables(out)

    return run


def _merged(at: np.ndarray, ids: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which wanted places (ascending) are in a list (at, ascending), and their numbers."""
    if not len(at) or not len(wanted):
        return np.zeros(len(wanted), bool), np.zeros(0, np.int64)
    i = np.minimum(np.searchsorted(at, wanted), len(at) - 1)
    ok = at[i] == wanted
    return ok, ids[i[ok]]


def extended(at: np.ndarray, ids: np.ndarray, word_at: np.ndarray, word_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and keys of the phrases of k + 1 words whose first and last k words are in the lists (at, ids)."""
    next_too, _ = _merged(at, ids, at + 1)
    p, before = at[next_too], ids[next_too]
    ok, last = _merged(word_at, word_ids, p + k)
    return p[ok], before[ok] << 32 | last


def _looked_up(keys: np.ndarray, rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are answered, and the numbers of those."""
    asked = np.concatenate([unpack(x.as_py(), np.int64, True) for x in rows["answer_keys"]] or [np.zeros(0, np.int64)])
    number = np.concatenate([unpack(x.as_py(), np.uint32).astype(np.int64) for x in rows["numbers"]] or [np.zeros(0, np.int64)])
    order = np.argsort(asked)
    return _merged(asked[order], number[order], keys)


def _step(k: int, shards: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The lists of a block's frequent phrases of k words, and what it asks about those of k + 1."""

    def lists_of(t: pa.Table, level: int) -> tuple[np.ndarray, np.ndarray]:
        mine = t.filter(pc.equal(t["shard"], level))
        if not mine.num_rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return unpack(mine["names"][0].as_py(), np.int64, True), unpack(mine["keys"][0].as_py(), np.uint32).astype(np.int64)

    def run(mine: pa.Table, answers: pa.Table) -> pa.Table:
        if not mine.num_rows:
            return _table(_ROWS, [])
        block = mine["block"][0].as_py()
        if k == 1:
            at, local = unpack(mine["names"][0].as_py(), np.int64, True), unpack(mine["keys"][0].as_py(), np.uint32).astype(np.int64)
            by_local = np.full(int(local.max()) + 1, -1, np.int64)
            for a, n in zip(answers["answer_keys"], answers["numbers"], strict=True):
                by_local[unpack(a.as_py(), np.int64, True)] = unpack(n.as_py(), np.uint32)
            ids = by_local[local]
            at, ids = at[ids >= 0], ids[ids >= 0]
            word_at, word_ids = at, ids
        else:
            word_at, word_ids = lists_of(mine, 1)
            at, ids = lists_of(mine, k - 1) if k > 2 else (word_at, word_ids)
            at, keys = extended(at, ids, word_at, word_ids, k - 1)
            order = np.argsort(keys, kind="stable")
            ok, ids = _looked_up(keys[order], answers)
            at = at[order][ok]
            order = np.argsort(at)
            at, ids = at[order], ids[order]
        rows = [{"kind": LIST, "block": block, "shard": level, "names": pack(p, True), "keys": pack(i.astype(np.uint32))} for level, p, i in {1: (1, word_at, word_ids), k: (k, at, ids)}.values() if len(p)]
        _, asked = extended(at, ids, word_at, word_ids, k)
        asked = np.sort(asked)
        first = np.flatnonzero(np.concatenate([[True], asked[1:] != asked[:-1]])) if len(asked) else np.zeros(0, np.int64)
        asked, n = asked[first], np.diff(np.append(first, len(asked)))
        to = (mix(asked.view(U)) % U(shards)).astype(np.int32)
        order = np.argsort(to, kind="stable")
        asked, n, to = asked[order], n[order].astype(np.uint32), to[order]
        used, first = np.unique(to, return_index=True)
        for s, a, b in zip(used, first, np.append(first, len(to))[1:], strict=True):
            rows.append({"kind": ASK, "block": block, "shard": int(s), "keys": pack(asked[a:b], True), "counts": pack(n[a:b])})
        release()
        return _table(_ROWS, rows)

    return run


def frequent_phrases(docs: DataFrame, scratch: Scratch, least: int = LEAST, longest: int = LONGEST, lang: str = "lang", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """lang, k, phrase, n (long) of all phrases of 1 to ``longest`` words that occur ``least`` times in their language; and lang, total (all words)."""
    bound_batches(docs.sparkSession)
    shards = partitions_for(docs.sparkSession, docs)
    if shards > MOST_SHARDS:  # of rows that don't come from files the planner knows no size
        shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = scratch.table(_tokens(docs, lang, text, shards), "tokens")
    totals = before = names = every = None
    for k in range(1, longest + 1):
        asks = rows.where(F.col("kind") == ASK).drop("kind").groupBy("shard")
        told = scratch.table(asks.applyInArrow(_word_shard(least, shards) if k == 1 else _phrase_shard(least, shards, k < longest), _SHARDED), f"shards{k}")
        if k == 1:
            totals = told.where("total is not null").groupBy("lang").agg(F.sum("total").alias("total"))
            found = told.where("id is not null").select("lang", F.lit(1).alias("k"), F.col("word").alias("phrase"), "n", "id")
            names = found.select(F.col("id").alias("last"), F.col("phrase").alias("word"))
        else:
            parts = told.where("id is not null").select("before", "last", "n", "id")
            found = parts.join(before.select(F.col("id").alias("before"), "lang", F.col("phrase").alias("head")), "before").join(names, "last").select("lang", F.lit(k).alias("k"), F.concat_ws(" ", "head", "word").alias("phrase"), "n", "id")
        found = scratch.table(found, f"phrases{k}")
        if k < longest:
            answers = told.where("block is not null").select("block", F.col("keys").alias("answer_keys"), "numbers").groupBy("block")
            step = rows.where(F.col("kind") == LIST).groupBy("block").cogroup(answers).applyInArrow(_step(k, shards), _ROWS)
            old, rows = rows, scratch.table(step, f"lists{k}")
            scratch.drop(old)
        before = found
        every = found.drop("id") if k == 1 else every.unionByName(found.drop("id"))
    return every, totals


def score(a, left, right):
    """floor(2000000 * a / (left + right)), exact for any long."""
    wide = lambda c: c.cast("decimal(20,0)")
    part = (wide(left) + wide(right)).cast("decimal(21,0)")
    whole = (wide(a) * F.lit(2_000_000).cast("decimal(7,0)")).cast("decimal(28,0)")
    return F.floor((whole - F.pmod(whole, part)) / part).cast("long")


def scored(phrases: DataFrame) -> DataFrame:
    """lang, k, phrase, a, l, r, score of the phrases of two words or more: of the cuts in two the lowest-scoring one, the earliest at ties."""
    longer = phrases.where("k > 1").withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    parts = longer.select("lang", "k", "phrase", F.col("n").alias("a"), "cut", F.expr("substring_index(phrase, ' ', cut)").alias("head"), F.expr("substring_index(phrase, ' ', cut - k)").alias("tail"))
    one = lambda name, count: phrases.select("lang", F.col("phrase").alias(name), F.col("n").alias(count))
    rows = parts.join(one("head", "l"), ["lang", "head"]).join(one("tail", "r"), ["lang", "tail"]).withColumn("score", score(F.col("a"), F.col("l"), F.col("r")))
    best = rows.groupBy("lang", "phrase").agg(F.first("k").alias("k"), F.first("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    return best.select("lang", "k", "phrase", "a", "best.l", "best.r", "best.score")


def without_parts(candidates: DataFrame, share: int = SHARE) -> DataFrame:
    """The candidates (lang, k, phrase, a) without those of whose occurrences a longer candidate that holds their words has ``share`` hundredths."""
    w = F.split("phrase", " ")
    # parts of 2 to k - 1 words: from each place, of each length
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("k") - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))))
    held = candidates.where("k > 2").select("lang", F.explode(spans).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    needless = F.coalesce(wide("longer") * 100 >= wide("a") * share, F.lit(False))
    return candidates.join(held, ["lang", "phrase"], "left").where(~needless).drop("longer")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, share: int = SHARE, top: int = TOP, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases by score, frequency and text."""
    with Scratch(docs.sparkSession) as s:
        phrases, totals = frequent_phrases(docs, s, least, longest, lang, text)
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        best = without_parts(scored(phrases), share).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
        return s.keep(best.join(totals.withColumnRenamed("total", "n"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
