"""Benchmark decontamination by a distributed positional inverted index.

The training texts are indexed in segments of a few MB, each a sorted dictionary of its terms (64-bit
hashes of words) and, for every term, the list of its positions; all postings of all words are stored.
A phrase starts from the list of its rarest term in the segment, shifted by that term's offset in the
phrase, and is intersected with the shifted lists of the others from rare to frequent. Proximity allows
each other term to stray from its place by a number of words. Phrases never cross from one text to the
next. Queries are sent to all segments in blocks of a bounded size, as the hashes of their words; a task makes their phrases, some
at a time. A benchmark of one block, which is the rule, is one pass over the index; what a block found is written before the next one
is sent, and the block is taken back.

Null and empty texts have no words and no hits; repeated rows are answered each, with whatever keys they
have; items without words make no phrase; a null item_id hits words but isn't counted as an item; a text longer than a segment is a
segment; an empty table of texts gives no rows, one of items no hits; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bound_batches, rechunk
from .textvec import LOWER, U, span_hashes, texts, words

#: Query items of a block, and bytes of their texts (a longer item is a block of its own): the hashes of their words are what is broadcast at once.
BLOCK_ITEMS, BLOCK_BYTES = 100_000, 16 << 20
#: Phrases that a task makes at once.
PHRASES = 1 << 17
#: Candidates intersected at once.
CANDIDATES = 1 << 19

#: Bytes of words: digits, a to z and all of non-ASCII letters, after lower-casing.
WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def hashed_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and each text's offsets into them."""
    data, off = texts(column)
    data = LOWER[data]
    s, e, woff = words(data, off, WORD)
    return span_hashes(data, s, e), woff


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """segment, keys, n_words (of the segment's texts), terms, starts, postings (binary: sorted hashes, offsets, positions)."""
    bound_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        task = TaskContext.get().partitionId()
        for n, b in enumerate(rechunk(batches)):
            h, woff = hashed_words(b.column(1))
            order = np.argsort(h, kind="stable")
            sorted_h = h[order]
            first = np.flatnonzero(np.concatenate([[True], sorted_h[1:] != sorted_h[:-1]])) if len(h) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([task << 32 | n]), pa.array([b.column(0).to_pylist()], pa.list_(b.column(0).type)), pa.array([np.diff(woff)], pa.list_(pa.int64())),
                    pa.array([sorted_h[first].tobytes()]), pa.array([np.append(first, len(h)).astype(np.uint32).tobytes()]), pa.array([order.astype(np.uint32).tobytes()]),
                ],
                names=["segment", "keys", "n_words", "terms", "starts", "postings"],
            )

    return docs.select(key, text).mapInArrow(run, f"segment long, keys array<{kind}>, n_words array<long>, terms binary, starts binary, postings binary")


class Segment:
    """A segment's lists, for searching."""

    def __init__(self, n_words: np.ndarray, terms: bytes, starts: bytes, postings: bytes):
        self.woff = np.zeros(len(n_words) + 1, np.int64)
        np.cumsum(n_words, out=self.woff[1:])
        self.terms = np.frombuffer(terms, U)
        self.starts = np.frombuffer(starts, np.uint32).astype(np.int64)
        postings = np.frombuffer(postings, np.uint32).astype(np.int64)
        self.lists = (np.repeat(np.arange(len(self.terms)), np.diff(self.starts)) << 32) | postings

    def _places(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether the term has a posting from low to high."""
        i = np.searchsorted(self.lists, (term << 32) | low)
        ok = (i < len(self.lists)) & (low <= high)
        ok[ok] = self.lists[i[ok]] <= ((term[ok] << 32) | high[ok])
        return ok

    def search(self, phrases: np.ndarray, slop: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrase number, text number and first position of each match. phrases: one row of term hashes each."""
        none = np.zeros(0, np.int64)
        if not len(phrases) or not len(self.terms):
            return none, none, none
        i = np.minimum(np.searchsorted(self.terms, phrases), len(self.terms) - 1)
        alive = np.flatnonzero((self.terms[i] == phrases).all(1))
        if not len(alive):
            return none, none, none
        t = i[alive]
        df = self.starts[t + 1] - self.starts[t]
        rare = np.argsort(df, axis=1, kind="stable")
        n = np.take_along_axis(df, rare[:, :1], 1)[:, 0]
        found, done = [], 0
        group = np.cumsum(n) // CANDIDATES
        while done < len(alive):
            to = int(np.searchsorted(group, group[done], "right"))
            rows = np.arange(done, to)
            done = to
            row = np.repeat(rows, n[rows])
            term0 = t[rows, rare[rows, 0]]
            base = np.repeat(self.starts[term0] - np.concatenate([[0], np.cumsum(n[rows])[:-1]]), n[rows]) + np.arange(len(row))
            anchor = self.lists[base] & 0xFFFFFFFF
            text = np.searchsorted(self.woff, anchor, "right") - 1
            start = anchor - rare[row, 0]
            for k in range(1, phrases.shape[1]):
                col = rare[row, k]
                at = start + col
                ok = self._places(t[row, col], np.maximum(at - slop, self.woff[text]), np.minimum(at + slop, self.woff[text + 1] - 1))
                row, start, text = row[ok], start[ok], text[ok]
                if not len(row):
                    break
            found.append((alive[row], text, np.maximum(start - self.woff[text], 0)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def windows_of(h: np.ndarray, woff: np.ndarray, size: int, terms: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The windows of all items (hashes of their words, and offsets) as rows of hashes of one length, some at a time, and the items they are of.

    A shorter item is one window. Windows with a word that isn't among the sorted terms are left out.
    """
    if not len(terms) or not len(h):
        return
    n, absent = np.diff(woff), np.zeros(len(h) + 1, np.int64)
    np.cumsum((terms[np.minimum(np.searchsorted(terms, h), len(terms) - 1)] != h).astype(np.int64), out=absent[1:])
    for length in np.unique(np.minimum(n, size)):
        items = np.flatnonzero(np.minimum(n, size) == length)
        if not length:
            continue
        each = n[items] - length + 1
        first = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(woff[items], each)
        full = absent[first + length] == absent[first]
        first, of = first[full], np.repeat(items, each)[full]
        for i in range(0, len(first), PHRASES):
            yield h[first[i : i + PHRASES, None] + np.arange(length)], of[i : i + PHRASES]


def _blocks(items: DataFrame, scratch: Scratch, key: str, text: str) -> Iterator[pa.Table]:
    """The items in blocks of bounded count and bytes, each brought to the driver alone."""
    kept = scratch.table(items.select(F.col(key).cast("string").alias("item"), F.col(text).alias("text")).where("text is not null and text <> ''").withColumn("n", F.octet_length("text")), "items")
    rows, size = kept.agg(F.count("*"), F.sum("n")).first()
    if not rows:
        return
    parts = max(-(-rows // BLOCK_ITEMS), -(-size // BLOCK_BYTES))
    if parts == 1:
        yield kept.select("item", "text").toArrow()
        return
    blocks = scratch.table(kept.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(parts))), "blocks")
    for k in range(parts):
        yield blocks.where(F.col("block") == k).select("item", "text").toArrow()


def find_phrases(index: DataFrame, items: DataFrame, scratch: Scratch, window: int = 10, slop: int = 0, item_key: str = "item_id", text: str = "text") -> DataFrame:
    """Matches of the items' windows: segment, row (of the text in its segment), items (those with a match), ranges (disjoint, of the words hit)."""
    spark, out = index.sparkSession, None
    for block in _blocks(items, scratch, item_key, text):
        shipped = spark.sparkContext.broadcast((*hashed_words(block["text"].combine_chunks()), block["item"].to_pylist()))

        def run(batches, shipped=shipped):
            h, woff, names = shipped.value
            for b in batches:
                for r in b.to_pylist():
                    seg = Segment(np.array(r["n_words"], np.int64), r["terms"], r["starts"], r["postings"])
                    hits = []
                    for w, item in windows_of(h, woff, window, seg.terms):
                        p, t, at = seg.search(w, slop)
                        hits.append(np.stack([t, at, np.minimum(at + w.shape[1], seg.woff[t + 1] - seg.woff[t]), item[p]], 1))
                    hits = np.concatenate(hits) if hits else np.zeros((0, 4), np.int64)
                    hits = hits[np.lexsort((hits[:, 1], hits[:, 0]))]
                    row, found, ranges = [], [], []
                    for t in np.unique(hits[:, 0]):
                        own = hits[hits[:, 0] == t]
                        ends = np.maximum.accumulate(own[:, 2])
                        new = np.concatenate([[True], own[1:, 1] > ends[:-1]])
                        row.append(int(t))
                        ranges.append([{"s": int(a), "e": int(z)} for a, z in zip(own[new, 1], np.append(ends[:-1][new[1:]], ends[-1]), strict=True)])
                        found.append(sorted({names[i] for i in own[:, 3]} - {None}))
                    if row:
                        yield pa.RecordBatch.from_arrays([pa.array([r["segment"]] * len(row)), pa.array(row, pa.int32()), pa.array(found, pa.list_(pa.string())), pa.array(ranges, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))], names=["segment", "row", "items", "ranges"])

        got = index.select("segment", "n_words", "terms", "starts", "postings").mapInArrow(run, "segment long, row int, items array<string>, ranges array<struct<s: long, e: long>>")
        got = scratch.table(got, "found")
        shipped.unpersist()
        out = got if out is None else out.unionByName(got)
    if out is None:
        return spark.createDataFrame([], "segment long, row int, items array<string>, ranges array<struct<s: long, e: long>>")
    return out


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """key, n_words, n_hit, n_items, items (ids as sorted strings), contaminated of each row of docs."""
    with Scratch(docs.sparkSession) as s:
        index = s.table(build_index(docs, key, text), "index")
        found = find_phrases(index, items, s, window, 0, item_key, item_text)
        # a text has at most one row for each block of queries
        per = found.groupBy("segment", "row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("ranges"))).alias("ranges"))
        union = F.aggregate(
            "ranges", F.struct(F.lit(0).cast("long").alias("to"), F.lit(0).cast("long").alias("n")),
            lambda a, r: F.struct(F.greatest(a["to"], r["e"]).alias("to"), (a["n"] + F.greatest(F.lit(0), r["e"] - F.greatest(a["to"], r["s"]))).cast("long").alias("n")), lambda a: a["n"],
        )
        per = per.select("segment", "row", "items", union.alias("n_hit"))
        rows = index.select("segment", F.posexplode(F.arrays_zip("keys", "n_words")).alias("row", "x")).select("segment", "row", F.col("x.keys").alias(key), F.col("x.n_words").alias("n_words"))
        n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
        out = rows.join(per, ["segment", "row"], "left").select(key, "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), (n_hit > 0).alias("contaminated"))
        return s.keep(out.select(key, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", "contaminated"))
