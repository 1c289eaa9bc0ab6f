"""Spelling variants: words that one inserted, deleted or replaced character turns into each other.

Every word emits its full neighbourhood, all distinct strings that one deletion, replacement or insertion over the observed
alphabet makes of it; those that are words are its near words. Being near is mutual, so a string that is a word hears from all its near words at
once: the emitted strings are grouped, and one equality join with the vocabulary answers, with no distance to verify.

Most emitted strings are no words. They are told by a bitmap of the words' hashes, of BITMAP bits at most whatever the vocabulary
is, before they are made; it never loses a word, and what it lets through in error the join drops.

Words and counts come from whole texts. A null text has no words; a null key counts as the empty text; repeated rows count each; a word may be as long as its text; an empty table gives no
rows; further columns are not read. Of near words of the same number the smallest in code-point order counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bound_batches, rechunk, release
from .textvec import LOWER, U, mix, texts, words

#: Least code points and occurrences of a word; how many times as often its form must be.
SHORTEST, LEAST, TIMES = 5, 3, 2
#: Most bits of the bitmap (32 MB) and its bits for each word while it is smaller.
BITMAP, BITS_EACH = 1 << 28, 64
#: Bytes of the bitmap's rows, and emitted strings that are hashed at once.
ROW, AT_ONCE = 1 << 16, 1 << 20
#: Words of a task.
EACH = 50_000

_MUL = 0x9E3779B97F4A7C15 | 1
_CRC = np.array([zlib.crc32(bytes([i])) for i in range(256)], np.uint32)  # of one byte, start and end inversions included
_CRC ^= _CRC[0]


def runs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ASCII letters and U+00C0 to U+00FF, and each text's offsets into them."""
    inside = np.zeros(256, bool)
    inside[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3]] = True
    m = inside[data]
    lead = np.flatnonzero(data == 0xC3)
    m[lead + 1] = True  # any character of two bytes that begins so
    marked = m.astype(np.uint8)
    yes = np.zeros(256, bool)
    yes[1] = True
    return words(marked, off, yes)


def crc32_of(prefix: np.ndarray, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """crc32 of data[s[i]:e[i]] after what has the crc32 prefix[i], byte by byte for all i at once."""
    state, left = prefix ^ np.uint32(0xFFFFFFFF), np.arange(len(s))
    j = 0
    while len(left):
        left = left[s[left] + j < e[left]]
        x = state[left]
        state[left] = _CRC[(x ^ data[s[left] + j]) & np.uint32(0xFF)] ^ (x >> np.uint32(8))
        j += 1
    return state ^ np.uint32(0xFFFFFFFF)


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", cut_mod: int = 97) -> DataFrame:
    """word, n: the runs of all texts, in lower case of ASCII, each made shorter by a character where the crc32 of its key and text is divisible by cut_mod (0: never).

    That stands for misspellings that a corpus has; words of fewer than SHORTEST code points or LEAST occurrences are left out.
    """
    bound_batches(docs.sparkSession)

    def run(batches):
        for b in rechunk(batches):
            data, off = texts(b.column(1))
            data = LOWER[data]
            s, e, roff = runs(data, off)
            if not len(s):
                continue
            counted = np.ones(len(s), bool)
            odd: list[bytes] = []
            if cut_mod:
                keys = [zlib.crc32(f"{'' if k is None else k}:".encode()) for k in b.column(0).to_pylist()]
                h = crc32_of(np.repeat(np.array(keys, np.uint32), np.diff(roff)), data, s, e)
                for i in np.flatnonzero(h % np.uint32(cut_mod) == 0):
                    w = data[s[i] : e[i]].tobytes().decode()
                    at = int(h[i]) % len(w)
                    odd.append((w[:at] + w[at + 1 :]).encode())
                    counted[i] = False
            size = np.where(counted, e - s, 0)
            edge = np.zeros(len(data) + 1, np.int8)
            edge[s[counted]] += 1
            edge[e[counted]] -= 1
            bare = data[np.cumsum(edge[:-1], dtype=np.int8).view(bool)]
            bounds = np.zeros(len(s) + 1, np.int64)
            np.cumsum(size, out=bounds[1:])
            every = pa.chunked_array([pa.LargeStringArray.from_buffers(len(s), pa.py_buffer(bounds), pa.py_buffer(bare)), pa.array([w.decode() for w in odd], pa.large_string())])
            found = pc.value_counts(every)
            value, n = found.field("values"), found.field("counts")
            ok = pc.greater_equal(pc.utf8_length(value), SHORTEST)
            yield pa.RecordBatch.from_arrays([value.filter(ok).cast(pa.string()), n.filter(ok)], names=["word", "n"])
        release()

    rows = docs.select(key, text).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)


class Letters:
    """Words as rows of code points, and hashes of all that one edit makes of them: a sum of (code point + 1) * power of place, mixed with the length."""

    def __init__(self, column: pa.Array):
        chars = np.frombuffer("".join(column.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
        self.size = pc.utf8_length(column).to_numpy().astype(np.int64)
        self.off = np.zeros(len(self.size) + 1, np.int64)
        np.cumsum(self.size, out=self.off[1:])
        self.chars = chars

    @staticmethod
    def powers(n: int) -> np.ndarray:
        x = np.full(n, _MUL, U)
        x[0] = 1
        return np.cumprod(x)

    @staticmethod
    def finished(h: np.ndarray, n: np.ndarray) -> np.ndarray:
        return mix(h ^ (n.astype(U) * U(0xD6E8FEB86659FD93)))

    def hashes(self) -> np.ndarray:
        at = np.arange(len(self.chars)) - np.repeat(self.off[:-1], self.size)
        part = (self.chars.astype(U) + U(1)) * self.powers(int(self.size.max(initial=0)) + 2)[at]
        total = np.zeros(len(part) + 1, U)
        np.cumsum(part, out=total[1:])
        return self.finished(total[self.off[1:]] - total[self.off[:-1]], self.size)

    def edits(self, alphabet: np.ndarray, hit) -> Iterator[tuple[np.ndarray, str, np.ndarray, np.ndarray]]:
        """Edits whose hash satisfies hit: which word, what is done, where, and the letter; in slices of AT_ONCE hashes. An edit that makes the same string as an earlier one is left out."""
        power, a = self.powers(int(self.size.max(initial=0)) + 2), alphabet.astype(U) + U(1)
        step = max(1, AT_ONCE // max(1, len(a)))
        w = np.repeat(np.arange(len(self.size)), self.size)
        at = np.arange(len(self.chars)) - self.off[w]
        part = (self.chars.astype(U) + U(1)) * power[at]
        total = np.zeros(len(part) + 1, U)
        np.cumsum(part, out=total[1:])
        whole = (total[self.off[1:]] - total[self.off[:-1]])[w]
        before = total[:-1] - total[self.off[:-1]][w]
        prev = np.full(len(w), -1, np.int64)
        prev[1:] = self.chars[:-1]
        prev[at == 0] = -1
        # deletions; of a run of one letter, that of the first
        shifted = (whole - before - part) * U(pow(_MUL, -1, 1 << 64)) + before
        ok = hit(self.finished(shifted, self.size[w] - 1)) & (self.chars != prev)
        yield w[ok], "delete", at[ok], np.zeros(int(ok.sum()), np.int64)
        for i in range(0, len(w), step):
            j = slice(i, i + step)
            base, p = (whole - part)[j], power[at[j]]
            ok = hit(self.finished(base[:, None] + a[None, :] * p[:, None], self.size[w[j]][:, None])) & (alphabet[None, :] != self.chars[j][:, None])
            r, c = np.nonzero(ok)
            yield w[j][r], "replace", at[j][r], alphabet[c]
        # insertions before each letter and at the end; a letter beside its like, only before the first
        w2 = np.concatenate([w, np.arange(len(self.size))])
        at2 = np.concatenate([at, self.size])
        before2 = np.concatenate([before, total[self.off[1:]] - total[self.off[:-1]]])
        whole2 = np.concatenate([whole, total[self.off[1:]] - total[self.off[:-1]]])
        ends = np.full(len(self.size), -1, np.int64)
        ends[self.size > 0] = self.chars[self.off[1:][self.size > 0] - 1]
        prev2 = np.concatenate([prev, ends])
        for i in range(0, len(w2), step):
            j = slice(i, i + step)
            base, p = ((whole2 - before2) * U(_MUL) + before2)[j], power[at2[j]]
            ok = hit(self.finished(base[:, None] + a[None, :] * p[:, None], self.size[w2[j]][:, None] + 1)) & (alphabet[None, :] != prev2[j][:, None])
            r, c = np.nonzero(ok)
            yield w2[j][r], "insert", at2[j][r], alphabet[c]


def edited(word: str, what: str, at: int, letter: int) -> str:
    return word[:at] + ("" if what == "delete" else chr(letter)) + word[at + (what != "insert") :]


def _bitmap(vocabulary: DataFrame) -> np.ndarray:
    """A bit for each word's hash; the rows that are collected are parts of the bitmap, bounded by its size."""
    n = vocabulary.count()
    bits = min(BITMAP, max(ROW * 8, 1 << (n * BITS_EACH).bit_length()))

    def run(batches):
        for b in rechunk(batches):
            slot = Letters(b.column(0)).hashes() & U(bits - 1)
            yield pa.RecordBatch.from_arrays([pa.array((slot // U(ROW * 8)).astype(np.int64)), pa.array((slot % U(ROW * 8)).astype(np.int64))], names=["row", "bit"])

    def joined(t: pa.Table) -> pa.Table:
        one = np.zeros(ROW * 8, bool)
        one[t["bit"].to_numpy()] = True
        return pa.table({"row": t["row"].slice(0, 1), "bits": pa.array([np.packbits(one, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros(bits // 8, np.uint8)
    rows = vocabulary.select("word").mapInArrow(run, "row long, bit long").groupBy("row").applyInArrow(joined, "row long, bits binary")
    for r in rows.toLocalIterator():
        out[r["row"] * ROW : (r["row"] + 1) * ROW] = np.frombuffer(r["bits"], np.uint8)
    return out


def _alphabet(vocabulary: DataFrame) -> np.ndarray:
    """The code points of all words, of which there are some hundred at most (the class of runs holds no more)."""

    def run(batches):
        for b in rechunk(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(Letters(b.column(0)).chars))], names=["c"])

    return np.array(sorted(r["c"] for r in vocabulary.select("word").mapInArrow(run, "c long").distinct().collect()), np.int64)


def neighbourhoods(vocabulary: DataFrame) -> DataFrame:
    """variant, n, word of each word (word, n): what one edit makes of it, but for strings that the bitmap shows to be no words."""
    spark = vocabulary.sparkSession
    bound_batches(spark)
    alphabet, sent = _alphabet(vocabulary), spark.sparkContext.broadcast(_bitmap(vocabulary))

    def run(batches):
        bits = sent.value
        last = U(len(bits) * 8 - 1)

        def hit(h):
            slot = h & last
            return (bits[(slot >> U(3)).astype(np.int64)] >> (slot & U(7)).astype(np.uint8)) & 1 == 1

        for b in batches:
            column, n = b.column(0).to_pylist(), b.column(1).to_numpy()
            for which, what, at, letter in Letters(b.column(0)).edits(alphabet, hit):
                if len(which):
                    made = [edited(column[i], what, p, c) for i, p, c in zip(which.tolist(), at.tolist(), letter.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(made, pa.string()), pa.array(n[which]), pa.array([column[i] for i in which.tolist()], pa.string())], names=["variant", "n", "word"])
        release()

    return vocabulary.select("word", "n").mapInArrow(run, "variant string, n long, word string")


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """word, root of each word (word, form): forms are followed to the last, twice as far in each round.

    A form is TIMES as often as its word at least, so a way has fewer steps than a count has bits, and there are six rounds at most.
    """
    rows = scratch.table(forms.select("word", F.col("form").alias("to")), "to")
    while not rows.where("to is not null").isEmpty():
        far = rows.select(F.col("word").alias("at"), F.coalesce("to", "word").alias("root"), F.col("to").isNotNull().alias("more"))
        jumped = rows.where("to is not null").join(far, F.col("to") == F.col("at")).select("word", F.col("root").alias("to"), "more")
        done = rows.where("to is null").select("word", "to", F.lit(False).alias("more"))
        old, now = rows, scratch.table(jumped.unionByName(done), "to")
        rows = now.drop("more")
        if now.where("more").isEmpty():
            break
        scratch.drop(old)
    return rows.select("word", F.coalesce("to", "word").alias("root"))


def spelling_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", cut_mod: int = 97) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of the texts.

    form: the most frequent near word, if it is TIMES as often at least; root: what following forms leads to.
    """
    with Scratch(docs.sparkSession) as s:
        vocabulary = s.table(word_counts(docs, key, text, cut_mod), "vocabulary")
        # a task has EACH words or so, that stand near each other, so that it can put together what they emit
        parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), vocabulary.count() // EACH + 1)
        heard = neighbourhoods(vocabulary.repartitionByRange(parts, "word")).groupBy("variant").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "word")).alias("best"))
        rows = vocabulary.join(heard, F.col("word") == F.col("variant"), "left")
        often = -F.col("best.less") >= F.col("n") * TIMES
        rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(often, F.col("best.word")).alias("form"), F.when(often, -F.col("best.less")).alias("form_n"))
        rows = s.table(rows, "forms")
        return s.keep(rows.join(roots(rows, s), "word").select("word", "form", "root", "n", "n_near", "form_n"))
