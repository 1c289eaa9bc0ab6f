"""Token counts by heap-and-linked-list byte-pair merging.

The symbols of a word stand in a linked list; a heap holds the adjacent pairs that have a merge rank.
The pair of lowest rank (leftmost at ties) is popped and merged until the heap is empty. The count is
the number of initial symbols less the merges; no identifiers are made.

Null and empty texts have 0 bytes and 0 tokens; repeated rows are counted each; further columns of the
input are not read. Texts of any length are counted whole: memory follows the longest word.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import bound_batches
from .textvec import texts

#: Words of a worker's cache; it is emptied when full. Longer words than CACHED_CHARS aren't cached.
CACHED_WORDS, CACHED_CHARS = 600_000, 64


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in vocabulary files of byte-level tokenizers."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class MergeCounter(dict):
    """Counts of white-space-delimited runs, by the merges of a tokenizers file whose words end in a suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        pattern = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.pieces = regex.compile(pattern).findall
        # code points that the pattern language counts as white space; str.split() also takes U+001C to U+001F
        self.split_exactly = re.compile("[^\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+").findall
        self.specials = [x["content"] for x in spec["added_tokens"]]
        self.at_specials = re.compile("|".join(map(re.escape, self.specials)))
        ids = model["vocab"]
        self.first = [ids[c] for c in byte_alphabet()]
        self.last = [ids[c + self.suffix] for c in byte_alphabet()]
        self.ranks = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault(ids[a] << 20 | ids[b], (rank, ids[a + b]))

    def merged(self, word: bytes) -> int:
        """Symbols that are left of a word when no pair can be merged."""
        first, ranks = self.first, self.ranks
        sym = [first[b] for b in word]
        sym[-1] = self.last[word[-1]]
        n = left = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if r := ranks.get(sym[i] << 20 | sym[i + 1]):
                heap.append((r[0], i, sym[i], sym[i + 1], r[1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue  # one of the two was merged meanwhile
            sym[i], sym[j] = new, -1
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if r := ranks.get(new << 20 | sym[k]):
                    heapq.heappush(heap, (r[0], i, new, sym[k], r[1]))
            h = before[i]
            if h >= 0 and (r := ranks.get(sym[h] << 20 | new)):
                heapq.heappush(heap, (r[0], h, sym[h], new, r[1]))
        return left

    def run(self, chars: str) -> int:
        """Tokens of a run without white space and special strings."""
        if not chars.isascii():
            chars = unicodedata.normalize("NFC", chars)
        low = "".join(map(str.lower, chars)) if "Σ" in chars else chars.lower()  # letter by letter: no final sigma
        return sum(self.merged(p.encode()) for p in self.pieces(low))

    def __missing__(self, chars: str) -> int:
        n = self.run(chars)
        if len(chars) <= CACHED_CHARS:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[chars] = n
        return n

    def count(self, text: str, odd: bool = True) -> int:
        """Tokens of a text. odd: whether it may hold U+001C to U+001F."""
        if "<|" in text and self.at_specials.search(text):
            return len(self.at_specials.findall(text)) + sum(self.count(x, odd) for x in self.at_specials.split(text))
        return sum(map(self.__getitem__, self.split_exactly(text) if odd else text.split()))


_counters: dict[str, MergeCounter] = {}


def counter(path: str) -> MergeCounter:
    """One counter, with its cache, for each file and worker process."""
    if path not in _counters:
        _counters[path] = MergeCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row; one pass, no shuffle."""
    bound_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def counted(batches):
        c = counter(tokenizer)
        for b in batches:
            data, off = texts(b.column(1))
            odd = bool(((data >= 0x1C) & (data <= 0x1F)).any())
            n = np.fromiter((c.count(x, odd) if x else 0 for x in b.column(1).to_pylist()), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(off)), pa.array(n), pa.array(n > limit)], names=[key, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(key, text).mapInArrow(counted, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
