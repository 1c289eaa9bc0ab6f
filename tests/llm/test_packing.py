import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from keyloom.llm.packing import pack, plan_packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check_packed(rows, texts, size, end_id=2):
    lib = Tokenizer.from_file(PATH)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(range(len(texts)))
    for i, t in enumerate(texts):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, end_id], "<u4")
        parts = sorted(by_doc[i], key=lambda r: r.piece)
        assert [p.piece for p in parts] == list(range(len(parts)))
        at = 0
        for p in parts:
            assert p.start == at and 0 < p.length <= size
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
        assert all(p.length == size for p in parts[1:])
    for places in by_seq.values():
        at = 0
        for off, n in sorted(places):
            assert off == at
            at += n
        assert at <= size
    return len(by_seq)


def test_pieces_and_places(as_docs, odd_texts):
    rows = pack(as_docs(odd_texts), PATH, size=256).collect()
    total = sum(r.length for r in rows)
    assert check_packed(rows, odd_texts, 256) <= -(-total // 256) + 2


def test_copies_and_null_keys(as_docs):
    rows = pack(as_docs(["the same text"] * 500, ids=[None] * 500), PATH, size=64).collect()
    assert len(rows) == 500 and len({(r.sequence_id, r.offset) for r in rows}) == 500
    n = rows[0].length
    assert len({r.sequence_id for r in rows}) == -(-500 // (64 // n))


def test_empty_table(as_docs):
    assert pack(as_docs([]), PATH).collect() == []


def test_plan_holds_each_piece_once_and_comes_near_the_bound():
    rng = np.random.default_rng(3)
    lengths = np.minimum(1023, 1 + rng.gamma(2.0, 180, 60_000).astype(int))
    hist = np.bincount(lengths, minlength=1025)
    plan = plan_packing(hist)
    got = np.zeros(1025, int)
    for use, times in plan:
        assert sum(use) <= 1024
        got += np.bincount(use, minlength=1025) * times
    assert (got == hist).all()
    bound = -(-int(lengths.sum()) // 1024)
    assert sum(n for _, n in plan) <= 1.01 * bound + 1
