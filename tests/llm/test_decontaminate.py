import random
import re

import numpy as np
import pyarrow as pa

from keyloom.llm import common
from keyloom.llm import decontaminate as d
from keyloom.llm.decontaminate import Segment, build_index, decontaminate, hashed_words


def split(t):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(texts, items, window=10):
    out = {}
    for i, t in enumerate(texts):
        w, hit, found = split(t), set(), set()
        for item, q in items:
            q = split(q)
            n = min(window, len(q))
            for k in range(len(q) - n + 1) if n else ():
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == q[k : k + n]:
                        hit.update(range(j, j + n))
                        if item is not None:
                            found.add(str(item))
        out[i] = (len(w), len(hit), sorted(found))
    return out


def cases():
    rnd = random.Random(4)
    word = lambda: rnd.choice(["Alpha", "béta", "the", "of", "the", "x1", "gamma"]) + rnd.choice(["", "", "s"])
    phrase = lambda n: " ".join(word() for _ in range(n))
    items = [(1, phrase(25)), (2, "the of"), (10, phrase(10)), (3, None), (4, ""), (5, "..."), (None, phrase(12)), (7, phrase(30)), (7, phrase(30))]
    texts = [None, "", "...", "the", "The—of", "the of THE OF"]
    for _ in range(60):
        q = (rnd.choice([x for x in items if x[1]])[1]).split()
        a = rnd.randrange(max(1, len(q) - 9))
        texts.append(phrase(rnd.randrange(30)) + ", " + " \n".join(q[a : a + rnd.randrange(8, 20)]).upper().replace("É", "é") + "; " + phrase(rnd.randrange(30)))
    return texts + texts[-3:], items


def check(as_docs, spark, texts, items):
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, doc_id string")
    got = {r.doc_id: (r.n_words, r.n_hit, list(r.items)) for r in decontaminate(as_docs(texts), bench).collect()}
    assert got == brute(texts, items)


def test_whole_operator_against_brute_force(as_docs, spark):
    check(as_docs, spark, *cases())


def test_blocks_of_queries_give_the_same(as_docs, spark, monkeypatch):
    monkeypatch.setattr(d, "BLOCK_ITEMS", 2)
    monkeypatch.setattr(d, "CANDIDATES", 3)
    check(as_docs, spark, *cases())


def test_empty_tables_and_repeated_rows(as_docs, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(as_docs([]), none).collect() == []
    rows = decontaminate(as_docs(["a b", "a b", None], ids=[None, 1, 1]), none).collect()
    assert sorted((r.n_words, r.n_hit, r.contaminated) for r in rows) == [(0, 0, False), (2, 0, False), (2, 0, False)]


def test_index_holds_all_postings(as_docs):
    texts = ["a b a", None, "b " * 5000]
    n = 0
    for r in build_index(as_docs(texts)).collect():
        post = np.frombuffer(r.postings, np.uint32)
        assert sorted(post) == list(range(sum(r.n_words)))
        n += len(post)
    assert n == 5003


def test_proximity():
    h, woff = hashed_words(pa.array(["one x two three", "two one", "three two one"]))
    order = np.argsort(h, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(h[order].view(np.int64)) != 0))
    s = Segment(np.diff(woff), h[order][first].tobytes(), np.append(first, len(h)).astype(np.uint32).tobytes(), order.astype(np.uint32).tobytes())
    q = hashed_words(pa.array(["one two three"]))[0][None, :]
    assert len(s.search(q)[0]) == 0
    assert set(s.search(q, slop=1)[1]) == {0}
    assert set(s.search(q, slop=4)[1]) == {0, 2}


def test_many_segments_in_a_task_give_the_same(as_docs, spark, monkeypatch):
    monkeypatch.setattr(common, "BATCH_ROWS", 3)
    monkeypatch.setattr(d, "rechunk", lambda batches: (b for b in batches if b.num_rows))
    texts, items = cases()
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, doc_id string")
    docs = as_docs(texts).coalesce(1)
    assert build_index(docs).count() > 10
    got = {r.doc_id: (r.n_words, r.n_hit, list(r.items)) for r in decontaminate(docs, bench).collect()}
    assert got == brute(texts, items)
