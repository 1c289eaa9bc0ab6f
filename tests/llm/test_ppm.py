import math
import re
from collections import Counter

import pytest

from keyloom.llm import ngrams
from keyloom.llm.ppm import Trie, adaptive_scores, score_texts

TEXTS = ["the cat sat on the mat", "The CAT ate", None, "", "a", "the dog sat\n\ton a log ", "été à l'été", "zzz unseen bytes: \x00 ñ", "the cat sat on the mat", "mat " * 60]


def lowered(t):
    return re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())


def check(got, texts, train, order):
    trie, words = Trie(order), Counter()
    tokens = [[*re.findall(rb"[^\x20\x09-\x0d]+", lowered(t)), "end"] for t in texts]
    for i, t in enumerate(texts):
        if train[i]:
            data = lowered(t)
            for j in range(len(data) + 1):
                trie.learn(trie.context(data, j), data[j] if j < len(data) else 256)
            words.update(tokens[i])
    n, v = sum(words.values()), len(words)
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert r.held_out == (not train[i]) and r.train_tokens == n and r.n_tokens == len(tokens[i])
        assert r.n_known == sum(words[w] > 0 for w in tokens[i])
        assert math.isclose(r.base_score, sum(math.log10((words[w] + 1) / (n + v + 1)) for w in tokens[i]), rel_tol=1e-9)
        assert math.isclose(r.score, trie.score(lowered(t), False) / math.log(10), rel_tol=1e-9), (i, t)


@pytest.mark.parametrize("order", [0, 2, 4])
def test_pretrained_scores_equal_a_trie(spark, order, monkeypatch):
    train = [i % 3 != 2 for i in range(len(TEXTS))]
    df = spark.createDataFrame([(i, t, train[i], "x", "y") for i, t in enumerate(TEXTS)], "doc_id long, text string, train boolean, block string, flag string").repartition(3)
    check({r.doc_id: r for r in score_texts(df, "train", order).collect()}, TEXTS, train, order)


def test_nothing_to_learn_from_and_empty(spark):
    df = spark.createDataFrame([(i, t, False) for i, t in enumerate(TEXTS)], "doc_id long, text string, train boolean")
    check({r.doc_id: r for r in score_texts(df, "train", 3).collect()}, TEXTS, [False] * len(TEXTS), 3)
    assert score_texts(df.where("doc_id < 0"), "train", 3).collect() == []


def test_probabilities_sum_to_one():
    t = Trie(3)
    t.score(b"abracadabra abracadabra", True)
    for ctx in (b"abr", b"\0\0\0", b"xyz", b"ra "):
        assert math.isclose(sum(math.exp(t.log_probability(ctx, s)) for s in range(257)), 1.0)


def test_adaptive_learns_along_the_text(spark):
    df = spark.createDataFrame([(1, "ab" * 200), (2, None), (3, "qwertzuiopasdfghjklyxcvbnm" * 2)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in adaptive_scores(df).collect()}
    assert got[1] > -60 and math.isclose(got[2], -math.log10(257)) and got[3] < -60


def test_slices_keep_contexts(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from keyloom.llm.textvec import texts

    data, off = texts(pa.array(["hello", "", "wo", "x" * 9]))
    s, soff = ngrams.symbols(data, off)
    whole = np.concatenate([c for _, c in ngrams.slices(s, soff, 4)])
    monkeypatch.setattr(ngrams, "SLICE", 3)
    assert (np.concatenate([c for _, c in ngrams.slices(s, soff, 4)]) == whole).all()
