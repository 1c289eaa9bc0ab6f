import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.llm import kneser_ney
from keyloom.llm.common import Scratch
from keyloom.llm.kneser_ney import discounts, perplexities, quality, trusted_ids

TEXTS = ["the cat sat on the mat", "The CAT ate", None, "", "a", "the dog sat\n\ton a log ", "été à l'été", "zzz \x00 ñ ###", "the cat sat on the mat", "mat " * 60]


def grams(t, order):
    b = (t or "").encode()
    s = [*b, 256]
    return [(tuple(([0] * order + list(b))[i : i + order]), x) for i, x in enumerate(s)]


def brute(texts, train, order):
    """Probabilities by the textbook recursion over dictionaries."""
    raw = Counter(g for t, f in zip(texts, train, strict=True) if f for g in grams(t, order))
    seen = [None] * (order + 1)
    seen[order] = {g: c for g, c in raw.items()}
    for k in range(order - 1, -1, -1):
        seen[k] = Counter((ctx[1:], s) for ctx, s in seen[k + 1])
    d = [discounts([sum(c == j for c in seen[k].values()) for j in (1, 2, 3, 4)]) for k in range(order + 1)]
    nodes = [defaultdict(dict) for _ in range(order + 1)]
    for k in range(order + 1):
        for (ctx, s), c in seen[k].items():
            nodes[k][ctx][s] = c

    def p(ctx, s):
        k = len(ctx)
        low = p(ctx[1:], s) if k else 1 / 257
        node = nodes[k].get(ctx)
        if not node:
            return low
        off = lambda c: d[k][min(c, 3) - 1] if c else 0
        c = node.get(s, 0)
        return (c - off(c) + sum(map(off, node.values())) * low) / sum(node.values())

    assert math.isclose(sum(p((0,) * order, s) for s in range(257)), 1)
    return [-sum(math.log(p(c, s)) for c, s in grams(t, order)) / len(grams(t, order)) for t in texts]


@pytest.mark.parametrize("order", [0, 1, 3])
def test_perplexities_by_brute_force(spark, order):
    train = [i % 3 != 2 for i in range(len(TEXTS))]
    df = spark.createDataFrame([(i, t, None if i == 3 else "en", train[i], "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, train boolean, trusted string").repartition(3)
    with Scratch(spark) as s:
        got = {r.doc_id: r for r in perplexities(df, "train", s, order).collect()}
    for i, want in enumerate(brute(TEXTS, train, order)):
        assert math.isclose(got[i].log_perplexity, want, rel_tol=1e-9), i
        assert got[i].trusted == train[i] and got[i].n_bytes == len((TEXTS[i] or "").encode())


def test_junk_goes_and_clean_texts_stay(spark):
    rnd = np.random.default_rng(1)
    words = ["".join(rnd.choice(list("abcdefgh"), 4)) for _ in range(60)]
    clean = [" ".join(rnd.choice(words, 80)) for _ in range(200)]
    junk = ["".join(chr(rnd.integers(33, 90)) for _ in range(400)) for _ in range(10)]
    texts = [*clean, *junk, None, "", clean[0]]
    docs = spark.createDataFrame([(i if i < 212 else None, t, "xx" if i % 5 else None, "z") for i, t in enumerate(texts)], "doc_id long, text string, lang string, keep string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)] + [(5, 0, 0), (201, 1, 1), (999, 1, 0), (None, 1, 0), (203, None, None)], "doc_id long, quality int, toxic int")
    assert list(trusted_ids(labels)) == [*range(5), *range(6, 200), 999]
    assert len(trusted_ids(labels, most=7)) == 7
    rows = quality(docs, labels).collect()
    assert len(rows) == len(texts)
    kept = {r.doc_id: r.keep for r in rows if r.doc_id is not None}
    assert sum(kept[i] for i in range(200)) >= 195
    assert not any(kept[i] for i in range(200, 212))
    assert {r.keep for r in rows if r.doc_id is None} == {True}


def test_without_labels_only_empty_texts_go_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "en"), (2, "", "en"), (3, None, None)], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.keep for r in quality(docs, none).collect()} == {1: True, 2: False, 3: False}
    assert quality(docs.where("doc_id > 9"), none).collect() == []


def test_discounts_stay_within_counts():
    assert discounts([0, 0, 0, 0]) == (0.5, 1.0, 1.5)
    for n in ([5, 0, 0, 0], [1, 100, 1, 1], [100, 1, 100, 1]):
        assert all(0 < d < j + 1 for j, d in enumerate(discounts(n)))
    assert kneser_ney.KEPT < 1


def test_limits_are_interpolated_quantiles_that_few_rows_borrow():
    rng = np.random.default_rng(7)
    x = {"a": rng.normal(2, 0.1, 5000), "b": rng.normal(3, 0.3, 40), None: rng.normal(2, 0.1, 10)}
    bins = {k: list(Counter(np.ceil(v / kneser_ney.BIN).astype(int).tolist()).items()) for k, v in x.items()}
    got, other = kneser_ney.limits(bins, 0.9)
    every = np.concatenate(list(x.values()))
    assert math.isclose(kneser_ney.quantile(bins["b"], 0.37), np.quantile(x["b"], 0.37), abs_tol=kneser_ney.BIN)
    assert abs(other - np.quantile(every, 0.9)) <= kneser_ney.BIN and set(got) == {"a", "b"}
    assert abs(got["a"] - np.quantile(x["a"], 0.9)) < 0.002  # many rows: its own quantile
    own, spread = np.quantile(x["b"], 0.9), np.quantile(every, 0.9) - np.quantile(every, 0.5)
    assert abs(got["b"] - (np.median(x["b"]) + 0.8 * (own - np.median(x["b"])) + 0.2 * spread)) <= 4 * kneser_ney.BIN
    assert kneser_ney.limits({}, 0.9) == ({}, None)


@pytest.mark.parametrize("trusted", [3, 10, 40])
def test_a_rare_language_keeps_its_clean_texts(spark, trusted):
    rnd = np.random.default_rng(2)

    def words(letters):
        return ["".join(rnd.choice(list(letters), rnd.integers(3, 8))) for _ in range(400)]

    common, rare = words("abcdefgh"), words("qrstuvwxyz")
    texts = [" ".join(rnd.choice(common, 60)) for _ in range(400)] + [" ".join(rnd.choice(rare, 60)) for _ in range(trusted + 100)]
    docs = spark.createDataFrame([(i, t, "aa" if i < 400 else "rr") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(400 + trusted)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.keep for r in quality(docs, labels).collect()}
    assert sum(kept[i] for i in range(400 + trusted, len(texts))) >= 90
    assert sum(kept[i] for i in range(400)) >= 396


def test_all_trusted_rows_that_are_not_held_out_are_learned_from(spark, monkeypatch):
    """However many there are: with more ids than are sent to the tasks, the result is the same."""
    rnd = np.random.default_rng(5)
    texts = [" ".join("".join(rnd.choice(list("abcdefgh"), 4)) for _ in range(20)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit("aa"))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    rows, learned, flagged = [], [], kneser_ney.flagged
    monkeypatch.setattr(kneser_ney, "flagged", lambda d, ids, *a: learned.append(ids.count()) or flagged(d, ids, *a))
    for most in (200_000, 3):
        monkeypatch.setattr(kneser_ney, "SENT", most)
        rows.append({r.doc_id: (round(r.perplexity, 6), round(r.threshold, 6), r.keep) for r in quality(docs, labels).collect()})
    held = {r.doc_id for r in kneser_ney.folds(docs, labels).where("held").collect()}
    assert rows[0] == rows[1] and learned == [50 - len(held)] * 2 and len(held) < 47
