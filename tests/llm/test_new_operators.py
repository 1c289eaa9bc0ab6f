"""Collocations, spelling variants and toxicity against plain Python, on small tables with odd rows."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.llm import collocations as co
from keyloom.llm import queries as q
from keyloom.llm import toxicity as tox
from keyloom.llm import variants as va
from keyloom.llm.common import Scratch
from keyloom.llm.textvec import LOWER

TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", 1.0, "n") for i, t, lang in rows], "doc_id long, text string, lang string, phrase string, score double, n string").repartition(3)


# ---- collocations
def brute_collocations(rows, least, longest, share, top):
    import re

    f, n = {}, Counter()
    for _, t, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(TO_LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f.setdefault(lang, Counter())[tuple(w[i : i + k])] += 1
    out = []
    for lang, count in f.items():
        rows, often = [], {p: a for p, a in count.items() if a >= least}
        for p, a in often.items():
            if len(p) > 1:
                cut = min((2_000_000 * a // (often[p[:k]] + often[p[k:]]), k) for k in range(1, len(p)))
                needless = any(len(o) > len(p) and 100 * b >= share * a and any(o[i : i + len(p)] == p for i in range(len(o))) for o, b in often.items())
                if not needless:
                    rows.append((-cut[0], -a, " ".join(p).encode(), often[p[: cut[1]]], often[p[cut[1] :]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


@pytest.fixture(scope="module")
def phrase_docs():
    rnd = random.Random(3)
    some = ["new", "York", "city", "of", "the", "a", "é", "ß.", "x,y", "end!", "\tq"]
    rows = [(i, " ".join(rnd.choices(some, k=rnd.randrange(30))), rnd.choice(["en", "de", None])) for i in range(150)]
    rows += [(i, "one two three four five.\nSix Seven", "en") for i in range(200, 240)]  # repeated texts
    return rows + [(300, None, "en"), (301, "", None), (302, " . , \n", "fr"), (303, "New York " * 20_000, "en"), (304, "a\x00b c d", "en")]


@pytest.mark.parametrize("least, longest, share, top", [(30, 4, 80, 2000), (3, 3, 50, 7), (1, 2, 100, 40)])
def test_collocations_equal_plain_counting(spark, phrase_docs, least, longest, share, top):
    rows = phrase_docs if least > 1 else phrase_docs[:40]
    got = co.collocations(table(spark, rows), least, longest, share, top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute_collocations(rows, least, longest, share, top)


def test_lists_of_many_blocks_add_up(spark, phrase_docs, monkeypatch):
    monkeypatch.setattr(co, "BLOCK", 500)
    monkeypatch.setattr(co, "BATCH_BYTES", 400)
    assert sorted(map(tuple, co.collocations(table(spark, phrase_docs)).collect())) == brute_collocations(phrase_docs, 30, 4, 80, 2000)


def test_places_have_a_gap_between_pieces_and_texts():
    data = np.frombuffer(b"a b,c" + b"d" + b"" + b".e", np.uint8)
    s, e, p = co.places(data, np.array([0, 5, 6, 6, 8]))
    assert [data[a:b].tobytes() for a, b in zip(s, e, strict=True)] == [b"a", b"b", b"c", b"d", b"e"] and (np.diff(p) == [1, 2, 2, 4]).all()


def test_scores_are_exact_past_64_bits(spark):
    rows = [(9_000_000_000_000_000_001, 9_000_000_000_000_000_003, 9_000_000_000_000_000_007), (1, 3, 3), (1, 2, 5)]
    got = spark.createDataFrame(rows, "a long, l long, r long").select("a", "l", "r", co.score(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()
    assert all(r.s == 2_000_000 * r.a // (r.l + r.r) for r in got)


# ---- spelling variants
def brute_variants(rows, least=3, shortest=5, mod=97):
    import re

    counts = Counter()
    for i, t, _ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(TO_LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if mod and h % mod == 0 else w] += 1
    v = {w: n for w, n in counts.items() if n >= least and len(w) >= shortest}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    around = {w: [x for x in v if near(w, x)] for w in v}
    form = {w: min((-v[x], x) for x in around[w])[1] if around[w] else None for w in v}
    form = {w: x if x and v[x] >= 2 * v[w] else None for w, x in form.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), v[w], len(around[w]), v[form[w]] if form[w] else 0) for w in v)


def as_rows(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


@pytest.fixture(scope="module")
def spelled():
    rnd = random.Random(8)
    base = ["letter", "straße", "aaaaa", "aaaaaa", "aaaba", "àéîõü", "ÀÉÎ÷×x", "banana", "bananas", "Banane"]

    def word():
        w = rnd.choice(base)
        for _ in range(rnd.choice([0, 0, 0, 1, 1, 2])):
            i = rnd.randrange(len(w))
            w = rnd.choice([w[:i] + w[i + 1 :], w[:i] + rnd.choice("abté") + w[i:], w[:i] + rnd.choice("abté") + w[i + 1 :]])
        return w

    rows = [(i, rnd.choice([" ", ", ", "1", "中"]).join(word() for _ in range(rnd.randrange(60))), "en") for i in range(120)]
    return rows + rows[:5] + [(500, None, "en"), (501, "", "en"), (None, "letter letter banana", "en"), (502, "banana " * 5000 + "z" * 70_000, "en"), (503, "ΑΒΓ ß ÿ Ÿ letter", None)]


def test_variants_equal_comparing_all_pairs(spark, spelled):
    got = va.spelling_groups(table(spark, spelled))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert as_rows(got) == brute_variants(spelled) and len(as_rows(got)) > 40


def test_forms_are_followed_to_the_last(spark):
    chain = [(i, f"{'a' * 5}{'b' * i} " * (3 * 2 ** (7 - i)), "en") for i in range(8)]
    assert {r[2] for r in as_rows(va.spelling_groups(table(spark, chain), cut_mod=0))} == {"aaaaa"}


def test_a_full_bitmap_lets_all_through(spark, spelled, monkeypatch):
    monkeypatch.setattr(va, "BITMAP", 8)
    monkeypatch.setattr(va, "ROW", 1)
    assert as_rows(va.spelling_groups(table(spark, spelled[:40]))) == brute_variants(spelled[:40])


def test_every_edit_is_emitted_once():
    import pyarrow as pa

    for w in ("aab", "abcd", "aaaa", "a"):
        made = [va.edited(w, what, at, c) for which, what, p, letter in va.Letters(pa.array([w])).edits(np.array(sorted(map(ord, "abz"))), lambda h: np.ones(h.shape, bool)) for at, c in zip(p.tolist(), letter.tolist(), strict=True)]
        cut = {w[:i] + w[i + 1 :] for i in range(len(w))}
        put = {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in "abz"}
        swap = {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in "abz"} - {w}
        assert sorted(made) == sorted(cut | put | swap)


def test_checksums_of_runs():
    data = LOWER[np.frombuffer("xHello wörld".encode(), np.uint8)]
    prefix = np.array([zlib.crc32(b"12:"), zlib.crc32(b":")], np.uint32)
    got = va.crc32_of(prefix, data, np.array([0, 7]), np.array([6, 13]))
    assert got.tolist() == [zlib.crc32(b"12:xhello"), zlib.crc32(":wörld".encode())]


# ---- toxicity
@pytest.fixture(scope="module")
def rude():
    rnd = random.Random(4)
    clean, bad = ["".join(rnd.choices("aeioulnst", k=6)) for _ in range(400)], ["idiotic", "moronfool", "moronface", "scumbag"]
    rows = []
    for i in range(1500):
        w = rnd.choices(clean, k=rnd.randrange(20, 80))
        if i % 8 == 0:
            for _ in range(rnd.randrange(2, 5)):
                w[rnd.randrange(len(w))] = rnd.choice(bad)
        rows.append((i, " ".join(w), i % 8 == 0))
    return rows


def test_toxic_texts_that_were_not_learned_from_are_told(spark, rude):
    docs = spark.createDataFrame([(i, t, "c", 2.0) for i, t, _ in rude] + [(9000, None, "c", 2.0), (9001, "", "c", 2.0), (9002, "word " * 200_000 + "idiotic scumbag idiotic", "c", 2.0), (9003, rude[0][1], "c", 2.0), (9003, rude[0][1], "c", 2.0)], "doc_id long, text string, predicted string, score double").repartition(3)
    labels = spark.createDataFrame([(i, 1, int(y)) for i, _, y in rude] + [(77_777, 1, 1), (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    got = tox.toxicity(docs, labels, ~q.is_held_out("_id", 3, 1)).collect()
    assert len(got) == len(rude) + 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    by = {r.doc_id: r for r in got}
    toxic, others = [i for i, _, y in rude if y and held(i)], [i for i, _, y in rude if not y and held(i)]
    assert np.mean([by[i].predicted for i in toxic]) >= 0.9 and np.mean([by[i].predicted for i in others]) <= 0.01
    assert by[9000].score == by[9001].score < 0.5 and by[9002].predicted == 1
    again = {r.doc_id: r.score for r in tox.toxicity(docs.repartition(7), labels.repartition(2), ~q.is_held_out("_id", 3, 1)).collect()}
    assert all(r.score == again[r.doc_id] for r in got)  # whatever the partitions
    assert np.count_nonzero(_weights(spark, docs, labels)) < 3000


def _weights(spark, docs, labels):
    with Scratch(spark) as s:
        return tox.train(tox._packed(tox.training_rows(docs, labels, F.lit(True)), s), s).final()[0]


def test_labels_held_out_change_nothing(spark, rude):
    docs = spark.createDataFrame([(i, t) for i, t, _ in rude[:300]], "doc_id long, text string")
    one = lambda flip: spark.createDataFrame([(i, int(y) if zlib.crc32(str(i).encode()) % 3 != 1 else flip) for i, _, y in rude[:300]], "doc_id long, toxic int")
    a, b = ({r.doc_id: r.score for r in tox.toxicity(docs, one(f), ~q.is_held_out("_id", 3, 1)).collect()} for f in (0, 1))
    assert a == b


def test_nothing_to_learn_from(spark, rude):
    docs = spark.createDataFrame([(i, t) for i, t, _ in rude[:9]], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {(r.score, r.predicted) for r in tox.toxicity(docs, none, F.lit(True)).collect()} == {(0.5, 0)}
    assert tox.toxicity(docs.where("doc_id < 0"), none, F.lit(True)).collect() == []


def test_distinct_features_of_a_text():
    data, off = np.frombuffer("Éa Éa b!éa".encode(), np.uint8), np.array([0, 10, 13])
    f, o = tox.distinct(data, off)
    # two words, their pairs at 1 and 2 places (éa éa, éa b, éa b): five at most; the other text has one word
    assert o.tolist()[0] == 0 and o[1] == 5 and o[2] - o[1] == 1 and f[o[1]] in f[: o[1]]


def test_texts_over_a_batch_are_read_whole(spark):
    """A text of over 4 MB, of which the end matters."""
    rows = [(1, "alpha beta " * 450_000 + "last gamma", "en"), (2, "alpha beta. last gamma " * 40, "en"), (3, "alphas " * 4, "en")]
    docs = table(spark, rows)
    found = {r.phrase: (r.a, r.n) for r in co.collocations(docs, least=41).collect()}
    assert found["last gamma"] == (41, 900_002 + 160 + 4)
    words = {r.word: (r.n, r.form) for r in va.spelling_groups(docs, cut_mod=0).collect()}
    assert words == {"alpha": (450_040, None), "alphas": (4, "alpha"), "gamma": (41, None)}
    weights = np.zeros(1 << tox.BITS, np.float32)
    weights[tox.distinct(np.frombuffer(b"gamma", np.uint8), np.array([0, 5]))[0]] = 9.0
    assert {r.doc_id: r.predicted for r in tox.score_rows(docs, weights, -5.0, ("doc_id",)).collect()} == {1: 1, 2: 1, 3: 0}
