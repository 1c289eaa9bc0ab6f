import random

import keyloom.llm.near_copies as near
from keyloom.llm.common import Scratch
from keyloom.llm.near_copies import near_copies, others


def sets(t, k=5):
    w = (t or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(texts, least=0.8):
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    s = [sets(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if (not s[i] and not s[j]) or (s[i] | s[j] and len(s[i] & s[j]) >= least * len(s[i] | s[j])):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in range(len(texts))}


def test_copies_and_near_copies_are_grouped_and_others_left_alone(as_docs):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 8)))
    texts = [" ".join(word() for _ in range(rnd.randrange(150, 500))) for _ in range(60)]
    for i in range(40):
        w = texts[i].split()
        for _ in range(max(1, len(w) // rnd.choice([40, 60, 100]) // 2)):
            w[rnd.randrange(len(w))] = word()
        texts.append(" ".join(w))
    texts += [texts[3].upper(), texts[3].replace(" ", "\n"), None, "", " ", "one", "ONE", "one two", "three four five six seven"]
    texts += [" ".join([*texts[0].split()[:-3], word(), word(), word()]) for _ in range(50)]
    got = {r.doc_id: r.component_id for r in near_copies(as_docs(texts)).collect()}
    want = brute(texts)
    assert len(got) == len(texts)
    assert sum(got[i] != want[i] for i in want) <= 1  # the search for candidates is probabilistic
    assert all(want[got[i]] == want[i] for i in got)  # and never joins what isn't linked


def test_empty_table_and_null_keys(as_docs):
    assert near_copies(as_docs([])).collect() == []
    assert sorted(str(r.component_id) for r in near_copies(as_docs(["a b", "A  b", "c"], ids=[None, 7, None])).collect()) == ["7", "7", "None"]


def cut_and_extended(rnd, n, size):
    """Texts, then for each a cut one, one with other text after it and one with a passage before it, all at 0.8 or more."""
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(4, 9)))
    texts = [[word() for _ in range(rnd.randrange(*size))] for _ in range(n)]
    more = [w[: -max(1, len(w) * 17 // 100)] for w in texts]
    more += [w + [word() for _ in range(len(w) * 18 // 100)] for w in texts]
    more += [[word() for _ in range(len(w) * 18 // 100)] + w for w in texts]
    return [" ".join(w) for w in texts + more]


def test_cut_extended_and_short_copies_are_found(as_docs):
    rnd = random.Random(8)
    texts = cut_and_extended(rnd, 40, (30, 60)) + cut_and_extended(rnd, 40, (60, 150))
    texts += ["a b c d e f", "a b c d e", "b c d e f", "q w e r t y u i o p a s d f", "q w e r t y u i o p a s d"]
    got = {r.doc_id: r.component_id for r in near_copies(as_docs(texts)).collect()}
    assert got == brute(texts)


def test_texts_of_one_key_and_null_keys_are_compared_each(as_docs):
    rnd = random.Random(4)
    texts = cut_and_extended(rnd, 6, (30, 60))
    # keys: the cut texts of the first three share one key, those of the others have none
    ids = [*range(6), 90, 90, 90, None, None, None, *range(100, 112)]
    got = near_copies(as_docs(texts, ids=ids)).collect()
    want = {i: i for i in range(6)} | {100 + i: i % 6 for i in range(12)}
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None and r.doc_id != 90} == want
    assert sorted(r.component_id for r in got if r.doc_id == 90) == [0, 1, 2]
    assert sorted(r.component_id for r in got if r.doc_id is None) == [3, 4, 5]


def test_near_copies_within_a_crowd_of_one_template(as_docs):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(8))
    template = [word() for _ in range(600)]
    texts = [[word() if i % 25 == 0 else w for i, w in enumerate(template)] for _ in range(250)]
    for w in texts[:40]:
        texts.append([*w[:302], word(), *w[303:]])
    texts = [" ".join(w) for w in texts]
    got = {r.doc_id: r.component_id for r in near_copies(as_docs(texts)).collect()}
    assert got == {i: i if i < 250 else i - 250 for i in range(290)}


def test_long_texts_near_the_limit(as_docs):
    """Prefixes of which a share is looked at; edits that leave similarities on both sides of the limit, and a passage that many share."""
    rnd = random.Random(17)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 8)))
    passage, texts = [word() for _ in range(80)], []
    for n in (480, 520, 600, 650, 800, 1100, 1500, 2500, 4000):
        base = [word() for _ in range(n)]
        texts.append(" ".join([*base, *passage]))
        for edits in (45, 47, 49, 52, 60):  # words between edits: similarities of about 0.8
            w = list(base)
            for at in range(edits // 2, n, edits):
                w[at] = word()
            texts.append(" ".join([*passage, *w]))
        texts += [" ".join(base[: int(n * 0.82)]), " ".join([*base, *(word() for _ in range(n // 5))]), " ".join([*base, *(word() for _ in range(n // 3))])]
    got = {r.doc_id: r.component_id for r in near_copies(as_docs(texts)).collect()}
    want = brute(texts)
    assert got == want and 9 < len(set(want.values())) < len(texts)


def test_a_crowd_makes_a_pair_once_and_only_where_enough_is_shared(spark):
    """Not a row for each shingle that a pair shares, nor one for pairs that share too few."""
    crowd = [(s, x, x, 1) for x in range(30) for s in range(8, 168, 8)]
    few = [(1000 + 8 * x, y, y, 1) for x in range(15) for y in (2 * x + 100, 2 * x + 101)]
    mixed = spark.createDataFrame(crowd + few, "shingle long, same long, root long, weight long")
    distinct = mixed.select("same").distinct().selectExpr("same", "40L AS n", "array_repeat(0L, 8) AS bits", "array(1L) AS more", "same AS rep")
    before = {c: spark.conf.get(c, None) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with Scratch(spark) as s:
            found = others(mixed, distinct, 0.8, s)
            assert {(r.a, r.b) for r in found.collect()} == {(a, b) for a in range(30) for b in range(a)}
            plans, made = [found._jdf.queryExecution().executedPlan()], []
            while plans:
                p = plans.pop()
                made += [p.metrics().apply("numOutputRows").value()] if p.nodeName().endswith("Join") else []
                plans += [p.children().apply(i) for i in range(p.children().size())]
            assert made == [30 * 29 // 2]
    finally:
        for c, v in before.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)


def test_the_sample_for_the_order_changes_no_result(as_docs, monkeypatch):
    rnd = random.Random(8)
    texts = cut_and_extended(rnd, 10, (60, 150))
    want, got = brute(texts), []
    for most, common in ((1, 0), (1, 200_000), (5_000, 200_000)):
        monkeypatch.setattr(near, "SAMPLE", most)
        monkeypatch.setattr(near, "COMMON", common)
        got.append({r.doc_id: r.component_id for r in near.near_copies(as_docs(texts)).collect()})
    assert got == [want] * 3
