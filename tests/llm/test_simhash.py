import random
import re
from collections import defaultdict

import pytest
import xxhash

from keyloom.llm.common import Scratch
from keyloom.llm.components import components
from keyloom.llm.simhash import ball_links, fingerprints, near_duplicates


def brute_print(text, shingle=3):
    low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    w = re.findall(rb"[^\x20\x09-\x0d]+", low)
    if not w:
        return 0
    sh = [b" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))]
    h = [xxhash.xxh64(x, seed=42).intdigest() for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, radius=2):
    ids, root = list(prints), {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and bin(prints[i] ^ prints[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_whole_operator_against_brute_force(as_docs, odd_texts):
    rnd = random.Random(2)
    texts = list(odd_texts)
    base = " ".join(rnd.choice(["red", "Blue", "green", "über", "a-much-longer-word-than-others"]) for _ in range(400))
    for _ in range(40):
        w = base.split()
        if rnd.random() < 0.7:
            w[rnd.randrange(len(w))] = "changed"
        texts.append(" \n".join(w))
    texts += [base] * 5
    got = {r.doc_id: r for r in near_duplicates(as_docs(texts)).collect()}
    prints = {i: brute_print(t) for i, t in enumerate(texts)}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == prints
    assert all(len(r.fingerprint) == 16 for r in got.values())
    assert {i: r.component_id for i, r in got.items()} == brute_components(prints)


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_links_connect_what_all_pairs_connect(spark, radius):
    rnd = random.Random(radius)
    seeds = [rnd.getrandbits(64) for _ in range(6)]
    prints = {x ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(4))) for x in seeds for _ in range(25)} | {0, 1 << 63, (1 << 64) - 1}
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    with Scratch(spark) as s:
        got = {r.node: r.root for r in components(ball_links(df, radius), s).collect()}
    want = brute_components({x: x & (2**64 - 1) for x in signed}, radius)
    assert {x: got.get(x, x) for x in signed} == want


def test_components_of_chains_stars_and_copies(spark):
    rnd = random.Random(8)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 400)] + [(5000, 5001)] * 3 + [(7, 7)]
    rnd.shuffle(edges)
    with Scratch(spark) as s:
        got = {r.node: r.root for r in components(spark.createDataFrame(edges, "x long, y long").repartition(9), s).collect()}
    want = {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(400)} | {5000: 5000, 5001: 5000}
    assert got == want


def test_empty_table_and_null_key(as_docs):
    assert near_duplicates(as_docs([])).collect() == []
    rows = near_duplicates(as_docs(["a b", "a b", "other words here now"], ids=[None, 4, None])).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.fingerprint].append(r.component_id)
    assert sorted(map(len, by.values())) == [1, 2] and [4, 4] in by.values() and [None] in by.values()


def test_long_text(as_docs):
    text = "word " * 200_000 + "end"
    assert int(fingerprints(as_docs([text])).first().fp) & (2**64 - 1) == brute_print(text)


def test_components_of_many_tasks(spark, monkeypatch):
    """More edges than a task takes: several rounds of hooking and jumping."""
    from keyloom.llm import components as c

    monkeypatch.setattr(c, "EDGES", 20)
    rnd = random.Random(11)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1001 + i) for i in range(60)] + [(rnd.randrange(2000, 2100), rnd.randrange(2000, 2100)) for _ in range(60)] + [(7, 7), (1000, 1001)]
    with Scratch(spark) as s:
        got = {r.node: r.root for r in components(spark.createDataFrame(edges, "x long, y long").repartition(9), s).collect()}
    root = {x: x for e in edges for x in e}
    for _ in root:
        for x, y in edges:
            root[x] = root[y] = min(root[x], root[y])
    alone = {7} if 7 not in got else set()
    assert got == {x: r for x, r in root.items() if x not in alone and any(x in e and e[0] != e[1] for e in edges)}
