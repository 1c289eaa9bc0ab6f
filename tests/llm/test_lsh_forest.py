import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.llm import lsh_forest
from keyloom.llm.lsh_forest import hashes, nearest, under


def brute(rows, is_query, top=5):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in ok:
        if is_query(i):
            near = sorted((-float((v * w).sum() / (np.sqrt((w * w).sum()) * np.sqrt((v * v).sum()))), j) for j, w in ok if j != i and len(w) == len(v))
            out[i] = [(j, -s) for s, j in near[:top]]
    return {i: x for i, x in out.items() if x}


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, rep string")


def run(spark, rows, mod):
    got = defaultdict(list)
    for r in nearest(table(spark, rows), F.col("vec_id") % mod == 0).orderBy("query_id", "rank").collect():
        assert r.rank == len(got[r.query_id]) + 1
        got[r.query_id].append((r.vec_id, r.score))
    return dict(got)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 8)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000 + i, x[0].tolist()) for i in range(60)]  # a common vector, among them queries
    rows += [(2000, None), (2010, [0.0] * 8), (2020, [1.0, None] + [0.0] * 6), (2030, [float("nan")] * 8), (2040, [float("inf")] + [0.0] * 7), (None, x[1].tolist()), (2050, [])]
    rows += [(3000, [1.0, 2.0]), (3010, [2.0, 4.0]), (3020, [-1.0, 0.5]), (20, x[20].tolist()), (4000, (x[3] * 2).tolist())]
    return rows


def test_small_table_is_exact(spark, rows):
    got, want = run(spark, rows, 10), brute(list(dict((str(r), r) for r in rows).values()), lambda i: i % 10 == 0)
    assert set(got) == set(want)
    for i in want:
        assert [j for j, _ in got[i]] == [j for j, _ in want[i]], i
        assert np.allclose([s for _, s in got[i]], [s for _, s in want[i]], rtol=1e-14)


def test_split_shards_give_the_same(spark, rows, monkeypatch):
    want = run(spark, rows, 10)
    monkeypatch.setattr(lsh_forest, "SHARD", 64)
    monkeypatch.setattr(lsh_forest, "LARGE", 1)
    monkeypatch.setattr(lsh_forest, "LEAST", 1000)
    got = run(spark, rows, 10)
    same = sum(len({j for j, _ in got[i]} & {j for j, _ in want[i]}) for i in want)
    assert same >= 0.9 * sum(map(len, want.values()))


def test_recall(spark):
    x = np.random.default_rng(2).standard_normal((6000, 32)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = run(spark, rows, 100)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hit = 0
    for i in range(0, 6000, 100):
        s = u @ u[i]
        s[i] = -9
        hit += len(set(np.argsort(-s)[:5].tolist()) & {j for j, _ in got[i]})
    assert hit >= 0.9 * 5 * 60


def test_empty_and_alone(spark):
    assert run(spark, [], 1) == {}
    assert run(spark, [(0, [1.0]), (7, None)], 1) == {}
    assert run(spark, [(0, [1.0]), (1, [2.0])], 1) == {0: [(1, 1.0)], 1: [(0, 1.0)]}


def test_prefix_ranges_by_brute_force():
    keys = np.sort(hashes(np.random.default_rng(3).standard_normal((200, 5)), 0))
    for n in (0, 1, 5, 64):
        a, b = under(keys, keys[:20], np.full(20, n))
        for i in range(20):
            assert b[i] - a[i] == sum(bin(int(k) ^ int(keys[i]))[2:].zfill(64)[:n].count("1") == 0 for k in keys)


def test_a_recall_of_one_is_exact_also_over_many_split_shards(spark, rows, monkeypatch):
    monkeypatch.setattr(lsh_forest, "SHARD", 64)
    monkeypatch.setattr(lsh_forest, "LARGE", 1)
    found = nearest(table(spark, rows), F.col("vec_id") % 10 == 0, recall=1.0).collect()
    want = brute(list(dict((str(r), r) for r in rows).values()), lambda i: i % 10 == 0)
    got = defaultdict(list)
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append(r.vec_id)
    assert dict(got) == {i: [j for j, _ in x] for i, x in want.items()}


def test_recall_of_clustered_vectors_away_from_the_origin_and_of_lone_queries(spark, monkeypatch):
    """Shards are small and few entries are asked for at least, so the number is measured and queries ascend over shards."""
    monkeypatch.setattr(lsh_forest, "SHARD", 128)
    monkeypatch.setattr(lsh_forest, "LARGE", 2)
    monkeypatch.setattr(lsh_forest, "LEAST", 16)
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((6, 16)) * 2
    x = 3 + np.concatenate([centres[rng.integers(0, 6, 3000)] + 0.5 * rng.standard_normal((3000, 16)), rng.standard_normal((40, 16)) * 6])
    x = x.astype(np.float32)
    got = run(spark, [(i, v.tolist()) for i, v in enumerate(x)], 40)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hit = 0
    for i in range(0, len(x), 40):
        s = u @ u[i]
        s[i] = -9
        hit += len(set(np.argsort(-s)[:5].tolist()) & {j for j, _ in got[i]})
    assert all(len(v) == 5 for v in got.values()) and hit >= 0.9 * 5 * len(range(0, len(x), 40))


def test_tiny_and_huge_doubles_take_part(spark):
    """Vectors whose squares are no doubles have the neighbours of their directions."""
    rnd = np.random.default_rng(3)
    x = rnd.standard_normal((120, 5))
    rows = [(i, (v * s).tolist()) for i, (v, s) in enumerate(zip(x, [1e-200, 1.0, 1e200, 5e-308] * 30, strict=True))]
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(0, 120, 10):
        cos = unit @ unit[i]
        cos[i] = -2
        best = np.argsort(-cos)[:5]
        assert [got[i, k + 1][0] for k in range(5)] == best.tolist()
        assert np.allclose([got[i, k + 1][1] for k in range(5)], cos[best], atol=1e-7)
