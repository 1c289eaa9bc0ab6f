"""Recall by pruned lists, the kept index, numbering, substring and edit-distance joins, automata: against plain Python, with crowds and odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from keyloom.operators import fuzzy, glossary, recall, routing, substrings, terms
from keyloom.operators.numbering import numbered
from keyloom.operators.recall_index import RecallIndex
from keyloom.operators.tables import Cut, scratch_path


# ---- numbering
def test_numbers_in_an_order_over_ranges(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), f"k{rnd.randrange(10**9):09}") for _ in range(3000)] + [("z", "only")]
    df = spark.createDataFrame(rows, "g string, k string").repartition(5)
    got = numbered(df, ["k"])
    assert [r.k for r in got.orderBy("nth").collect()] == sorted(k for _, k in rows) and got.agg(F.max("nth")).first()[0] == len(rows) - 1
    by = {}
    for r in numbered(df, ["k"], "g").collect():
        by.setdefault(r.g, {})[r.nth] = r.k
    assert set(by) == {"a", "b", None, "z"}
    for g, found in by.items():
        assert [found[i] for i in range(len(found))] == sorted(k for h, k in rows if h == g)
    assert numbered(df.where("k = 'x'"), ["k"], "g").collect() == []


def test_no_window_sees_the_rows(spark):
    df = spark.range(100).selectExpr("'p' AS g", "cast(id AS string) AS k")
    plan = numbered(df, ["k"], "g")._jdf.queryExecution().optimizedPlan().toString()
    window = next(line for line in plan.splitlines() if "Window [" in line)
    assert "_n#" in window and "k#" not in window  # only the counts of ranges


def test_terms_in_order_and_their_sink(spark, tmp_path):
    from keyloom.sources import sinks

    rows = spark.createDataFrame([("b", 3), ("a", 3), ("c", 9), ("d", 1)], "term string, freq long").repartition(3)
    assert [(r.rank, r.term) for r in terms.in_order(rows).orderBy("rank").collect()] == [(1, "c"), (2, "a"), (3, "b"), (4, "d")]
    sinks.save_terms(rows, str(tmp_path / "t"))
    lines = [x for f in sorted((tmp_path / "t").glob("part-*")) for x in f.read_text().splitlines()]
    assert [x.split('"')[3] for x in lines] == ["c", "a", "b", "d"]


# ---- recall
def memory_of(spark, n, seed=3, common="all"):
    rnd = random.Random(seed)
    words = [f"w{rnd.randrange(60)}" for _ in range(60)]
    rows = [(f"k{i:05}", " ".join([common, *rnd.choices(words, k=rnd.randrange(1, 9))]) if common else " ".join(rnd.choices(words, k=4)), rnd.choice(["", None, "译 w1"])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "key string, en string, zh string")


def best_of_all(spark, queries, memory, most):
    """The same by weighing and ordering all lines."""
    asked = recall.asked(queries)
    wanted = recall.lists_of(asked)
    every = recall.all_relevant(wanted, recall.weighed(*fuzzy._lists(wanted, memory, None)))
    out = {}
    for r in every.collect():
        out.setdefault(tuple(r.words), []).append((-r.score, r.key, r.hits))
    return {(q.q_key, n): (key, hits, -score / recall.UNIT) for q in asked.collect() for n, (score, key, hits) in enumerate(sorted(out.get(tuple(q.words or ()), []))[:most], 1)}


@pytest.mark.parametrize("common", ["all", ""])
def test_pruned_recall_equals_weighing_all_lines(spark, common):
    rnd = random.Random(9)
    rows, memory = memory_of(spark, 400, common=common)
    queries = [(f"q{i}", " ".join(rnd.choices(["all", "w1", "w2", "w33", "w4", "w5", "k000", "none", "w12!", "x"], k=rnd.randrange(1, 5)))) for i in range(40)] + [("e", ""), ("n", None), ("t", "all al all")]
    q = spark.createDataFrame(queries, "q_key string, query string")
    for most in (1, 7, 60):
        got = {(r.q_key, r.nth): (r.key, r.hits, r.score) for r in fuzzy.recall_best(q, memory, most).collect()}
        assert got == best_of_all(spark, q, memory, most)


def test_a_word_in_every_line_costs_a_head(spark, monkeypatch):
    """Of 300 queries and 2,000 lines that all share two words, no table is made that grows with queries times lines."""
    rows = [(f"k{i:05}", f"same word u{i}", "") for i in range(2000)]
    memory = spark.createDataFrame(rows, "key string, en string, zh string")
    q = spark.createDataFrame([(f"q{i}", f"same word u{i}") for i in range(300)], "q_key string, query string")
    sizes, call = [], Cut.__call__

    def counted(self, df):
        out = call(self, df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(Cut, "__call__", counted)
    found = fuzzy.recall_best(q, memory, 10)
    assert found.count() == 3000
    # the lists themselves (at most the two common words and the beginnings of its number for each line), then heads and best lines
    assert sizes[0] < 5 * 2000 and max(sizes[1:]) <= 300 * 10 + 300 * 10
    first = {r.q_key: r.key for r in found.where("nth = 1").collect()}
    assert all(first[f"q{i}"] == f"k{i:05}" for i in range(300))


# ---- the kept index
def index_rows(index):
    return (sorted(map(tuple, index.postings().collect())), sorted(map(tuple, index.dictionary().select("token", "lines", "rank").collect())), sorted(tuple(r) for r in index.lines().select("key", "digest", "words").collect()), index.size())


def test_an_updated_index_equals_a_new_one(spark):
    rows, memory = memory_of(spark, 300)
    path = scratch_path(spark)
    index = RecallIndex.build(memory, path)
    assert index_rows(index) == index_rows(RecallIndex.build(memory, scratch_path(spark)))
    now = {k: (en, zh) for k, en, zh in rows}
    for step in range(3):
        for i in range(step, 300, 10):
            now[f"k{i:05}"] = (f"changed w{i} step{step}", None)
        for i in range(step + 5, 300, 50):
            now.pop(f"k{i:05}", None)
        now[f"new{step}"] = (f"fresh {step}", "")
        now["empty"] = ("", "") if step else (None, None)
        later = spark.createDataFrame([(k, *v) for k, v in now.items()], "key string, en string, zh string")
        index = index.update(later)
        cut = spark.read.parquet(f"{path}/lines/generation={step + 1}").count()
        assert cut <= 32 + (step == 0)  # only changed and new lines were cut into words
        assert index_rows(index) == index_rows(RecallIndex.build(later, scratch_path(spark)))
    assert index_rows(RecallIndex(spark, path)) == index_rows(index) == index_rows(index.compact(scratch_path(spark)))
    # an update that ended before its commit is as if it hadn't been
    spark.createDataFrame([("k", "t", 1, 1)], "key string, token string, tf long, words int").write.parquet(f"{path}/postings/generation=4")
    assert RecallIndex(spark, path).generation == 3 and index_rows(RecallIndex(spark, path)) == index_rows(index)
    q = spark.createDataFrame([("q", "changed w2")], "q_key string, query string")
    same = [sorted(map(tuple, fuzzy.fuzzy_search(q, later, index=i).collect())) for i in (None, index, recall.index_tokens(later))]
    assert same[0] and same[0] == same[1] == same[2]


def test_beginnings_are_intervals_of_the_dictionary(spark, monkeypatch):
    from keyloom.operators import recall_index

    monkeypatch.setattr(recall_index, "BLOCK", 4)
    rnd = random.Random(5)
    words = sorted({"".join(rnd.choice("abé中") for _ in range(rnd.randrange(1, 6))) for _ in range(300)} - {""})
    index = RecallIndex.build(spark.createDataFrame([(w, None, None) for w in words], "key string, en string, zh string"), scratch_path(spark))
    prefixes = sorted({w[:n] for w in words for n in (2, 3, 9)} | {"zz", "a", "中中中中中中"})
    got = {}
    for r in index.matching(spark.createDataFrame([(p,) for p in prefixes], "prefix string")).collect():
        got.setdefault(r.prefix, []).append((r.rank, r.token))
    assert {p: [t for _, t in sorted(v)] for p, v in got.items()} == {p: m for p in prefixes if (m := sorted((w for w in words if w.startswith(p)), key=str.encode))}
    assert all([n for n, _ in sorted(v)] == list(range(min(v)[0], min(v)[0] + len(v))) for v in got.values())


# ---- joins of texts
def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


@pytest.mark.parametrize("threshold", [90.0, 75.0, 65.0, 40.0])
def test_no_similar_pair_is_lost_and_few_others_meet(spark, threshold):
    rnd = random.Random(4)
    base = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(0, 16))) for _ in range(60)]
    found = [*base, *("".join(c if rnd.random() > 0.15 else rnd.choice(["", "x", c + "y"]) for c in w) for w in base)]
    rows = [(i, w) for i, w in enumerate(found)]
    pairs = {(r.a, r.b) for r in substrings.edit_candidates(spark.createDataFrame(rows, "id long, term string"), threshold).collect()}
    want = {(i, j) for i, v in rows for j, w in rows if i != j and (len(v), i) < (len(w), j) and max(len(v), len(w)) and round(100 * (1 - distance(v, w) / max(len(v), len(w))), 2) >= threshold}
    assert want <= pairs and len(pairs) == len({frozenset(p) for p in pairs})
    if threshold >= 75:
        assert len(pairs) <= 4 * len(want) + 100 and len(want) > 5


def test_containing_by_rare_pieces(spark):
    rnd = random.Random(6)
    text = lambda n: "".join(rnd.choice("ab中") for _ in range(n))
    short = [(g, text(rnd.randrange(0, 7)), i) for i, g in enumerate(["x", "y"] * 40)]
    long = [(g, text(rnd.randrange(0, 14)), i % 4 + 1) for i, g in enumerate(["x", "y", "z"] * 40)]
    s, l = spark.createDataFrame(short, "g string, s string, i int"), spark.createDataFrame(long, "g string, l string, w int")  # noqa: E741
    got = sorted(tuple(r) for r in substrings.containing(s, l, "g", "s", "l").select("g", "s", "i", "l", "w").collect())
    assert got == sorted((g, a, i, b, w) for g, a, i in short for h, b, w in long if g == h and a and a in b)
    need = substrings.containing(s.withColumn("need", F.lit(12)), l, "g", "s", "l", "w", "need")
    kept = {(r.g, r.s) for r in need.collect()}
    assert {(g, a) for g, a, _ in short if a and sum(w for h, b, w in long if g == h and a in b) >= 12} <= kept


def test_a_term_of_a_hundred_thousand_translations(spark):
    rows = spark.range(100_000).selectExpr("'iron' AS norm", "concat(conv(id, 10, 36), CASE WHEN id % 3 = 0 THEN '方铅' ELSE '岩石' END) AS zh", "1L AS cnt", "id AS first")
    rows = rows.unionByName(spark.createDataFrame([("iron", "岩石", 3, -1), ("iron", "方铅", 3, -2)], "norm string, zh string, cnt long, first long"))
    assert [tuple(r) for r in glossary.common_substring(rows, 0.6).collect()] == [("iron", "岩石")]


@pytest.mark.parametrize("shard", [1 << 20, 40])
def test_automata_find_all_patterns(spark, monkeypatch, shard):
    monkeypatch.setattr(substrings, "SHARD", shard)
    rnd = random.Random(8)
    text = lambda n: "".join(rnd.choice("ab中") for _ in range(n))
    texts = [(i, text(rnd.randrange(30))) for i in range(50)] + [(98, None), (99, "")]
    words = sorted({text(rnd.randrange(1, 5)) for _ in range(15)})
    patterns = [(w, f"{w}!{n}") for w in words for n in range(2)] + [("", "empty")]
    t, p = spark.createDataFrame(texts, "id long, t string"), spark.createDataFrame(patterns, "pattern string, out string")
    assert sorted(tuple(r) for r in substrings.contained(t, p, "id", "t").collect()) == sorted((i, w) for i, x in texts for w in words if x and w in x)
    want = {}
    for i, x in texts:
        for s in range(len(x or "")):
            fit = [w for w in words if x.startswith(w, s)]
            if fit:
                want.setdefault(i, []).append((s + 1, len(max(fit, key=len)), max(fit, key=len) + "!0"))
    assert {r.id: [tuple(x) for x in r.spans] for r in substrings.spans(t, p, "id", "t").collect()} == want
    assert substrings.contained(t, p.where("pattern = ''"), "id", "t").collect() == []


def test_cover_and_hints(spark):
    g = spark.createDataFrame([("Iron", "铁"), ("iron sword", "铁剑"), ("Sword", "剑"), ("a", "一")], "en string, zh string")
    e = spark.createDataFrame([("1", "Iron sword, iron", "铁剑铁"), ("2", "Iron door", "铁门"), ("3", "sword", "刀"), ("4", "A iron", "一铁"), ("5", None, None), ("6", "", "")], "key string, en string, zh string")
    assert {r.key for r in routing.covered(e, g).collect()} == {"1", "4"}
    assert {r.key: r.hints for r in routing.glossary_hints(e, g).collect()}["1"] == '"Iron" → "铁", "Sword" → "剑", "iron sword" → "铁剑"'


def test_similar_terms_and_contexts(spark):
    t = spark.createDataFrame([(1, "iron ingot"), (2, "iron ingots"), (3, "gold"), (4, "iron")], "id long, term string")
    assert [(r.a, r.b) for r in terms.similar_pairs(t).collect()] == [(1, 2)]
    texts = spark.createDataFrame([(i, x) for i, x in enumerate(["a b", "a", "a b c", "a b", "d", None, ""])], "pos long, text string")
    got = sorted(tuple(r) for r in glossary.pick_contexts_of(texts, F.array_distinct(F.split("text", " "))).collect())
    assert got == [("a", 0, "a b c"), ("a", 1, "a"), ("a", 2, "a b"), ("a", 3, "a b c"), ("b", 0, "a b c"), ("b", 1, "a b"), ("b", 2, "a b c")]
