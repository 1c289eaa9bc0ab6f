"""Steps whose cost a larger table showed: each against plain Python, and what it reads or moves."""

import random

import pytest
from pyspark.sql import functions as F

from keyloom.operators import answers, glossary, routing, tables, terms
from keyloom.operators.tables import scratch_path


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(("kind", "n"), [("bigrams", 2), ("trigrams", 3)])
@pytest.mark.parametrize("min_freq", [1, 2, 3, 6])
def test_ngrams_are_found_once(spark, kind, n, min_freq):
    rnd = random.Random(min_freq)
    # a crowd that shares its words, texts that are counted whole, and two entries at one position
    texts = ["all of us here", None, "", "one", "one two"] + ["same words here"] * 9 + [" ".join(rnd.choices(["aa", "bb", "cc"], k=rnd.randrange(1, 7))) for _ in range(60)]
    rows = [(f"k{i:03}", x, i // 2) for i, x in enumerate(texts)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "key string, value string, pos long").repartition(5)
    want = {}
    for key, x, pos in rows:
        w = (x or "").split()
        found = {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} | ({" ".join(w)} if n == 3 and len(w) > 3 else set())
        for g in found:
            want.setdefault(g, []).append((pos, key))
    got = terms.extract_terms(df, kind, min_freq)
    assert {r.term: (r.freq, r["keys"]) for r in got.collect()} == {g: (len(at), [k for _, k in sorted(at)[:5]]) for g, at in want.items() if len(at) >= min_freq}
    assert plan_of(got).count("Generate explode") == 1


def test_terms_are_put_in_order_from_a_table(spark):
    rows = spark.createDataFrame([("a", "x y x"), ("b", "xx yy xx"), ("c", "xx zz")], "key string, value string").withColumn("pos", F.lit(1).cast("long"))
    got = terms.in_order(terms.extract_terms(rows, "unigrams", 1))
    assert [(r.rank, r.term, r.freq, r["keys"]) for r in got.orderBy("rank").collect()] == [(1, "xx", 2, ["b", "c"]), (2, "yy", 1, ["b"]), (3, "zz", 1, ["c"])]
    assert "Generate explode" not in plan_of(got)


# ---- answers
def test_rounds_read_the_prompts_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(answers, "EACH", 5)
    seen, asked = tmp_path / "seen", tmp_path / "asked"

    @F.udf("string")
    def prompt(i):
        with seen.open("a") as f:
            f.write(f"{i}\n")
        return f"p{i}"

    def call(p):
        with asked.open("a") as f:
            f.write(f"{p}\n")
        if p == "p7":
            raise ValueError("no")
        return p.upper()

    log = answers.AnswerLog(spark, scratch_path(spark))
    got = log.ask(spark.range(23).select(prompt("id").alias("prompt")), call)
    lines = lambda f: f.read_text().split()
    # each prompt is made once to be tested for null and once to be kept, whatever the number of rounds
    assert len(lines(seen)) <= 2 * 23 and sorted(lines(asked)) == sorted(f"p{i}" for i in range(23))
    assert sorted((r.answer or "", r.error) for r in got.collect()) == sorted([("", "no"), *((f"P{i}", None) for i in range(23) if i != 7)])
    asked.unlink()
    log.ask(spark.range(3, 25).select(prompt("id").alias("prompt")), call)
    assert sorted(lines(asked)) == ["p23", "p24", "p7"]


def per_task(log):
    """How many prompts each task of a log's rounds had."""
    return sorted(r["count"] for r in log.rows().groupBy(F.input_file_name()).count().collect())


def test_a_quick_reviewer_has_few_tasks(spark):
    log = answers.AnswerLog(spark, scratch_path(spark))
    got = log.ask(spark.range(3000).select(F.concat(F.lit("p"), "id").alias("prompt")), lambda p: p.upper())
    assert sorted(r.answer for r in got.collect()) == sorted(f"P{i}" for i in range(3000))
    # a round of a short task for each core, and the rest in tasks of about MOST
    assert sum(per_task(log)) == 3000 and len(per_task(log)) <= spark.sparkContext.defaultParallelism * 2 + 4


def test_a_slow_reviewers_tasks_stay_short(spark, monkeypatch):
    monkeypatch.setattr(answers, "SECONDS", 1)

    def call(p):
        import time

        time.sleep(0.2)
        return p.upper()

    log = answers.AnswerLog(spark, scratch_path(spark))
    got = log.ask(spark.range(300).select(F.concat(F.lit("p"), "id").alias("prompt")), call)
    assert sorted(r.answer for r in got.collect()) == sorted(f"P{i}" for i in range(300))
    # 4 at once of 0.2 seconds are 20 a second, so that no task has more than the shortest ones, as they are dealt by chance
    assert sum(per_task(log)) == 300 and per_task(log)[-1] <= 2 * 32 and len(per_task(log)) >= 300 // 32


def test_each_bucket_is_asked_once_in_many_rounds(spark, tmp_path, monkeypatch):
    for name, value in (("EACH", 5), ("MOST", 5), ("PER_WORKER", 1)):
        monkeypatch.setattr(answers, name, value)
    asked = tmp_path / "asked"

    def call(p):
        with asked.open("a") as f:
            f.write(f"{p}\n")
        if p == "p7":
            raise ValueError("no")
        return p.upper()

    log = answers.AnswerLog(spark, scratch_path(spark))
    got = log.ask(spark.range(60).select(F.concat(F.lit("p"), "id").alias("prompt")), call, parallel=1)
    assert sorted(asked.read_text().split()) == sorted(f"p{i}" for i in range(60))
    assert {r.answer for r in got.collect()} == {None, *(f"P{i}" for i in range(60) if i != 7)} and got.where("error = 'no'").count() == 1
    assert spark.read.parquet(log.path).select("part").distinct().count() >= 8


# ---- hits of a glossary
def test_hits_are_dealt_over_as_many_tasks_as_entries_ask_for(spark, monkeypatch):
    monkeypatch.setattr(tables, "ROWS", 10)
    rows = [(f"k{i:03}", ["Iron sword", "a red Sword", "none", "swords"][i % 4], "铁") for i in range(200)]
    entries = spark.createDataFrame(rows, "key string, en string, zh string")
    words = spark.createDataFrame([("sword", ["sword", "iron sword"], "剑"), ("iron", ["iron"], "铁")], "term string, variants array<string>, std_zh string")
    hits = glossary.term_hits(entries, words)
    whole = {0: {"sword", "iron"}, 1: {"sword"}}
    assert sorted((r.key, r.term) for r in hits.collect()) == sorted((k, w) for i, (k, _, _) in enumerate(rows) for w in whole.get(i % 4, ()))
    assert plan_of(hits).count("RepartitionByExpression [key") == 2 and "], 21" in plan_of(hits)
    hints = routing.glossary_hints(entries.select("key", "en"), words.select(F.col("term").alias("en"), F.col("std_zh").alias("zh")))
    assert {r.key: r.hints for r in hints.collect()} == {k: ['"iron" → "铁", "sword" → "剑"', '"sword" → "剑"', None, '"sword" → "剑"'][i % 4] for i, (k, _, _) in enumerate(rows) if i % 4 != 2}
    assert "RepartitionByExpression [key" in plan_of(hints) and "], 21" in plan_of(hints)


# ---- filter decisions
class Store:
    """A state store of one key that counts its calls."""

    def __init__(self):
        self.calls, self.value, self.list = [], None, []

    def getValueState(self, *_):  # noqa: N802
        return self

    getListState = getValueState  # noqa: N815

    def exists(self):
        self.calls.append("exists")
        return self.value is not None

    def get(self):
        # the value is asked for first, and then what waits
        self.calls.append("get")
        return self.value if self.calls.count("get") == 1 else iter(self.list)

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def appendList(self, rows):  # noqa: N802
        self.calls.append("append")
        self.list += rows

    def clear(self):
        self.calls.append("clear")
        self.list = []


def test_a_key_costs_few_calls_of_the_store_and_no_frames():
    from pyspark.sql import Row

    from keyloom.streaming.state import FilterDecisions

    store, decisions = Store(), FilterDecisions()
    decisions.init(store)

    def given(*rows):
        store.calls = []
        found = list(decisions.handleInputRows(("c",), iter([Row(cache_key="c", key=k, action=action, reason=why, ord=o) for k, action, why, o in rows]), None))
        return [tuple(r) for r in found], store.calls

    asked = lambda k: (k, None, None, None)
    made = lambda action, why, o: (None, action, why, o)
    assert given(asked("a"), asked("b")) == ([], ["get", "append"])
    # of one batch the decision with the largest ord counts, wherever it stands; of several with it the last, no reason being the last
    got, calls = given(made("KEEP", "x", 2), asked("d"), made("PASS", "z", 3), made("PASS", None, 3), made("KEEP", "y", 1))
    assert got == [("c", k, "PASS", "") for k in "abd"] and calls == ["get", "update", "get", "clear"]
    assert given(asked("e"), made("KEEP", "x", 2)) == ([("c", "e", "PASS", "")], ["get"])
    assert given(asked("f"), made("KEEP", "x", 3)) == ([("c", "f", "KEEP", "x")], ["get", "update"])


# ---- verdicts that several steps read
def counted(path):
    """A column function that notes each value that is computed, and a function that tells how many were."""

    @F.udf("string")
    def noted(x):
        with path.open("a") as f:
            f.write("x\n")
        return x

    return noted, lambda: len(path.read_text().split()) if path.exists() else 0


def test_the_filter_computes_its_verdicts_once(spark, tmp_path):
    from keyloom.plans.review_plan import run_filter

    noted, n = counted(tmp_path / "n")
    rows = [(f"k{i}", "e", "z", "FAIL" if i % 2 else "SUGGEST", "", f"r{i}", "format_check") for i in range(40)]
    merged = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in ("key", "en_current", "zh_current", "verdict", "suggestion", "reason", "source"))).withColumn("reason", noted("reason"))
    cache = spark.createDataFrame([], "cache_key string, action string, reason string")
    out, after = run_filter(merged, cache, lambda p: '[{"key": "k3", "verdict": "PASS", "reason": ""}, {"key": "k4", "verdict": "KEEP", "reason": "why"}]')
    want = {r[0]: (r[3], r[5]) for r in rows} | {"k3": ("PASS", ""), "k4": ("SUGGEST", "why")}
    assert {r.key: (r.verdict, r.reason) for r in out.collect()} == want and after.count() == 40
    assert n() == 40


def test_prompts_are_made_once(spark, tmp_path):
    noted, n = counted(tmp_path / "n")
    log = answers.AnswerLog(spark, scratch_path(spark))
    # a prompt that is never null is made for its row alone
    prompts = spark.range(12).select(F.concat(F.lit("p"), noted(F.col("id").cast("string"))).alias("prompt"))
    got = log.ask(prompts, lambda p: p.upper())
    first = n()
    assert sorted(r.answer for r in got.collect()) == sorted(f"P{i}" for i in range(12)) and got.count() == 12
    assert n() == first


@pytest.mark.parametrize("name", ["verdict_keep_all", "untranslated_split"])
def test_rules_run_once_for_all_that_a_query_reads(spark, name):
    from keyloom.queries import QUERIES

    got = QUERIES[name](spark, "/root/testdata/sf0.001")
    # the verdicts are read from a table, however often
    assert "posexplode" not in plan_of(got) and got.count() > 0


# ---- intervals
def test_intervals_are_dealt_over_as_many_tasks_as_versions_ask_for(spark, monkeypatch):
    from keyloom.operators import history

    monkeypatch.setattr(history, "EACH", 10)
    rnd = random.Random(7)
    rows = [(f"k{rnd.randrange(40)}", i, rnd.choice("ab"), f"v{i}") for i in range(300)]
    table = lambda x: spark.createDataFrame(x, "key string, day int, en string, version string")
    how = (["key"], [F.col("day")], ["en"], "version")
    want = history.intervals(table(rows), *how, with_end=True)
    assert "RepartitionByExpression [key" in plan_of(want) and "], 31" in plan_of(want)
    assert want.rdd.getNumPartitions() == 31
    # keys that are only old, only new, in order, and with late rows
    old = [r for r in rows if (r[1] < 200 and r[1] % 9 and r[0] != "k1") or r[0] in ("k2", "k3")]
    new = [r for r in rows if r not in old and r[0] not in ("k2", "k3")]
    got = history.extend_intervals(history.intervals(table(old), *how, with_end=True), table(old), table(new), *how)
    plain = lambda df: sorted((r.key, r.en, r.version_start, r.version_end, r.changes, r.nth, r.end.day) for r in df.collect())
    assert plain(got) == plain(want) and plain(want)
    # what is put together are tables; no task sorts for several steps at once
    assert "Window" not in plan_of(got)
