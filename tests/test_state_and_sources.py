"""Streams that are restarted, pages read by several tasks, answers that are asked for once, intervals that are extended."""

import json
import random

import pytest
from pyspark.sql import functions as F

from keyloom.config import DEFAULTS
from keyloom.operators import history, lemma, review, verdicts
from keyloom.operators.answers import AnswerLog
from keyloom.operators.tables import scratch_path
from keyloom.plans.review_plan import run_filter
from keyloom.sources import change_pages
from keyloom.streaming import state


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / f".{name}").write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows))
    (folder / f".{name}").rename(folder / f"{name}.json")


VERDICTS, DECISIONS = "key string, verdict string, zh_current string, reason string", "cache_key string, action string, reason string, ord long"


def test_a_restarted_filter_stream_decides_as_the_batch(spark, tmp_path):
    rnd = random.Random(2)
    state.use_rocksdb(spark)
    rows = [{"key": f"k{i}", "verdict": rnd.choice(["FAIL", "SUGGEST"]), "zh_current": "译", "reason": rnd.choice(["a", "b"])} for i in range(60)]
    rows += [dict(rows[0]) for _ in range(100)]  # many verdicts wait for one decision
    keyed = verdicts.with_cache_keys(spark.createDataFrame(rows, VERDICTS))
    keys = sorted({r.cache_key for r in keyed.collect()})
    made = [{"cache_key": k, "action": rnd.choice(["PASS", "KEEP"]), "reason": rnd.choice(["", "why", None]), "ord": 1} for k in keys if rnd.random() < 0.8 or k == keys[0]]
    run = lambda: state.store(state.decided(spark.readStream.schema(VERDICTS).json(str(tmp_path / "v")), spark.readStream.schema(DECISIONS).json(str(tmp_path / "d"))), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    # first verdicts without decisions, then some of both, each time by a stream that is started anew
    put(tmp_path / "v", "1", rows[:40])
    put(tmp_path / "d", "0", [])
    run()
    put(tmp_path / "v", "2", rows[40:130])
    put(tmp_path / "d", "2", made[: len(made) // 2])
    run()
    put(tmp_path / "v", "3", rows[130:])
    put(tmp_path / "d", "3", made[len(made) // 2 :])
    run()
    run()  # nothing new: nothing is answered again
    got = sorted((r.key, r.action, r.reason) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    split = verdicts.split_by_cache(spark.createDataFrame(rows, VERDICTS), spark.createDataFrame(made, DECISIONS))
    assert got == sorted((r.key, r.action, r.cleaned or "") for r in split.where("hit").collect()) and len(got) > 60


def test_a_later_decision_holds_for_later_verdicts(spark, tmp_path):
    state.use_rocksdb(spark)
    row = lambda k: {"key": k, "verdict": "FAIL", "zh_current": "x", "reason": "r"}
    same = verdicts.with_cache_keys(spark.createDataFrame([row("a")], VERDICTS)).first().cache_key
    run = lambda: state.store(state.decided(spark.readStream.schema(VERDICTS).json(str(tmp_path / "v")), spark.readStream.schema(DECISIONS).json(str(tmp_path / "d"))), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    for n, (ord_, action) in enumerate([(2, "KEEP"), (1, "PASS"), (3, "PASS")]):
        put(tmp_path / "v", str(n), [row("a")])
        put(tmp_path / "d", str(n), [{"cache_key": same, "action": action, "reason": "", "ord": ord_}])
        run()
    assert [r.action for r in spark.read.parquet(str(tmp_path / "out")).collect()].count("KEEP") == 2


def test_restarted_merges_equal_the_batch(spark, tmp_path):
    state.use_rocksdb(spark)
    rnd = random.Random(4)
    names = ["iron", "irons", "gold", "golds", "goldy", "stone", "stones"]
    batches = [[{"norm": n, "target": rnd.choice(names), "ord": k} for n in rnd.sample(names, 3)] for k in range(4)]
    cache = spark.createDataFrame([], "canonical string, variants array<string>, freq long")
    for k, rows in enumerate(batches):
        put(tmp_path / "in", str(k), rows)
        state.store(state.merged_terms(spark.readStream.schema("norm string, target string, ord long").json(str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    # the batch's own way: of several targets of one variant in a batch the first by name
    now = {}
    for rows in batches:
        one = {}
        for r in rows:
            for v in (r["norm"], r["target"]):
                one[v] = min(one.get(v, r["target"]), r["target"])
        now |= one
    log = spark.read.parquet(str(tmp_path / "out")).collect()
    at, left = {}, list(log)
    while left:  # moves follow each other
        step = next(r for r in left if at.get(r.variant) == r.was)
        at[step.variant] = step.canonical
        left.remove(step)
    assert at == now
    first = [r for r in batches[0]]
    merged = lemma.variant_map(lemma.record_merges(cache, spark.createDataFrame([(r["norm"], r["target"]) for r in first], "norm string, target string"))).collect()
    assert {r.variant for r in merged} <= set(now)


# ---- pages
def saved(folder, n, size):
    """A service of saved pages; which pages were asked for is a file each."""
    folder = str(folder)

    def page(number):
        import os
        import uuid

        os.makedirs(f"{folder}/asked", exist_ok=True)
        open(f"{folder}/asked/{number}-{uuid.uuid4().hex}", "w").close()
        rows = int(open(f"{folder}/n").read()) if os.path.exists(f"{folder}/n") else n
        return [{"filename": f"f{i}", "status": "added" if i % 2 else None} for i in range((number - 1) * size, min(rows, number * size))]

    return page


@pytest.mark.parametrize("n", [0, 1, 5, 10, 57])
def test_pages_are_read_by_several_tasks(spark, tmp_path, n):
    got = change_pages.read_pages(spark, saved(tmp_path, n, 5), 5, 3, name=f"pages{n}")
    assert got.rdd.getNumPartitions() == 3
    assert sorted(r.filename for r in got.collect()) == sorted(f"f{i}" for i in range(n))
    asked = [int(p.name.split("-")[0]) for p in (tmp_path / "asked").iterdir()]
    assert len(asked) <= n // 5 + 3 and len(set(asked)) == len(asked)
    assert change_pages.last_row(saved(tmp_path, n, 5), 5) == n == change_pages.last_row(saved(tmp_path, n, 5), 5, n // 2)


def test_a_stream_takes_what_comes_to_be(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(change_pages, "PAGES", 2)
    service = saved(tmp_path, 0, 5)
    for n in (7, 8, 8, 33):
        (tmp_path / "n").write_text(str(n))
        stream = change_pages.stream_pages(spark, service, 5, name="growing_pages")
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(60)
        assert sorted(r.filename for r in spark.read.schema(change_pages.SCHEMA).parquet(str(tmp_path / "out")).collect()) == sorted(f"f{i}" for i in range(n))


# ---- answers
def counting(folder, bad=()):
    def call(prompt):
        import os
        import uuid

        os.makedirs(folder, exist_ok=True)
        open(f"{folder}/{uuid.uuid4().hex}", "w").write(prompt)
        if prompt in bad:
            raise ValueError("no answer")
        return json.dumps([{"key": k, "verdict": "PASS", "reason": "fine"} for k in prompt.split("`")[1::2]] or [{"key": prompt, "verdict": "PASS", "reason": ""}])

    return call


def calls(folder):
    import os

    return sorted(open(f"{folder}/{f}").read() for f in os.listdir(folder)) if os.path.isdir(folder) else []


def test_a_prompt_is_asked_once(spark, tmp_path, monkeypatch):
    from keyloom.operators import answers

    monkeypatch.setattr(answers, "EACH", 7)
    log = AnswerLog(spark, scratch_path(spark))
    prompts = spark.createDataFrame([(f"p{i % 20}",) for i in range(60)] + [(None,)], "prompt string")
    once = review.review(prompts, counting(str(tmp_path / "a")), log=log)
    assert calls(str(tmp_path / "a")) == sorted(f"p{i}" for i in range(20))
    assert once.count() == 20 and sorted(r.key for r in once.collect()) == sorted(f"p{i}" for i in range(20))  # twice computed
    failing = once.rdd.mapPartitions(lambda rows: iter([1 / 0]))
    with pytest.raises(Exception, match="division"):
        failing.collect()
    # another run, and another log of the same folder
    more = spark.createDataFrame([("p3",), ("new",)], "prompt string")
    review.review(more, counting(str(tmp_path / "a")), log=AnswerLog(spark, log.path)).collect()
    assert len(calls(str(tmp_path / "a"))) == 21
    # one that failed is a REVIEW row, and is asked again by the next run
    quick = DEFAULTS.__class__(review_retries=0)
    bad = review.review(spark.createDataFrame([("bad",)], "prompt string"), counting(str(tmp_path / "b"), {"bad"}), settings=quick, log=log)
    assert [(r.key, r.reason) for r in bad.collect()] == [(review.ERROR_KEY, "LLM调用失败: no answer")] == [(r.key, r.reason) for r in bad.collect()]
    good = review.review(spark.createDataFrame([("bad",)], "prompt string"), counting(str(tmp_path / "b")), settings=quick, log=log)
    assert [r.key for r in good.collect()] == ["bad"] and len(calls(str(tmp_path / "b"))) == 2
    assert log.ask(more.where("prompt = 'none'"), counting(str(tmp_path / "c"))).collect() == [] and calls(str(tmp_path / "c")) == []


def test_the_filter_asks_once_for_both_its_results(spark, tmp_path):
    rows = [(f"k{i}", "e", "z", "FAIL", "", f"r{i}", "format_check") for i in range(30)]
    merged = spark.createDataFrame(rows, "key string, en_current string, zh_current string, verdict string, suggestion string, reason string, source string")
    cache = spark.createDataFrame([], "cache_key string, action string, reason string")
    out, after = run_filter(merged, cache, counting(str(tmp_path / "f")))
    assert {r.verdict for r in out.collect()} == {"PASS"} and after.count() == 30 == out.count()
    asked = calls(str(tmp_path / "f"))
    assert len(asked) == len(set(asked)) == 2


# ---- intervals
@pytest.mark.parametrize("share", [0.0, 0.2, 0.9])
def test_extended_intervals_equal_those_of_all_rows(spark, share):
    rnd = random.Random(3)
    rows = [(k, rnd.randrange(100), rnd.choice("abc"), None if rnd.random() < 0.2 else "t", f"v{n}") for n, k in enumerate(rnd.choices("mnopqrs", k=300))]
    schema = "key string, day int, en string, zh string, version string"
    how = (["key"], [F.col("day"), F.col("version")], ["en", "zh"], "version")
    # in order (by day), and some late ones
    new = [r for r in rows if r[1] >= 60 or rnd.random() < share or r[0] == "s"]
    old = [r for r in rows if r not in new]
    a, b = (spark.createDataFrame(x, schema) for x in (old, new))
    runs = history.intervals(a, *how, with_end=True).checkpoint()
    got = history.extend_intervals(runs, a, b, *how)
    want = history.intervals(spark.createDataFrame(rows, schema), *how, with_end=True)
    # where a run stands is a struct of the order's columns, whatever they are called
    plain = lambda df: sorted(((*r[:-1], tuple(r.end)) for r in df.select("key", "en", "zh", "version_start", "version_end", "changes", "nth", "end").collect()), key=str)
    assert plain(got) == plain(want)
    assert plain(history.extend_intervals(runs, a, b.where("day < 0"), *how)) == plain(runs)
