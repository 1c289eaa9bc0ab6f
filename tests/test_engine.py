import json

import pytest
from pyspark.sql import functions as F

from keyloom.config import load_settings
from keyloom.operators import align, fuzzy, glossary, graph, history, lexicon, review, routing, terms, verdicts
from keyloom.plans.review_plan import run_filter, run_review
from keyloom.sources import files, sinks
from keyloom.streaming.incremental import CHANGES, changed_entries, start_review


def kv(spark, d):
    return spark.createDataFrame(list(d.items()), "key string, value string")


def test_alignment(spark):
    a = align.align(kv(spark, {"a": "Apple", "b": "Banana", "c": "Cherry", "d": "DURIAN", "s": "two words"}), kv(spark, {"a": "苹果", "c": "Cherry", "d": "DURIAN", "e": "Elderberry", "s": "two words"}))
    assert align.align_stats(a).first() == (4, 1, 1, 1, 5, 5)
    assert [r.key for r in align.suspicious(a).collect()] == ["s"]


def test_changes_of_revisions(spark):
    old_en, new_en = {"both": "a", "en": "a", "zh": "a", "none": "a", "gone": "a"}, {"both": "b", "en": "b", "zh": "a", "none": "a", "new": "n"}
    old_zh, new_zh = {"both": "x", "en": "x", "zh": "x", "none": "x", "gone": "x"}, {"both": "y", "en": "x", "zh": "y", "none": "x", "new": "m"}
    got = {r.key: r for r in align.diff_revisions(*[kv(spark, x) for x in (old_en, new_en, old_zh, new_zh)]).collect()}
    assert {k: r.review_type for k, r in got.items()} == {"both": "normal", "en": "en_changed_zh_unchanged", "zh": "zh_only_change", "new": "normal", "gone": "normal"}
    assert got["en"].warning and not got["new"].warning and got["zh"].old_en is None and got["new"].old_en == ""
    df = align.diff_revisions(*[kv(spark, x) for x in (old_en, new_en, old_zh, new_zh)]).withColumn("namespace", F.lit("m"))
    assert df.where(align.is_deletion()).first().key == "gone"
    assert align.change_stats(df).first() == ("m", 4, 2, 1, 1, 1, 1)
    assert align.warned_entries(df).count() == 5


def test_pairing_of_files(spark):
    f = [("projects/assets/cf/1.20/m/lang/en_us.json", "modified"), ("projects/1.20/assets/cf2/m/lang/en_us.json", "added"), ("projects/1.20/assets/cf2/m/lang/zh_cn.json", "removed"), ("other.json", "added")]
    got = {r.module: r for r in align.pair_slots(spark.createDataFrame(f, "filename string, status string")).collect()}
    a, b = got["1.20/cf/m"], got["1.20/cf2/m"]
    assert a.en_base == a.en_head and a.zh_head == a.zh_base == "projects/assets/cf/1.20/m/lang/zh_cn.json"
    assert b.en_base is None and b.zh_head == b.zh_base == "projects/1.20/assets/cf2/m/lang/zh_cn.json"
    g = [("projects/assets/cf/1.20/m/ae2guide/a/i.md", "modified"), ("projects/assets/cf/1.20/m/ae2guide/_zh_cn/a/i.md", "added")]
    r = align.pair_guides(spark.createDataFrame(g, "filename string, status string")).collect()
    assert len(r) == 1 and r[0].key == "ae2guide:a/i.md" and r[0].zh_base is None and r[0].zh_head


@pytest.mark.parametrize(("text", "want"), [
    ("k=v\nk2:v2\n#c\n!c\n\n  x = a=b ", {"k": "v", "k2": "v2", "x": "a=b"}), ("a=1\\\n2\nnone", {"a": "12"}), ("#PARSE_ESCAPES\na\\=b=c\\n\\u4e2d\nnone", {"a=b": "c\n中", "none": ""}), ("", {}), ("﻿a=1\na=2", {"a": "2"}),
])
def test_lang_files(text, want):
    assert {k: v for k, v, _ in files.parse_lang(text)} == want


def test_map_files(spark, tmp_path):
    assert files.parse_json_map('﻿{"_comment": "x", "a": "1", "b": "2", "a": "3"}')[0] == ("a", "3", "repeated key 'a': the last value counts")
    (tmp_path / "m.json").write_text(json.dumps({"a": "1", "b": {"c": 1}}))
    (tmp_path / "m.lang").write_text("a=1")
    assert [(r.key, r.value, r.pos) for r in files.read_map(spark, str(tmp_path / "m.json")).orderBy("pos").collect()] == [("a", "1", 0), ("b", '{"c": 1}', 1)]
    assert files.read_map(spark, str(tmp_path / "m.lang")).count() == 1
    page = tmp_path / "projects/assets/cf/1/m/ae2guide/_zh_cn/i.md"
    page.parent.mkdir(parents=True)
    page.write_text("页")
    assert [(r.key, r.lang, r.value) for r in files.read_guides(spark, str(page.parent)).collect()] == [("ae2guide:i.md", "zh_cn", "页")]
    (tmp_path / "al.json").write_text(json.dumps({"all_entries": [{"key": "k", "en": "e", "zh": "z", "review_type": "normal"}]}))
    assert files.read_alignment(spark, str(tmp_path / "al.json")).first().key == "k"
    (tmp_path / "lc.json").write_text(json.dumps({"bolt": {"variants": ["bolts"], "freq": 2}}))
    cache = files.read_lemma_cache(spark, str(tmp_path / "lc.json"))
    assert sinks.fold_lemma_cache(cache, spark.createDataFrame([("bolt",), ("bolt",)], "canonical string")).first().freq == 4
    assert sinks.lemma_cache_rows(cache).first() == ("bolt", ["bolts"], 2)
    (tmp_path / "cf.json").write_text(json.dumps([{"filename": "f", "status": "added"}]))
    assert files.read_changed_files(spark, str(tmp_path / "cf.json")).first() == ("f", "added")
    got = files.fetched(spark.createDataFrame([("a",), ("b",)], "url string"), lambda u: {"a": "text"}[u]).collect()
    assert [r.text for r in got] == ["text", None]


def test_terms_and_buckets(spark):
    e = spark.createDataFrame([(f"k{i}", "Iron Sword of Iron", i) for i in range(7)] + [("z", "iron golem", 9)], "key string, value string, pos long")
    uni = {r.term: r for r in terms.extract_terms(e, "unigrams").collect()}
    assert uni["iron"].freq == 8 and uni["iron"].keys == ["k0", "k1", "k2", "k3", "k4"] and "of" not in uni and "golem" not in uni
    assert {r.term for r in terms.extract_terms(e, "trigrams").collect()} == {"iron sword of", "sword of iron", "iron sword of iron"}
    b = terms.bucket_terms(terms.extract_all(e))
    merged = terms.merge_buckets(b, spark.createDataFrame([("sword", "iron sword"), ("iron", "steel")], "norm string, target string"))
    got = {r.norm: r for r in merged.collect()}
    assert "sword" in got and "iron" not in got and got["steel"].freq == 5


def hist(spark, pairs):
    return spark.createDataFrame([("t", z, n, i) for i, (z, n) in enumerate(pairs)], "norm string, zh string, cnt long, first long")


@pytest.mark.parametrize(("pairs", "want"), [
    ([("方铅岩", 5)], None), ([("方铅岩砖", 2), ("方铅岩台阶", 1), ("方铅岩", 1), ("方前言", 1)], "方铅岩"), ([("苹果", 3), ("香蕉", 2), ("橙子", 1)], None),
    ([("铁", 1), ("铁锭", 3), ("铁块", 2)], None), ([("方铅岩砖", 1), ("方铅岩", 1), ("石头", 3)], None), ([("中文测试", 5), ("其他", 1)], None),
])
def test_common_substring(spark, pairs, want):
    rows = glossary.common_substring(hist(spark, pairs)).collect()
    assert [r.zh for r in rows] == ([want] if want else [])


def test_conflicts_are_resolved_or_rescued(spark):
    entries = spark.createDataFrame([(f"k{i}", "Red Apple", "红苹果", i) for i in range(5)] + [(f"k{i}", "Apple", "苹果", i) for i in range(5, 10)], "key string, en string, zh string, pos long")
    b = lambda keys: [f"k{i}" for i in keys]
    buckets = spark.createDataFrame([("red apple", ["red apple"], b(range(5))), ("apple", ["apple"], b(range(10))), ("plum", ["plum"], b(range(5)))], "norm string, variants array<string>, keys array<string>")
    g = spark.createDataFrame([("red apple", "red apple", "红苹果"), ("apple", "apple", "红苹果")], "norm string, en string, zh string")
    assert {r.en: r.zh for r in glossary.resolve_conflicts(g, buckets, entries).collect()} == {"red apple": "红苹果", "apple": "苹果"}
    same = entries.withColumn("zh", F.lit("红苹果"))
    assert {r.en for r in glossary.resolve_conflicts(g, buckets, same).collect()} == {"red apple"}


def test_consistency_matches_whole_words(spark):
    e = spark.createDataFrame([("a", "Iron Sword", "钢剑"), ("b", "Environs", "环境"), ("c", "iron-clad", "铁甲"), ("d", "IRON!", ""), ("x.music_disc.y.desc", "Iron", "钢")], "key string, en string, zh string")
    g = spark.createDataFrame([("Iron", ["Iron"], "铁"), ("C++", ["C++"], "铁")], "term string, variants array<string>, std_zh string")
    rows = glossary.check_consistency(e, g).collect()
    assert [(r.key, r.suggestion) for r in rows] == [("a", "铁")]


def test_clusters_and_components(spark):
    t = spark.createDataFrame([(1, "iron ingot"), (2, "iron ingots"), (3, "iron"), (4, "golden apple"), (5, "golden apples"), (6, "zzzz")], "id long, term string")
    got = {}
    for r in terms.clusters_of(t).collect():
        got.setdefault(r.cluster, set()).add(r.norm)
    assert got == {"iron ingot": {"iron ingot", "iron ingots"}, "golden apple": {"golden apple", "golden apples"}}
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {r.node: r.root for r in graph.connected(edges).collect()} == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_fuzzy_search(spark):
    mem = spark.createDataFrame([("k1", "Iron Sword", "铁剑"), ("k2", "Iron Swords", None), ("k3", "Gold", "金")], "key string, en string, zh string")
    q = spark.createDataFrame([("q", "iron sword"), ("e", " "), ("n", "zz")], "q_key string, query string")
    assert [(r.q_key, r.nth, r.key) for r in fuzzy.fuzzy_search(q, mem).orderBy("nth").collect()] == [("q", 1, "k1"), ("q", 2, "k2")]


def test_lexicon(spark):
    d = spark.createDataFrame([("Iron", "铁", f"m{i}") for i in range(7)] + [("iron", "钢", "m0"), ("Bolt", "栓", None)], "origin_name string, trans_name string, modid string")
    w = spark.createDataFrame([("iron",), ("bolts",), ("none",)], "word string")
    got = [tuple(r) for r in lexicon.lookup(w, d, spark.createDataFrame([("bolts", "bolt")], "variant string, canonical string")).orderBy("word", "nth").collect()]
    assert got == [("bolts", 1, "栓", 0, ""), ("iron", 1, "铁", 7, "m0, m1, m2, m3, m4 +2"), ("iron", 2, "钢", 1, "m0")]
    assert lexicon.totals(d).first() == (9, 2)


def test_routing(spark):
    e = spark.createDataFrame([("gui.a", "Iron Sword", "铁剑"), ("gui.b", "Iron Door", "铁门"), ("death.c", "x", "y"), ("gui.d", "x" * 81, "y"), ("gui.f", "flag", "旗")], "key string, en string, zh string")
    g = spark.createDataFrame([("iron", "铁"), ("sword", "剑"), ("iron sword", "铁剑")], "en string, zh string")
    got = {r.key: r.route for r in routing.route(e, spark.createDataFrame([("gui.f",)], "key string"), g).collect()}
    assert got == {"gui.a": "pass", "gui.b": "uncovered", "death.c": "required", "gui.d": "required", "gui.f": "flagged"}
    p = spark.createDataFrame([("book.page.0", "Page0", "页0"), ("book.page.10", "Page2", "页2"), ("book.page.1", "Page1", "页1"), ("tag[0]", "A", "甲"), ("tag[1]", "B", "乙"), ("item.desc.0", "x", "y")], "key string, en string, zh string")
    got = {r.key: (r.full_en, r.full_zh) for r in routing.multipart(p).collect()}
    assert got["book.page.10"] == ("Page0Page1Page2", "页0页1页2") and got["tag[0]"] == ("AB", "甲乙") and "item.desc.0" not in got


@pytest.mark.parametrize(("answer", "n"), [('[{"key": "a", "verdict": "PASS"}]', 1), ('{"verdicts": [{"key": "a"}]}', 1), ('Sure: [{"key": "a"}] done', 1), ('{"key": "a", "verdict": "x"}\nno\n{"key": "b", "verdict": "y"}', 2), ("nothing", 0), ("", 0)])
def test_answers(answer, n):
    assert len(review.parse_answer(answer)) == n


def test_calls_are_repeated_and_failures_become_rows(spark):
    tries, pauses = [], []

    def flaky(_):
        tries.append(1)
        return "[{" if len(tries) < 2 else "<html>" if len(tries) < 3 else '[{"key": "a", "verdict": {"zh": "好"}}]'

    assert review.retrying(flaky, 2, sleep=pauses.append)("p").startswith("[") and pauses == [5, 10]

    def bad(_):
        raise RuntimeError("down")

    from dataclasses import replace

    from keyloom.config import DEFAULTS

    rows = review.review(spark.createDataFrame([("p",)], "prompt string"), bad, settings=replace(DEFAULTS, review_retries=0)).collect()
    assert [(r.key, r.source) for r in rows] == [("__llm_error__", "llm_error")]
    assert review.as_text({"value": 3}) == "3" and review.as_text({"x": 1}) == '{"x": 1}' and review.as_text(None) == ""


def v(key, verdict, reason, source="format_check"):
    return (key, "en", "zh", verdict, "", reason, source)


def test_merging_and_reports(spark, tmp_path):
    s1 = spark.createDataFrame([v("k", "⚠️ SUGGEST", "b"), v("k", "❌ FAIL", "a"), v("j", "⚠️ SUGGEST", "x"), v("", "❌ FAIL", "none")], ", ".join(f"{c} string" for c in verdicts.COLUMNS)).withColumns({"pos": F.monotonically_increasing_id(), "seq": F.lit(0)})
    s2 = spark.createDataFrame([v("j", "⚠️ SUGGEST", "y", "llm_review"), v("j", "⚠️ SUGGEST", "x")], s1.drop("pos", "seq").schema)
    merged = verdicts.merge_verdicts(verdicts.union_verdicts(s1.coalesce(1), s2))
    got = {r.key: r for r in merged.collect()}
    assert (got["k"].verdict, got["k"].reason) == ("❌ FAIL", "b; a") and (got["j"].source, got["j"].reason) == ("llm_review", "x; y")
    assert verdicts.keep_all(verdicts.union_verdicts(s1, s2)).count() == 5
    e = spark.createDataFrame([("k", "e", "z", "ns"), ("j", "e", "z", ""), ("o", "e", "z", "ns")], "key string, en string, zh string, namespace string")
    assert verdicts.review_stats(e, merged).first() == (3, 1, 1, 1, 0)
    assert sorted(map(tuple, verdicts.namespace_report(merged, e).collect())) == [("__default__", 1, 1, 0, 1, 0), ("ns", 2, 1, 1, 0, 0)]
    path = str(tmp_path / "store")
    sinks.save_verdicts(merged, path, "merged")
    sinks.save_verdicts(s2, path, "llm")
    sinks.save_verdicts(merged, path, "merged")
    store = spark.read.parquet(path)
    assert verdicts.select_verdicts(store, phase="merged").count() == 2 and verdicts.select_verdicts(store, phase="llm", filtered=False).count() == 2
    done = verdicts.set_filtered(store, spark.createDataFrame([("k", "PASS", "")], "key string, verdict string, reason string"))
    assert verdicts.merged_stats(done).first().passed == 1 and verdicts.select_verdicts(done, filtered=True).count() == 1
    sinks.save_namespace_reports(verdicts.report_lines(verdicts.normalized(merged, e)), str(tmp_path / "md"))
    assert spark.read.text(str(tmp_path / "md")).count() == 2
    sinks.save_report(merged, str(tmp_path / "r")), sinks.save_table(e, str(tmp_path / "t")), sinks.save_changes(e, str(tmp_path / "c"))


def test_history(spark):
    rows = [("k", v, str(x)) for v, x in (("1.9", "a"), ("1.10", "a"), ("1.11", "b"), ("1.12", "a"))] + [("s", "1.9", None), ("s", "1.10", None)]
    df = spark.createDataFrame(rows, "key string, version string, en string")
    from keyloom.functions.text import version_parts

    got = [tuple(r) for r in history.intervals(df, ["key"], [version_parts(F.col("version"))], ["en"], "version").orderBy("key", "nth").collect()]
    assert got == [("k", "a", "1.9", "1.10", 1, 1), ("k", "b", "1.11", "1.11", 1, 2), ("k", "a", "1.12", "1.12", 1, 3), ("s", None, "1.9", "1.10", 0, 1)]


def test_whole_plan_and_filter(spark):
    def stub(prompt):
        import re

        return json.dumps([{"key": k, "verdict": "PASS" if k.endswith("1") else "FAIL", "reason": "r"} for k in re.findall("key: `([^`]*)`", prompt)])

    rows = [(f"item.{i}", "Iron Sword" if i % 2 else "Iron Door", "铁剑" if i % 2 else "铁门", "ns", i) for i in range(12)] + [("gui.x", "two words", "two words", "ns", 20), ("death.d1", "%s died", "死了", "", 21)]
    e = spark.createDataFrame(rows, "key string, en string, zh string, namespace string, pos long")
    off = run_review(e)
    got = {r.key: r for r in off.merged.collect()}
    assert got["gui.x"].verdict == "❌ FAIL" and "death.d1" in got and off.stats.first().total == 14
    on = run_review(e, stub)
    merged = on.merged
    assert {r.key for r in merged.collect()} >= {"gui.x", "death.d1"}
    cache = spark.createDataFrame([], "cache_key string, action string, reason string")
    out, cache = run_filter(off.merged, cache, stub)
    assert {r.key: r.verdict for r in out.collect()}["death.d1"] == "PASS"
    again, _ = run_filter(off.merged, cache.checkpoint(), lambda p: 1 / 0)
    assert {r.key: r.verdict for r in again.collect()} == {r.key: r.verdict for r in out.collect()}


def test_stream_of_changes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps({"key": "k", "old_en": "a", "new_en": "%d b", "old_zh": "x", "new_zh": "y"}) + "\n" + json.dumps({"key": "same", "old_en": "a", "new_en": "a"}))
    assert "old_en" in CHANGES
    start_review(changed_entries(spark, str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "cp")).awaitTermination(60)
    assert [r.key for r in spark.read.parquet(str(tmp_path / "store")).collect()] == ["k"]


def test_settings():
    s, w = load_settings('{"_comment": 1, "terminology": {"min_freq": 9, "nope": 1}, "stop_words": ["The"], "other": 2}')
    assert s.min_freq == 9 and s.stop_words == ("the",) and w == ["unknown setting: terminology.nope", "unknown setting: other"]


def test_contexts_of_words_of_any_length_by_brute_force(spark, tmp_path):
    import hashlib

    from keyloom import queries

    texts = ["an ox", "an ox ran", "an ox ran by", "the ox", "considerable an", "considerable", "an ox", "by a considerable ox"]
    spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = set()
    for term in {w for x in texts for w in x.split(" ")}:
        found = sorted({x for x in texts if term in x.split(" ")}, key=lambda x: (len(x), texts.index(x), x))
        if len(found) > 1:
            want |= {(term, 0, found[-1])} | {(term, i + 1, x) for i, x in enumerate(found[:4])}
    got = queries.QUERIES["context_pick"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {(r.term, r.nth, r.digest) for r in got} == {(w, n, hashlib.md5(x.encode()).hexdigest()) for w, n, x in want}
