"""Answers about terms, reviews of changes, report pages, readers and fetching."""

import json
import time
from types import SimpleNamespace

import pytest

from keyloom.config import DEFAULTS, load_settings
from keyloom.operators import align, fuzzy, lemma, review, routing, tables, terms, verdicts
from keyloom.plans.review_plan import header, mine, mine_keys, run_change_review
from keyloom.sources import files, sinks
from keyloom.streaming.incremental import changed_entries, start_review


@pytest.mark.parametrize(("answer", "want"), [
    ('[{"canonical": "gear", "members": ["gears", "geer"]}]', {"gears": "gear", "geer": "gear", "gear": "gear"}),
    ('Well: [{"canonical": "a b", "members": ["a b", "ab"]}, {"canonical": "", "members": ["x"]}, {"canonical": "c", "members": []}, 3] .', {"a b": "a b", "ab": "a b"}),
    ("[1, 2]", {}), ("{}", {}), ("no", {}), ("[broken", {}), ("", {}),
])
def test_merge_answers(answer, want):
    assert lemma.parse_merges(answer) == want


@pytest.mark.parametrize(("answer", "want"), [
    ('[{"en": " Iron ", "new_zh": "铁 "}, {"en": "x"}, {"new_zh": "y"}, 3]', {"iron": "铁"}), ('text\n```json\n[{"en": "a", "new_zh": "b"}]\n```', {"a": "b"}), ('{"en": "a"}', {}), ("no", {}), ("", {}),
])
def test_corrections(answer, want):
    assert lemma.parse_corrections(answer) == want


def test_a_cache_learns_merges(spark):
    cache = spark.createDataFrame([("gear", ["gears", "cog"], 5), ("wheel", ["wheels"], 0)], "canonical string, variants array<string>, freq long")
    merges = spark.createDataFrame([("cog", "wheel"), ("gears", "gear"), ("wheels", "wheel"), ("ab", "wheel"), ("disk", "stop the")], "norm string, target string")
    got = {r.canonical: (r.variants, r.freq) for r in lemma.record_merges(cache, merges).collect()}
    # cog moves; gear gains for gears and itself, wheel for cog, wheels and itself; terms that aren't valid do nothing
    assert got == {"gear": (["gear", "gears"], 5 - 2 + 2), "wheel": (["cog", "wheel", "wheels"], 0 + 3)}
    assert lemma.cache_stats(cache).first() == (2, 3)


def test_merging_by_cache_and_reviewer_in_the_plan(spark):
    rows = [(f"item.{i}", w, z, i) for i, (w, z) in enumerate([("copper gear", "铜齿轮")] * 6 + [("copper gears", "铜齿轮")] * 6 + [("brass cog", "黄铜齿")] * 6)]
    e = spark.createDataFrame(rows, "key string, en string, zh string, pos long")
    cache = spark.createDataFrame([("copper", ["brass"], 2)], "canonical string, variants array<string>, freq long")
    asked = []

    def call(prompt):
        if "候选组" in prompt:
            return json.dumps([{"canonical": "copper gear", "members": ["copper gear", "copper gears"]}])
        return '[{"en": "copper", "new_zh": "赤铜"}]'

    plain = {r.norm for r in mine(e).buckets.collect()}
    m = mine(e, cache, call)
    merged = {r.norm: r.variants for r in m.buckets.collect()}
    assert {"brass", "copper gears"} <= plain and not {"brass", "copper gears"} & set(merged)
    assert set(merged["copper gear"]) == {"copper gear", "copper gears"} and "brass" in merged["copper"]
    assert {r.canonical: r.variants for r in m.cache.collect()}["copper gear"] == ["copper gear", "copper gears"]
    assert not asked and all(r.zh == "赤铜" for r in m.glossary.where("en = 'copper'").collect())
    failing = mine(e, None, lambda p: 1 / 0, settings=DEFAULTS.__class__(review_retries=0))
    assert {r.norm for r in failing.buckets.collect()} == plain


def test_verification_shows_the_longest_and_four_shortest_texts(spark):
    texts = ["iron x", "Iron", "an iron thing", "iron iron iron iron", "the iron", "my iron ore", "irons"]
    e = spark.createDataFrame([(f"k{i}", x, "z", i) for i, x in enumerate(texts)], "key string, en string, zh string, pos long")
    g = spark.createDataFrame([("Iron", "铁"), ("alone", "孤")], "en string, zh string")
    (p,) = lemma.verify_prompts(g, e).collect()
    assert 'Term: "Iron" -> "铁"\n  [1] "iron iron iron iron"\n  [2] "Iron"\n  [3] "iron x"\n  [4] "the iron"\n  [5] "my iron ore"\n' in p.prompt and "alone" not in p.prompt


def maps(spark, d):
    return spark.createDataFrame(list(d.items()), "key string, value string")


def test_review_of_a_change(spark, tmp_path):
    old_en, new_en = {"a": "One door", "b": "Two doors", "g": "gone"}, {"a": "One 'new' door", "b": "Two doors", "c": "Three\ndoors"}
    old_zh, new_zh = {"a": "一扇门", "b": "两扇门", "g": "没了"}, {"a": "一扇门", "b": "两扇 门", "c": "三扇门"}
    changes = align.diff_revisions(*[maps(spark, x) for x in (old_en, new_en, old_zh, new_zh)]).selectExpr("*", "'ns' AS namespace", "1L AS pos")
    full = spark.createDataFrame([(k, v, new_zh.get(k), i) for i, (k, v) in enumerate(new_en.items())], "key string, en string, zh string, pos long")
    seen = []
    done, gone = run_change_review(changes, full, lambda p: "[]", change_context="mind the change")
    got = {r.key: r for r in done.merged.collect()}
    assert set(got) <= {"a", "b", "c"} and got["a"].source == "pr_warning" and got["a"].verdict == "⚠️ SUGGEST"
    assert got["a"].reason == f"原文变更但翻译未变更。旧EN: {old_en['a']!r} → 新EN: {new_en['a']!r}" and got["a"].en_current == new_en["a"]
    assert [tuple(r) for r in gone.collect()] == [("ns", 1)] and not seen
    sinks.save_change_review(changes, str(tmp_path / "pr"), {"repo": "r", "number": 7})
    stats = spark.read.json(str(tmp_path / "pr/stats")).first()
    assert (stats.total_changed_keys, stats.deleted_keys, stats.en_changed, stats.zh_unchanged_warnings, stats.repo, stats.number) == (3, 1, 2, 1, "r", 7)
    assert [r.key for r in spark.read.json(str(tmp_path / "pr/all_entries")).collect()] == ["a", "b", "c"]
    assert spark.read.json(str(tmp_path / "pr/warnings")).count() == 1
    page = [r.line for r in verdicts.summary_page(changes, done.merged, done.by_namespace, gone).orderBy("nth").collect()]
    assert page[0] == "# 翻译审校报告" and "- **ns**：删除 1 个 key" in page and page[-1].startswith("> 完整数据")
    sinks.save_summary(verdicts.summary_page(changes, done.merged, done.by_namespace), str(tmp_path / "summary"))
    assert not any("兼容性" in r.value for r in spark.read.text(str(tmp_path / "summary")).collect())


def test_pages_have_fail_first_and_files_keep_the_order(spark, tmp_path):
    v = [("k2", "⚠️ SUGGEST", "s"), ("k3", "❌ FAIL", "f"), ("k1", "🔶 REVIEW", "r"), ("k0", "PASS", "")]
    rows = spark.createDataFrame([(k, x, why, "ns") for k, x, why in v], "key string, verdict string, reason string, namespace string")
    report = spark.createDataFrame([("ns", 9, 3, 1, 1, 1), ("__default__", 1, 1, 1, 0, 0), ("fine", 1, 0, 0, 0, 0)], "namespace string, total long, issues long, fail long, suggest long, review long")
    pages = verdicts.namespace_pages(rows, report)
    lines = [r.line for r in pages.orderBy("nth").collect()]
    assert [x.split("`")[1] for x in lines if "`" in x] == ["k3", "k1", "k2"] and lines[0] == "# ns — 翻译审校报告" and lines[2] == "- 条目总数：9" and len(lines) == 15
    sinks.save_lines(pages, str(tmp_path / "pages"))
    files_ = sorted((tmp_path / "pages/namespace=ns").glob("part-*.txt"))
    assert "".join(f.read_text() for f in files_).splitlines() == lines


def test_fetching_falls_back_and_tries_again():
    asked = []

    def get(url, token):
        asked.append(token)
        if token:
            raise RuntimeError(f"error {url}")
        return "text"

    assert files.with_fallback(get, "t")("401: bad token") == "text" and asked == ["t", ""]
    assert files.with_fallback(get, "")("x") == "text"
    for url in ("403 rate limit exceeded", "500"):
        with pytest.raises(RuntimeError):
            files.with_fallback(get, "t")(url)
    left, pauses = [TimeoutError(), OSError()], []

    def slow(_):
        if left:
            raise left.pop()
        return "done"

    assert files.with_retries(slow, sleep=pauses.append)("u") == "done" and pauses == [2, 4]
    left[:] = [TimeoutError()] * 3
    with pytest.raises(TimeoutError):
        files.with_retries(slow, sleep=pauses.append)("u")

    def refused(_):
        pauses.append("asked")
        raise RuntimeError("404")

    with pytest.raises(RuntimeError):
        files.with_retries(refused, sleep=pauses.append)("u")
    assert pauses.count("asked") == 1


def test_pages_of_changed_files(spark):
    pages = {1: [{"filename": f"f{i}", "status": "added"} for i in range(3)], 2: [{"filename": "last"}]}
    got = files.list_changed_files(spark, pages.__getitem__, size=3).collect()
    assert [r.filename for r in got] == ["f0", "f1", "f2", "last"] and got[3].status is None


def test_tables_of_keys_are_filtered_in_the_scan(spark, tmp_path, capsys):
    rows = [("a", "block", "A", "甲", "1.9", "1.10", 0), ("b", "item", "B", "", "1.9", "1.9", 0), ("c", "item", "C", None, "1.9", "1.9", 1)]
    spark.createDataFrame(rows, files.KEY_INTERVALS).write.parquet(str(tmp_path / "keys"))
    got = files.read_keys(spark, str(tmp_path / "keys"), translated=True).select("key", "zh_cn")
    assert [tuple(r) for r in got.collect()] == [("a", "甲")]
    got.explain()
    plan = capsys.readouterr().out
    assert "IsNotNull(zh_cn)" in plan and "ReadSchema: struct<key:string,zh_cn:string>" in plan


def test_lemma_cache_files(spark, tmp_path):
    (tmp_path / "cache.json").write_text(json.dumps({"Gear": {"variants": ["Gears", "gear", "of"], "freq": 3}, "of": {"variants": ["x"], "freq": 9}, "Wheel": {"freq": 2}, "Cog": {"variants": ["gears", "cogs"]}}))
    got = {r.canonical: (r.variants, r.freq) for r in files.read_lemma_cache(spark, str(tmp_path / "cache.json")).collect()}
    assert got == {"Gear": (["gear", "gears"], 3), "Wheel": (["wheel"], 2), "Cog": (["cogs"], 0)}
    cache = spark.createDataFrame([("b", ["bbb", "ab"], 1), ("c", ["c"], 7), ("a", ["a"], 1)], "canonical string, variants array<string>, freq long")
    sinks.save_lemma_cache(cache, str(tmp_path / "out"))
    assert [(r.canonical, r.variants) for r in spark.read.json(str(tmp_path / "out")).collect()] == [("c", ["c"]), ("a", ["a"]), ("b", ["ab", "bbb"])]


def test_settings_within_groups_and_texts_of_lines():
    s, w = load_settings(json.dumps({"llm": {"default_review_focus": ["a", "b"], "filter": {"nope": 1}}, "key_prefixes": {"x.": {"label": "X", "focus": "look", "llm_required": True}}, "pipeline": {"max_workers": 2}}))
    assert s.default_review_focus == "a\nb" and s.max_workers == 2 and s.key_prefixes == {"x.": ("X", True)} and s.focus == {"x.": "look"} and w == ["unknown setting: llm.filter.nope"]


def test_prompts_say_what_to_look_at(spark):
    e = spark.createDataFrame([("item.a", "Press Shift", "按Shift"), ("book.b", "text", "鼠标")], "key string, en string, zh string")
    got = {r.prefix: r.prompt for r in routing.prompts(routing.entry_blocks(e), header("mind", "do"), entries=e).collect()}
    assert DEFAULTS.focus["item."] in got["item."] and DEFAULTS.keyboard_guidance in got["item."] and DEFAULTS.mouse_guidance not in got["item."]
    assert DEFAULTS.mouse_guidance in got["book."] and "mind" in got["book."] and "待审条目 (1条)\ndo" in got["book."]


def test_an_empty_glossary_sends_nothing_to_review(spark):
    e = spark.createDataFrame([("gui.a", "Door", "门"), ("gui.b", "x" * 90, "z")], "key string, en string, zh string")
    none, flagged = spark.createDataFrame([], "en string, zh string"), spark.createDataFrame([], "key string")
    assert {r.key: r.route for r in routing.route(e, flagged, none).collect()} == {"gui.a": "pass", "gui.b": "required"}
    one = spark.createDataFrame([("iron", "铁")], "en string, zh string")
    assert {r.key: r.route for r in routing.route(e, flagged, one).collect()} == {"gui.a": "uncovered", "gui.b": "required"}


def test_calls_of_a_task_run_together_but_not_too_many(spark):
    def call(prompt):
        began = time.time()
        time.sleep(0.2)
        return json.dumps([{"key": prompt, "verdict": str(began), "reason": str(time.time())}])

    prompts = spark.createDataFrame([(f"p{i}",) for i in range(8)], "prompt string").coalesce(1)
    spans = [(float(r.verdict), float(r.reason)) for r in review.review(prompts, call).collect()]
    assert max(sum(a <= x < b for a, b in spans) for x, _ in spans) == DEFAULTS.max_workers


def test_untranslated_entries_without_an_answer_stay_in_review(spark):
    queued = spark.createDataFrame([("a", "x", "x", "untranslated"), ("b", "y", "y", "untranslated"), ("c", "z", "z", "review")], "key string, en string, zh string, queue string")
    said = review.without_review(queued.where("key = 'a'"))
    assert sorted(r.key for r in review.with_unanswered(said, queued).collect()) == ["a", "b"]


def test_lines_without_a_translation_take_another_maps(spark):
    memory = spark.createDataFrame([("k1", "iron door", ""), ("k2", "iron doors", None), ("k3", "iron door x", "有")], "key string, en string, zh string")
    q = spark.createDataFrame([("q", "iron door")], "q_key string, query string")
    other = spark.createDataFrame([("k1", "铁门")], "key string, zh string")
    got = {r.key: r.zh for r in fuzzy.fuzzy_search(q, memory, index=fuzzy.index_tokens(memory), translations=other).collect()}
    assert got == {"k1": "铁门", "k2": fuzzy.NO_TRANSLATION, "k3": "有"}


def test_rare_words_count_more_in_recall(spark):
    memory = spark.createDataFrame([(f"k{i}", "common words here", "") for i in range(30)] + [("z", "rare words there", "")], "key string, en string, zh string")
    q = spark.createDataFrame([("q", "rare common words")], "q_key string, query string")
    best = fuzzy.recall(q, memory).orderBy("score", ascending=False).first()
    assert best.key == "z" and best.hits == 2


def test_conflicts_of_short_terms(spark):
    from keyloom.operators import glossary

    g = [("a", "甲"), ("Ab", "甲"), ("xab", "甲"), ("ab", "乙"), ("ba", "甲"), ("b", "甲")]
    want = {(s, x, z) for s, z in g for x, y in g if z == y and s != x and len(x) >= len(s) and s.lower() in x.lower()}
    got = {tuple(r) for r in glossary.conflicts(spark.createDataFrame(g, "en string, zh string")).collect()}
    assert got == want and len(want) > 4


def test_scratch_needs_a_shared_folder_on_a_cluster():
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077", applicationId="x", getCheckpointDir=lambda: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_folder(cluster)


def test_buckets_merge_under_a_name_that_has_none(spark):
    b = spark.createDataFrame([("gears", "gears", ["gears"], 2, ["a", "b"], "unigrams", 1), ("cogs", "cogs", ["cogs"], 1, ["b"], "unigrams", 2)], "norm string, normalized string, variants array<string>, freq long, keys array<string>, ngram_type string, ord int")
    redirect = spark.createDataFrame([("gears", "gear"), ("cogs", "gear")], "norm string, target string")
    assert [(r.norm, r.variants, r.freq) for r in terms.merge_buckets(b, redirect).collect()] == [("gear", ["cogs", "gears"], 2)]


def test_changed_files_go_to_the_aligner_of_their_kind(spark):
    df = spark.createDataFrame([("projects/assets/p/1.0/s/lang/en_us.json", "modified"), ("projects/assets/p/1.0/s/ae2guide/_zh_cn/a.md", "added"), ("projects/readme.md", "added"), ("x.toml", None)], "filename string, status string")
    more = align.Aligner("toml", r"\.toml$", lambda f: f.select("filename"))
    got = align.pair_changed(df, (*align.ALIGNERS, more))
    assert got["lang"].first().en_head == "projects/assets/p/1.0/s/lang/en_us.json" and got["guide"].first().key == "ae2guide:a.md"
    assert [r.filename for r in got["toml"].collect()] == ["x.toml"] and got["lang"].count() == got["guide"].count() == 1


def test_usage_is_counted_in_the_tasks(spark):
    usage = review.Usage(spark)

    def call(prompt):
        if prompt == "bad":
            raise RuntimeError("no")
        return "[]"

    prompts = spark.createDataFrame([("one",), ("three",), ("bad",)], "prompt string")
    review.review(prompts, usage.counting(call), settings=DEFAULTS.__class__(review_retries=0)).collect()
    assert (usage.calls.value, usage.failures.value, usage.asked.value, usage.answered.value) == (3, 1, 11, 4)


def test_a_glossary_from_a_table_of_keys(spark):
    rows = [(f"block.{i}", "block", "Iron Door", "铁门", "1.9", "1.10", 0) for i in range(8)] + [(f"item.{i}", "item", "Iron Door", None, "1.9", "1.9", 0) for i in range(9)]
    got = {r.en.lower(): r.zh for r in mine_keys(spark.createDataFrame(rows, files.KEY_INTERVALS)).collect()}
    assert got["iron door"] == "铁门"


def test_a_stream_of_changes_is_warned_of_and_reviewed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"key": "gui.a", "old_en": "One door", "new_en": "Two doors", "old_zh": "门", "new_zh": "门"}, {"key": "gui.b", "old_en": "", "new_en": "Red", "old_zh": "", "new_zh": "红"}, {"key": "gone", "old_en": "x", "old_zh": "y"}]
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, rows)))

    def call(prompt):
        return '[{"key": "gui.b", "verdict": "PASS", "reason": "seen"}]' if "gui.b" in prompt else "[]"

    start_review(changed_entries(spark, str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "cp"), call=call).awaitTermination(60)
    got = {r.key: (r.verdict, r.source) for r in spark.read.parquet(str(tmp_path / "store")).collect()}
    assert got == {"gui.a": ("⚠️ SUGGEST", "pr_warning"), "gui.b": ("PASS", "llm_review")}
