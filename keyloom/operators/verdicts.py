"""Verdicts of many sources: merging, statistics, reports, the filter cache and the verdict store."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, FAIL, PASS, REVIEW, SOURCE_PRIORITY, SUGGEST, VERDICT_PRIORITY
from ..functions.text import cache_key

COLUMNS = ["key", "en_current", "zh_current", "verdict", "suggestion", "reason", "source"]
BARE = {"FAIL": FAIL, "REVIEW": REVIEW, "SUGGEST": SUGGEST, "PASS": PASS}


def priority(name: str, table: dict[str, int]) -> Column:
    out = F.lit(0)
    for k, p in table.items():
        out = F.when(F.col(name) == k, p).otherwise(out)
    return out


def union_verdicts(*streams: DataFrame) -> DataFrame:
    """All streams, with ord: the stream's place, then pos and seq where it has them (the order of arrival)."""
    out = []
    for i, df in enumerate(streams):
        place = [F.col(c).cast("long") if c in df.columns else F.lit(0).cast("long") for c in ("pos", "seq")]
        out.append(df.select(*COLUMNS, F.struct(F.lit(i).alias("stream"), place[0].alias("pos"), place[1].alias("seq"), F.xxhash64("key", "reason").alias("h")).alias("ord")))
    return reduce(DataFrame.unionByName, out)


def merge_verdicts(verdicts: DataFrame) -> DataFrame:
    """One row a key: the verdict of highest priority, then of the highest source, then the first; all distinct reasons in order of arrival.

    verdicts: COLUMNS and ord. Rows without a key are left out. The rows are read once: first they are aggregated by key and reason, in
    each task before the shuffle, so that what is gathered of a key is its distinct reasons.
    """
    rows = verdicts.where("key is not null and key <> ''")
    rank = F.struct((-priority("verdict", VERDICT_PRIORITY)).alias("verdict"), (-priority("source", SOURCE_PRIORITY)).alias("source"), "ord")
    one = F.struct(*[c for c in COLUMNS if c != "key"])
    by_reason = rows.groupBy("key", "reason").agg(F.min("ord").alias("ord"), F.min(F.struct(rank.alias("rank"), one.alias("row"))).alias("best"))
    said = F.array_sort(F.collect_list(F.when(F.col("reason") != "", F.struct("ord", "reason"))))
    per = by_reason.groupBy("key").agg(F.min("best").alias("best"), said.alias("said"))
    row = F.col("best.row")
    reasons = F.when(F.size("said") > 0, F.array_join(F.transform("said", lambda x: x["reason"]), "; ")).otherwise(row["reason"])
    return per.select("key", *[row[c].alias(c) for c in ("en_current", "zh_current", "verdict", "suggestion")], reasons.alias("reason"), row["source"].alias("source"))


def keep_all(verdicts: DataFrame) -> DataFrame:
    """The first row of each key and reason."""
    w = Window.partitionBy("key", "reason").orderBy("ord")
    return verdicts.withColumn("nth", F.row_number().over(w)).where("nth = 1").select(*COLUMNS)


def by_priority(verdicts: DataFrame) -> DataFrame:
    """Most severe first, then by key."""
    return verdicts.orderBy(F.desc(priority("verdict", VERDICT_PRIORITY)), "key")


def normalized(verdicts: DataFrame, entries: DataFrame) -> DataFrame:
    """Rows with proper keys and verdict names, and texts and namespace from the entries where they are missing."""
    rows = verdicts.where("key is not null and key <> '' and not startswith(key, '#')")
    name = F.col("verdict")
    for bare, full in BARE.items():
        name = F.when(F.col("verdict") == bare, full).otherwise(name)
    filled = lambda c, other: F.coalesce(F.nullif(c, F.lit("")), other, F.lit(""))
    e = entries.select("key", F.col("en").alias("e_en"), F.col("zh").alias("e_zh"), F.col("namespace").alias("e_ns"))
    out = rows.withColumn("verdict", name).join(e, "key", "left")
    ns = F.coalesce(F.nullif("e_ns", F.lit("")), F.lit(DEFAULT))
    return out.select("key", filled(F.col("en_current"), F.col("e_en")).alias("en_current"), filled(F.col("zh_current"), F.col("e_zh")).alias("zh_current"), "verdict", "suggestion", "reason", "source", ns.alias("namespace"))


def review_stats(entries: DataFrame, merged: DataFrame) -> DataFrame:
    """total, fail, suggest, review, pass (the rest, which is negative if verdicts outnumber entries)."""
    n = entries.agg(F.count("*").alias("total"))
    v = merged.agg(*[F.count_if(F.col("verdict") == x).alias(a) for x, a in ((FAIL, "fail"), (SUGGEST, "suggest"), (REVIEW, "review"))])
    # one row each
    return n.join(v, F.lit(True)).select("total", (F.col("total") - F.col("fail") - F.col("suggest") - F.col("review")).alias("passed"), "fail", "suggest", "review")


def merged_stats(store: DataFrame, namespace: str | None = None) -> DataFrame:
    """Distinct keys of the merged phase, all and by verdict."""
    rows = select_verdicts(store, phase="merged", namespace=namespace)
    count = lambda x, a: F.count_distinct(F.when(F.col("verdict") == x, F.col("key"))).alias(a)
    return rows.agg(F.count_distinct("key").alias("total"), count(FAIL, "fail"), count(SUGGEST, "suggest"), count(REVIEW, "review"), count(PASS, "passed"))


def namespace_report(verdicts: DataFrame, entries: DataFrame) -> DataFrame:
    """By namespace of the entries that have verdicts: total (entries, or verdicts if more), issues, fail, suggest, review."""
    ns = F.coalesce(F.nullif("namespace", F.lit("")), F.lit(DEFAULT)).alias("namespace")
    e = entries.select("key", ns)
    v = verdicts.select("key", "verdict").join(e, "key", "left").withColumn("namespace", F.coalesce("namespace", F.lit(DEFAULT)))
    per = v.groupBy("namespace").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") != PASS).alias("issues"), *[F.count_if(F.col("verdict") == x).alias(a) for x, a in ((FAIL, "fail"), (SUGGEST, "suggest"), (REVIEW, "review"))])
    total = e.groupBy("namespace").agg(F.count("*").alias("entries"))
    return per.join(total, "namespace", "left").select("namespace", F.greatest(F.coalesce("entries", F.lit(0)), F.col("n")).alias("total"), "issues", "fail", "suggest", "review")


def source_distribution(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("source").agg(F.count("*").alias("n"))


def namespace_pages(verdicts: DataFrame, report: DataFrame) -> DataFrame:
    """namespace, nth, line of a page for each namespace but the default one: counts, then a table of issues, FAIL first and then by key.

    verdicts: with namespace. report: what namespace_report gives.
    """
    issues = verdicts.where((F.col("verdict") != PASS) & (F.col("namespace") != DEFAULT))
    order = Window.partitionBy("namespace").orderBy(F.when(F.col("verdict") == FAIL, 0).otherwise(1), "key", "reason")
    row = F.concat(F.lit("| "), "verdict", F.lit(" | `"), "key", F.lit("` | "), "reason", F.lit(" |"))
    table = issues.select("namespace", (F.row_number().over(order) + 12).cast("int").alias("nth"), row.alias("line"))
    count = lambda label, c, unit="": F.concat(F.lit(f"- {label}："), F.col(c).cast("string"), F.lit(unit))
    head = [
        F.concat(F.lit("# "), "namespace", F.lit(" — 翻译审校报告")), F.lit(""), count("条目总数", "total"), count("问题", "issues", " 处"), count(FAIL, "fail"), count(SUGGEST, "suggest"), count(REVIEW, "review"),
        F.lit(""), F.lit("## 问题清单"), F.lit(""), F.lit("| 判定 | 键名 | 问题 |"), F.lit("|------|------|------|"),
    ]
    heads = report.where((F.col("issues") > 0) & (F.col("namespace") != DEFAULT)).select("namespace", F.posexplode(F.array(*head)).alias("nth", "line"))
    return heads.select("namespace", (F.col("nth") + 1).alias("nth"), "line").unionByName(table)


def summary_page(entries: DataFrame, verdicts: DataFrame, report: DataFrame, deletions: DataFrame | None = None) -> DataFrame:
    """nth, line of the summary page: counts, a row for each namespace, deleted keys (namespace, deletions), links to the namespaces' pages.

    The page has a row for each namespace, so one task puts the rows in order.
    """
    n = entries.agg(F.count("*").alias("total"))
    v = verdicts.agg(F.count("*").alias("all"), *[F.count_if(F.col("verdict") == x).alias(a) for x, a in ((FAIL, "fail"), (SUGGEST, "suggest"), (REVIEW, "review"))])
    said = lambda *parts: F.concat(*[F.lit(p) if i % 2 == 0 else F.col(p).cast("string") for i, p in enumerate(parts)])
    head = F.array(
        F.lit("# 翻译审校报告"), F.lit(""), said("共审校 **", "total", "** 条翻译，发现 **", "all", "** 处问题："), said(f"- {FAIL}：", "fail", " 处（必须修复）"), said(f"- {SUGGEST}：", "suggest", " 处（建议改进）"), said(f"- {REVIEW}：", "review", " 处（需人工判断）"),
        F.lit(""), F.lit("## 按模组统计"), F.lit(""), F.lit("| 模组 | 总计 | 问题 | ❌ FAIL | ⚠️ SUGGEST | 🔶 REVIEW |"), F.lit("|------|------|------|---------|-----------|----------|"),
    )
    # one row each
    top = n.join(v, F.lit(True)).select(F.lit(0).alias("part"), F.posexplode(head).alias("at", "line")).select("part", F.lit("").alias("name"), "at", "line")
    row = said("| ", "namespace", " | ", "total", " | ", "issues", " | ", "fail", " | ", "suggest", " | ", "review", " |")
    parts = [top, report.select(F.lit(1).alias("part"), F.col("namespace").alias("name"), F.lit(0).alias("at"), row.alias("line"))]
    spark = entries.sparkSession
    fixed = [(3, "", 0, ""), (3, "", 1, "## 各模组详细报告"), (3, "", 2, ""), (5, "", 0, ""), (5, "", 1, ""), (5, "", 2, "> 完整数据见 report.json，可筛选查询所有 verdict 详情。")]
    if deletions is not None and not (gone := deletions.where("deletions > 0")).isEmpty():
        fixed += [(2, "", 0, ""), (2, "", 1, "## ⚠️ 兼容性警告"), (2, "", 2, ""), (2, "", 3, "以下模组本次 PR 删除了旧 key，使用旧版模组翻译的玩家可能遇到 key 缺失："), (2, "", 4, "")]
        parts.append(gone.select(F.lit(2).alias("part"), F.col("namespace").alias("name"), F.lit(5).alias("at"), said("- **", "namespace", "**：删除 ", "deletions", " 个 key").alias("line")))
    parts.append(spark.createDataFrame(fixed, "part int, name string, at int, line string"))
    link = said("- [", "namespace", "](", "namespace", "_report.md)")
    parts.append(report.where(F.col("namespace") != DEFAULT).select(F.lit(4).alias("part"), F.col("namespace").alias("name"), F.lit(0).alias("at"), link.alias("line")))
    rows = reduce(DataFrame.unionByName, parts)
    # the fixed lines of a part come before its namespaces, whatever these are called
    return rows.select(F.row_number().over(Window.orderBy("part", F.when(F.col("part") == 2, F.col("at")).otherwise(0), "name", "at")).alias("nth"), "line")


def report_lines(verdicts: DataFrame) -> DataFrame:
    """namespace, line: each issue as a line of a Markdown report, for a sink partitioned by namespace."""
    line = F.format_string("- %s `%s`: %s → %s — %s", "verdict", "key", F.substring("en_current", 1, 120), F.substring("zh_current", 1, 120), "reason")
    return verdicts.where(F.col("verdict") != PASS).select("namespace", line.alias("line"))


def select_verdicts(store: DataFrame, phase: str | None = None, namespace: str | None = None, filtered: bool | None = None) -> DataFrame:
    """Rows of a verdict store; a condition that is None isn't made."""
    for name, value in (("phase", phase), ("namespace", namespace), ("filtered", filtered)):
        if value is not None:
            store = store.where(F.col(name) == value)
    return store


def with_cache_keys(verdicts: DataFrame) -> DataFrame:
    return verdicts.withColumn("cache_key", cache_key(F.col("key"), F.col("verdict"), F.col("zh_current"), F.col("reason")))


def split_by_cache(verdicts: DataFrame, cache: DataFrame) -> DataFrame:
    """The verdicts with cache_key, hit, action and cleaned reason. cache: cache_key (unique), action, reason."""
    c = cache.select("cache_key", "action", F.col("reason").alias("cleaned"))
    return with_cache_keys(verdicts).join(c, "cache_key", "left").withColumn("hit", F.col("action").isNotNull())


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The new rows and those old ones whose key isn't among them."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def cache_size(cache: DataFrame) -> DataFrame:
    """One row: how many decisions a filter cache holds, and how many of them dismiss a verdict."""
    return cache.agg(F.count("*").alias("decisions"), F.count_if(F.col("action") == PASS).alias("dismissed"))


def set_filtered(store: DataFrame, decisions: DataFrame) -> DataFrame:
    """The store with merged rows of decided keys filtered: their verdict, and their reason if one is given. decisions: key, verdict, reason."""
    d = decisions.select("key", F.col("verdict").alias("d_verdict"), F.col("reason").alias("d_reason"))
    hit = (F.col("phase") == "merged") & F.col("d_verdict").isNotNull()
    rows = store.join(d, "key", "left")
    reason = F.when(hit & (F.coalesce("d_reason", F.lit("")) != ""), F.col("d_reason")).otherwise(F.col("reason"))
    return rows.withColumns({"verdict": F.when(hit, F.col("d_verdict")).otherwise(F.col("verdict")), "reason": reason, "filtered": F.col("filtered") | hit}).select(store.columns)


def apply_filter(verdicts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions (key, action PASS or KEEP, reason) turned into what set_filtered takes."""
    d = decisions.select("key", "action", F.col("reason").alias("cleaned"))
    passed = F.col("action") == PASS
    return verdicts.join(d, "key", "left").select("key", F.when(passed, PASS).otherwise(F.col("verdict")).alias("verdict"), F.when(passed, "").otherwise(F.coalesce(F.nullif("cleaned", F.lit("")), "reason")).alias("reason"))
