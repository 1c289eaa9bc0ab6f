"""Aligning source and target maps, and changes between two revisions of both."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SUGGEST
from ..functions.text import code_like


def align(source: DataFrame, target: DataFrame) -> DataFrame:
    """One full outer join of two maps (key, value): key, en, zh, status (matched, missing_zh or extra_zh).

    Null values count as empty. A key that repeats in a map is joined as often; maps are made unique by the readers.
    """
    s = source.select("key", F.coalesce("value", F.lit("")).alias("en"), F.lit(True).alias("in_en"))
    t = target.select("key", F.coalesce("value", F.lit("")).alias("zh"), F.lit(True).alias("in_zh"))
    status = F.when(F.col("in_en").isNotNull() & F.col("in_zh").isNotNull(), "matched").when(F.col("in_en").isNotNull(), "missing_zh").otherwise("extra_zh")
    return s.join(t, "key", "full_outer").select("key", "en", "zh", status.alias("status"))


def matched(aligned: DataFrame) -> DataFrame:
    return aligned.where("status = 'matched'").select("key", "en", "zh")


def missing(aligned: DataFrame) -> DataFrame:
    return aligned.where("status = 'missing_zh'").select("key", "en")


def extra(aligned: DataFrame) -> DataFrame:
    return aligned.where("status = 'extra_zh'").select("key", "zh")


def is_suspicious() -> Column:
    return (F.col("status") == "matched") & (F.col("en") == F.col("zh")) & ~code_like(F.col("en"))


def suspicious(aligned: DataFrame) -> DataFrame:
    """Matched entries with equal texts that aren't code or proper nouns."""
    return aligned.where(is_suspicious()).select("key", "en", "zh", F.lit("值相同，疑似未翻译").alias("reason"))


def align_stats(aligned: DataFrame) -> DataFrame:
    count = lambda c, name: F.count_if(c).alias(name)
    s = F.col("status")
    return aligned.agg(count(s == "matched", "matched"), count(s == "missing_zh", "missing_zh"), count(s == "extra_zh", "extra_zh"), count(is_suspicious(), "suspicious_untranslated"), count(s != "extra_zh", "total_en"), count(s != "missing_zh", "total_zh"))


def collisions(source: DataFrame, vanilla: DataFrame) -> DataFrame:
    """Keys of the source map that a table of known keys has too; of its rows for a key, the last version counts.

    vanilla: key, zh_cn, version_start, version_end, changes, pos (row order, at ties).
    """
    w = Window.partitionBy("key").orderBy(F.desc("pos"))
    last = vanilla.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth", "pos")
    return source.join(last, "key").select("key", F.substring("value", 1, 120).alias("mod_value"), F.col("zh_cn").alias("vanilla_zh"), "version_start", "version_end", "changes")


def diff_revisions(old_en: DataFrame, new_en: DataFrame, old_zh: DataFrame, new_zh: DataFrame) -> DataFrame:
    """Changed keys of four maps (key, value): key, en, zh, old_en, old_zh (null: unchanged), review_type, warning.

    The maps are stacked and pivoted by one aggregation, so there is one shuffle, pre-aggregated by each task.
    """
    sides = {"old_en": old_en, "new_en": new_en, "old_zh": old_zh, "new_zh": new_zh}
    stacked = None
    for name, df in sides.items():
        part = df.select("key", F.lit(name).alias("side"), "value")
        stacked = part if stacked is None else stacked.unionByName(part)
    wide = stacked.groupBy("key").agg(*[F.coalesce(F.max(F.when(F.col("side") == name, F.col("value"))), F.lit("")).alias(name) for name in sides])
    return classify_changes(wide)


def classify_changes(wide: DataFrame) -> DataFrame:
    """The same for rows that have old_en, new_en, old_zh, new_zh already."""
    en_changed, zh_changed = F.col("old_en") != F.col("new_en"), F.col("old_zh") != F.col("new_zh")
    kind = F.when(en_changed & zh_changed, "normal").when(en_changed, "en_changed_zh_unchanged").otherwise("zh_only_change")
    warning = F.when(en_changed & ~zh_changed & (F.col("old_en") != ""), "原文变更（EN）但翻译（ZH）未跟随变更")
    return wide.where(en_changed | zh_changed).select("key", F.col("new_en").alias("en"), F.col("new_zh").alias("zh"), F.when(en_changed, F.col("old_en")).alias("old_en"), F.when(zh_changed, F.col("old_zh")).alias("old_zh"), kind.alias("review_type"), warning.alias("warning"))


def is_deletion() -> Column:
    """Both texts are gone and at least one was there."""
    return (F.col("en") == "") & (F.col("zh") == "") & ((F.coalesce("old_en", F.lit("")) != "") | (F.coalesce("old_zh", F.lit("")) != ""))


def change_stats(changes: DataFrame) -> DataFrame:
    """By namespace: entries, each review type, warnings, pure deletions (which are no entries)."""
    gone, kind = is_deletion(), F.col("review_type")
    return changes.groupBy("namespace").agg(
        F.count_if(~gone).alias("entries"), *[F.count_if(~gone & (kind == k)).alias(k) for k in ("normal", "en_changed_zh_unchanged", "zh_only_change")],
        F.count_if(F.col("warning").isNotNull()).alias("warnings"), F.count_if(gone).alias("deletions"),
    )


def _quoted(text: Column) -> Column:
    """The text in quotation marks, line ends and backslashes escaped; double marks only where it has single ones alone."""
    plain = text
    for a, b in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        plain = F.replace(plain, F.lit(a), F.lit(b))
    double = text.contains("'") & ~text.contains('"')
    return F.when(double, F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'")))


def change_warnings(changes: DataFrame) -> DataFrame:
    """A SUGGEST verdict for each changed entry with a warning; its texts are filled in from the entries later."""
    cut = lambda c: _quoted(F.substring(F.coalesce(c, F.lit("")), 1, 60))
    reason = F.concat(F.lit("原文变更但翻译未变更。旧EN: "), cut(F.col("old_en")), F.lit(" → 新EN: "), cut(F.col("en")))
    blank = F.lit("")
    return changes.where("warning is not null").select("key", blank.alias("en_current"), blank.alias("zh_current"), F.lit(SUGGEST).alias("verdict"), blank.alias("suggestion"), reason.alias("reason"), F.lit("pr_warning").alias("source"))


def warned_entries(changes: DataFrame) -> DataFrame:
    """Entries of namespaces with a warning."""
    return changes.join(changes.where("warning is not null").select("namespace").distinct(), "namespace", "left_semi")


# The two forms of paths of language files, and the path of a guide page.
LANGUAGE_PATH = r"^projects/(?:assets/([^/]+)/([^/]+)|([^/]+)/assets/([^/]+))/([^/]+)/lang/(en_us|zh_cn)\.json$"
GUIDE_PATH = r"^projects/(?:assets/([^/]+)/([^/]+)|([^/]+)/assets/([^/]+))/([^/]+)/ae2guide/(?:(_zh_cn)/)?(.+\.md)$"


def parse_paths(files: DataFrame, pattern: str = LANGUAGE_PATH) -> DataFrame:
    """Files whose ``filename`` has the form: with project, version, slug, and lang (or rel_path and whether it is the translation)."""
    g = lambda i: F.regexp_extract("filename", pattern, i)
    either = lambda a, b: F.when(g(a) != "", g(a)).otherwise(g(b))
    rows = files.where(F.col("filename").rlike(pattern)).withColumns({"project": either(1, 4), "version": either(2, 3), "slug": g(5)})
    return rows.withColumn("lang", g(6)) if pattern == LANGUAGE_PATH else rows.withColumns({"lang": F.when(g(6) != "", "zh_cn").otherwise("en_us"), "rel_path": g(7)})


def pair_slots(files: DataFrame) -> DataFrame:
    """Changed files (filename, status) by module: where to read the source and target texts before and after.

    A removed file has no after, an added, renamed or copied one no before. Without a changed target file,
    the target beside the source is read for both.
    """
    rows = parse_paths(files).withColumn("module", F.concat_ws("/", "version", "project", "slug"))
    status = F.coalesce("status", F.lit("modified"))
    fresh = status.contains("renamed") | status.contains("added") | status.contains("copied")
    has_base, has_head = (status == "removed") | ~fresh, status != "removed"
    slot = lambda lang, has, name: F.max(F.when((F.col("lang") == lang) & has, F.col("filename"))).alias(name)
    wide = rows.groupBy("module", "version", "project", "slug").agg(slot("en_us", has_base, "en_base"), slot("en_us", has_head, "en_head"), slot("zh_cn", has_base, "zh_base"), slot("zh_cn", has_head, "zh_head"))
    beside = F.replace(F.col("en_head"), F.lit("/en_us.json"), F.lit("/zh_cn.json"))
    lone = F.col("zh_head").isNull() & F.col("en_head").isNotNull()
    return wide.withColumns({"zh_base": F.when(lone, beside).otherwise(F.col("zh_base")), "zh_head": F.when(lone, beside).otherwise(F.col("zh_head"))})


def pair_guides(files: DataFrame) -> DataFrame:
    """The same for guide pages, paired by module and relative path; the key of a page is its path behind the guide prefix."""
    rows = parse_paths(files, GUIDE_PATH)
    status = F.coalesce("status", F.lit("modified"))
    slot = lambda lang, has, name: F.max(F.when((F.col("lang") == lang) & has, F.col("filename"))).alias(name)
    old, new = ~status.isin("added", "renamed", "copied"), status != "removed"
    return rows.groupBy("version", "project", "slug", "rel_path").agg(slot("en_us", old, "en_base"), slot("en_us", new, "en_head"), slot("zh_cn", old, "zh_base"), slot("zh_cn", new, "zh_head")).withColumn("key", F.concat(F.lit("ae2guide:"), "rel_path"))


@dataclass(frozen=True)
class Aligner:
    """A kind of changed files: which paths are its own, and how these are paired (files: filename, status)."""

    name: str
    pattern: str
    pair: Callable[[DataFrame], DataFrame]


ALIGNERS = (Aligner("lang", LANGUAGE_PATH, pair_slots), Aligner("guide", GUIDE_PATH, pair_guides))


def pair_changed(files: DataFrame, aligners: tuple[Aligner, ...] = ALIGNERS) -> dict[str, DataFrame]:
    """The pairs of each aligner, which sees the files with paths of its own; further kinds are further aligners."""
    return {x.name: x.pair(files.where(F.col("filename").rlike(x.pattern))) for x in aligners}
