"""Where results go: verdict stores, reports, caches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_guide
from ..operators.align import is_deletion
from ..operators.verdicts import by_priority


def save_table(df: DataFrame, path: str) -> None:
    """Replaces a table (alignment, glossary, fuzzy results, intervals)."""
    df.write.mode("overwrite").parquet(path)


def save_verdicts(df: DataFrame, path: str, phase: str) -> None:
    """Replaces one phase of a verdict store and leaves the others; all columns become text, filtered a flag."""
    rows = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns if c not in ("phase", "filtered")])
    filtered = F.coalesce(F.col("filtered").cast("boolean"), F.lit(False)) if "filtered" in df.columns else F.lit(False)
    rows = rows.withColumns({"filtered": filtered, "phase": F.lit(phase)}) if "filtered" not in df.columns else df.select(*rows.columns, filtered.alias("filtered")).withColumn("phase", F.lit(phase))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("phase").parquet(path)


def save_lines(lines: DataFrame, path: str) -> None:
    """Lines (namespace, nth, line) in order, a folder for each namespace.

    A namespace of many lines has several files, of which a later name has later lines; so none is written by one task alone.
    """
    rows = lines.repartitionByRange("namespace", "nth").sortWithinPartitions("namespace", "nth")
    rows.select("namespace", F.col("line").alias("value")).write.mode("overwrite").partitionBy("namespace").text(path)


def save_namespace_reports(lines: DataFrame, path: str) -> None:
    """Markdown lines in no order (namespace, line), a folder for each namespace; a large one may have several files."""
    lines.select("namespace", F.col("line").alias("value")).write.mode("overwrite").partitionBy("namespace").text(path)


def save_summary(lines: DataFrame, path: str) -> None:
    """The lines (nth, line) of the summary page, which are few, as one file."""
    lines.coalesce(1).sortWithinPartitions("nth").select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def save_terms(terms: DataFrame, path: str) -> None:
    """Terms as JSON lines by frequency, then by name; of several files a later name has later terms."""
    by = [F.desc("freq"), "term"]
    terms.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite").json(path)


def save_changes(changes: DataFrame, path: str) -> None:
    """Changed entries as JSON lines in the order of their keys, a folder for each namespace."""
    changes.repartitionByRange("namespace", "key").sortWithinPartitions("namespace", "key").write.mode("overwrite").partitionBy("namespace").json(path)


def save_change_review(changes: DataFrame, path: str, about: dict[str, str] | None = None) -> None:
    """What a change is: entries by namespace, all entries and warnings as JSON lines, and one row with the counts and what is said about it."""
    entries = changes.where(~is_deletion())
    save_changes(entries, f"{path}/namespaces")
    save_changes(entries.where("warning is not null"), f"{path}/warnings")
    entries.repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").json(f"{path}/all_entries")
    save_json(change_summary(changes).withColumns({k: F.lit(v) for k, v in (about or {}).items()}), f"{path}/stats")


def change_summary(changes: DataFrame) -> DataFrame:
    """One row: entries, pure deletions, entries with a changed source and a changed target, warnings, guide pages, namespaces."""
    gone = is_deletion()
    return changes.agg(
        F.count_if(~gone).alias("total_changed_keys"), F.count_if(gone).alias("deleted_keys"), F.count_if(~gone & F.col("old_en").isNotNull()).alias("en_changed"), F.count_if(~gone & F.col("old_zh").isNotNull()).alias("zh_changed"),
        F.count_if(F.col("warning").isNotNull()).alias("zh_unchanged_warnings"), F.count_if(~gone & is_guide(F.col("key"))).alias("guide_entries"), F.count_distinct(F.when(~gone, F.col("namespace"))).alias("namespaces"),
    )


def save_json(rows: DataFrame, path: str) -> None:
    """A few rows (statistics, a glossary) as one file of JSON lines."""
    rows.coalesce(1).write.mode("overwrite").json(path)


def save_report(verdicts: DataFrame, path: str) -> None:
    """The issues as JSON lines, most severe first, then by key."""
    rows = by_priority(verdicts.where("verdict <> 'PASS'"))
    rows.write.mode("overwrite").json(path)


def save_glossary(glossary: DataFrame, path: str) -> None:
    """The glossary (en, zh) by term."""
    save_json(glossary.select("en", "zh").coalesce(1).sortWithinPartitions("en"), path)


def lemma_cache_rows(cache: DataFrame) -> DataFrame:
    """canonical, variants, freq with variants by length and text: the form in which a lemma cache is saved."""
    order = lambda a, b: F.when(F.length(a) != F.length(b), F.length(a) - F.length(b)).when(a < b, -1).when(a > b, 1).otherwise(0)
    return cache.groupBy("canonical").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("variants"))), order).alias("variants"), F.sum("freq").alias("freq"))


def save_lemma_cache(cache: DataFrame, path: str) -> None:
    """The cache as JSON lines, the most frequent first, then by name."""
    lemma_cache_rows(cache).orderBy(F.desc("freq"), "canonical").write.mode("overwrite").json(path)


def fold_lemma_cache(cache: DataFrame, lookups: DataFrame) -> DataFrame:
    """The cache with each canonical term's frequency raised by the lookups (canonical) of it and its variants."""
    n = lookups.groupBy("canonical").agg(F.count("*").alias("n"))
    return cache.join(n, "canonical", "left").select("canonical", "variants", (F.col("freq") + F.coalesce("n", F.lit(0))).alias("freq"))


def top_issues(verdicts: DataFrame, n: int = 30, width: int = 60) -> DataFrame:
    """The first rows of the issue table, cut to a width: a report of that many rows."""
    cells = [F.substring(c, 1, width).alias(c) for c in ("key", "en_current", "zh_current", "verdict", "reason")]
    return verdicts.where("verdict <> 'PASS'").orderBy("key", "reason").limit(n).select(*cells)
