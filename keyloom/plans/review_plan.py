"""The review of aligned entries as one plan: rules, glossary, routing, external review, merging, filter, report."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, PASS, Settings
from ..functions.rules import check_entries
from ..functions.text import fuzzy_trigger, is_guide
from ..operators import glossary as g
from ..operators import lemma, routing, terms, verdicts
from ..operators.align import change_warnings, is_deletion
from ..operators.answers import AnswerLog
from ..operators.fuzzy import fuzzy_search
from ..operators.review import Call, review, with_unanswered, without_review
from ..operators.tables import cut, scratch_path


def _log(rows: DataFrame, log: AnswerLog | None) -> AnswerLog:
    return log or AnswerLog(rows.sparkSession, scratch_path(rows.sparkSession))


def header(changes: str = "", instruction: str = "") -> Column:
    """What stands above a batch of entries: what they are, what to look at, what to mind about changes and devices."""
    new = F.lit("\n\n## PR 模式审校指南\n" + changes) if changes else F.lit("")
    devices = F.when(F.col("guidance") != "", F.concat(F.lit("\n\n## 输入设备翻译专项指南\n"), "guidance")).otherwise("")
    return F.concat(F.lit("当前类型: "), "label", F.lit("（"), "prefix", F.lit("*）。\n\n## 审查重点\n"), "focus", new, F.lit("\n\n## 待审条目 ("), F.col("n").cast("string"), F.lit("条)\n" + instruction), devices)


@dataclass
class Reviewed:
    glossary: DataFrame
    format_verdicts: DataFrame
    term_verdicts: DataFrame
    routed: DataFrame
    merged: DataFrame
    stats: DataFrame
    by_namespace: DataFrame
    cache: DataFrame | None = None


@dataclass
class Mined:
    """Buckets after merging, the glossary (norm, en, zh), and the cache (canonical, variants, freq) with what was learned."""

    buckets: DataFrame
    glossary: DataFrame
    cache: DataFrame | None


def merge_lemmas(buckets: DataFrame, cache: DataFrame | None, call: Call | None, settings: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame | None]:
    """Buckets merged by the cache, then by what the callable says of clusters of similar terms; and the cache after it.

    Without a cache or a callable that step is left out.
    """
    if cache is not None:
        # a canonical term that has no bucket of its own becomes one
        buckets = cut(terms.merge_buckets(buckets, terms.cache_redirects(buckets, cache), settings=settings))
    if call is not None:
        merges = cut(lemma.ask_merges(cut(terms.cluster_terms(buckets, settings)), buckets, call, settings))
        buckets = cut(terms.merge_buckets(buckets, merges, settings=settings))
        known = cache if cache is not None else buckets.sparkSession.createDataFrame([], "canonical string, variants array<string>, freq long")
        cache = cut(lemma.record_merges(known, merges, settings))
    return buckets, cache


def mine(entries: DataFrame, cache: DataFrame | None = None, call: Call | None = None, verify: bool = True, settings: Settings = DEFAULTS) -> Mined:
    """Terms of entries (key, en, zh, pos) and what they are translated to; guide pages are left out.

    A cache and a callable merge terms; the callable corrects the glossary too if verify says so.
    """
    rows = entries.where(~is_guide(F.col("key")))
    buckets = cut(terms.bucket_terms(terms.extract_all(rows.select("key", F.col("en").alias("value"), "pos"), settings=settings), settings))
    buckets, cache = merge_lemmas(buckets, cache, call, settings)
    first = cut(g.build_glossary(buckets, rows, settings))
    glossary = cut(g.resolve_conflicts(first, buckets, rows, settings))
    if call is not None and verify:
        glossary = cut(lemma.verify_glossary(glossary, rows, call, settings))
    return Mined(buckets, glossary, cache)


def mine_glossary(entries: DataFrame, settings: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """Buckets and glossary by counting alone."""
    m = mine(entries, settings=settings)
    return m.buckets, m.glossary


def mine_keys(keys: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The glossary (norm, en, zh) of a table of known keys (key, en_us, zh_cn); keys without a translation tell nothing."""
    rows = keys.where("zh_cn IS NOT NULL AND zh_cn <> ''").select("key", F.col("en_us").alias("en"), F.col("zh_cn").alias("zh"))
    # a key may have stood through several versions: its texts are one each
    return mine(rows.distinct().withColumn("pos", F.xxhash64("key", "en", "zh")), settings=settings).glossary


def run_review(
    entries: DataFrame, call: Call | None = None, settings: Settings = DEFAULTS, cache: DataFrame | None = None, dictionary: DataFrame | None = None, lemmas: DataFrame | None = None,
    full: DataFrame | None = None, warnings: DataFrame | None = None, merge_call: Call | None = None, change_context: str = "", log: AnswerLog | None = None,
) -> Reviewed:
    """entries: key, en, zh, namespace, pos (and old_en, old_zh of changes). Without a callable, equal texts become REVIEW rows and the rules' verdicts stand.

    cache: learned merges of terms (canonical, variants, freq). merge_call: who is asked about terms. dictionary and lemmas: what
    lexicon.lookup takes. full: all entries of which these are the changed ones, to mine terms from. warnings: further verdicts.
    log: answers that are kept between runs; without it they are kept for this one, so no prompt is asked twice.
    """
    log = _log(entries, log)
    mined = mine(full if full is not None else entries, cache, merge_call, settings=settings)
    glossary = mined.glossary
    with_variants = glossary.join(mined.buckets.select("norm", "variants"), "norm").select(F.col("en").alias("term"), "variants", F.col("zh").alias("std_zh"))
    # what several steps read is computed once
    fmt = check_entries(entries, settings)
    if warnings is not None:
        last = warnings.select(*[c for c in fmt.columns if c in warnings.columns], *[F.lit(2**31 - 1).alias("seq")], *[F.lit(None).cast(kind).alias(c) for c, kind in fmt.dtypes if c in ("pos", "namespace")])
        fmt = fmt.unionByName(last)
    fmt = cut(fmt)
    term = cut(g.check_consistency(entries.select("key", "en", "zh"), with_variants))
    flagged = fmt.select("key").unionByName(term.select("key"))
    routed = routing.split_untranslated(routing.route(entries.select("key", "en", "zh"), flagged, glossary.select("en", "zh"), settings), fmt)
    routed = cut(routed)
    if call is None:
        asked = without_review(routed)
    else:
        old = [c for c in ("old_en", "old_zh") if c in entries.columns]
        todo = routed.where("queue = 'review'").select("key", "en", "zh")
        todo = todo.join(entries.select("key", *old), "key") if old else todo
        memory = entries.select("key", "en", "zh")
        similar = fuzzy_search(todo.where(fuzzy_trigger(F.col("key"), settings)).select(F.col("key").alias("q_key"), F.col("en").alias("query")), memory, settings).where("q_key <> key")
        auto = verdicts.union_verdicts(fmt, term)
        texts, keys = map(cut, routing.texts_of_parts(todo))
        # hints and the dictionary see the whole of a text of several parts, once; a block shows its beginning
        ids = cut(todo.select("key", "en").join(keys, "key", "left").select("key", "en", F.col("id").isNull().alias("lone"), F.coalesce("id", F.concat(F.lit("key "), "key")).alias("id")))
        shown = ids.where("lone").select(F.col("id").alias("key"), "en").unionByName(texts.select(F.col("id").alias("key"), F.col("full_en").alias("en")))
        by_key = lambda found: ids.select("key", "id").join(found.withColumnRenamed("key", "id"), "id").drop("id")
        known = by_key(routing.dictionary_lines(shown, dictionary, lemmas, settings)) if dictionary is not None else None
        heads = texts.select("id", *[F.when(is_guide(F.substring("id", 6, 2**31 - 1)), F.col(c)).otherwise(F.substring(c, 1, 600)).alias(c) for c in ("full_en", "full_zh")])
        parts = keys.join(heads, "id").drop("id")
        blocks = routing.entry_blocks(todo, auto, similar, by_key(routing.glossary_hints(shown, glossary.select("en", "zh"))), parts, known)
        asked = review(routing.prompts(blocks, header(change_context), settings, entries=todo), call, settings=settings, log=log)
        queued = routed.where("queue = 'untranslated'").select("key", "en", "zh", "queue")
        same = routing.entry_blocks(queued.select("key", "en", "zh"))
        said = review(routing.prompts(same, header(), settings), call, "untranslated_review", settings, log=log)
        asked = asked.unionByName(with_unanswered(said, queued))
    merged = cut(verdicts.merge_verdicts(verdicts.union_verdicts(fmt, term, asked)))
    return Reviewed(glossary, fmt, term, routed, merged, verdicts.review_stats(entries, merged), verdicts.namespace_report(merged, entries), mined.cache)


def run_change_review(changes: DataFrame, full: DataFrame, call: Call | None = None, settings: Settings = DEFAULTS, **more) -> tuple[Reviewed, DataFrame]:
    """The review of a change alone, and its deletions by namespace.

    changes: what align.diff_revisions gives, with namespace and pos. full: the entries (key, en, zh, pos) of the new revision, which terms are mined from.
    Pure deletions aren't reviewed; a changed source with the old translation gets a SUGGEST verdict.
    """
    gone = changes.where(is_deletion())
    rows = cut(changes.where(~is_deletion()))
    warned = change_warnings(rows)
    entries = rows.select("key", "en", "zh", "namespace", "pos", "old_en", "old_zh")
    done = run_review(entries, call, settings, full=full, warnings=warned, **more)
    filled = cut(verdicts.normalized(done.merged, entries))
    return replace(done, merged=filled), gone.groupBy("namespace").agg(F.count("*").alias("deletions"))


def run_filter(merged: DataFrame, cache: DataFrame, call: Call, settings: Settings = DEFAULTS, log: AnswerLog | None = None) -> tuple[DataFrame, DataFrame]:
    """The merged verdicts after the filter, and the cache with what was asked: cached decisions first, the callable for the rest.

    What the callable doesn't answer stays as it is. log: as in run_review; both results read it, so both together ask once.
    The verdicts are computed once, however dear they are, and read from a table by the steps.
    """
    merged = cut(merged)
    split = verdicts.split_by_cache(merged, cache)
    todo = split.where("not hit")
    block = F.concat_ws("\n", F.concat(F.lit("key: `"), "key", F.lit("`")), F.concat(F.lit('EN: "'), F.substring("en_current", 1, 200), F.lit('"')), F.concat(F.lit('ZH: "'), F.substring("zh_current", 1, 200), F.lit('"')), F.concat(F.lit("判定: "), "verdict"), F.concat(F.lit("问题: "), "reason"), F.when(F.coalesce("suggestion", F.lit("")) != "", F.concat(F.lit("建议: "), "suggestion")))
    above = F.concat(F.lit("## 问题列表 ("), F.col("n").cast("string"), F.lit("条) "), "label")
    answers = review(routing.prompts(todo.select("key", block.alias("block")), above, settings, settings.filter_batch), call, "filter", settings, log=_log(merged, log))
    said = answers.groupBy("key").agg(F.max_by("verdict", F.struct("verdict", "reason")).alias("v"), F.max_by("reason", F.struct("verdict", "reason")).alias("r"))
    fresh = todo.join(said, "key", "left").select("key", "cache_key", F.when(F.col("v") == PASS, PASS).otherwise("KEEP").alias("action"), F.coalesce("r", F.lit("")).alias("reason"))
    known = split.where("hit").select("key", "cache_key", "action", F.col("cleaned").alias("reason"))
    decided = verdicts.apply_filter(merged, known.unionByName(fresh).select("key", "action", "reason"))
    out = merged.drop("verdict", "reason").join(decided, "key").select(*verdicts.COLUMNS)
    return out, verdicts.upsert(cache.select("cache_key", "action", "reason"), fresh.select("cache_key", "action", "reason"), "cache_key")
