"""Which entries need review, with what context, in what batches; and the prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, GUIDE_PREFIX, Settings
from ..functions import text as t
from .lexicon import lookup
from .numbering import numbered
from .substrings import contained, spans
from .tables import by_key, tasks_for

# Fixed value: what may stand between the terms that cover a text.
GAP = r"""[ ,.!?;:'"()\[\]{}<>\-_/%\t\n\r]"""


def covered(entries: DataFrame, glossary: DataFrame) -> DataFrame:
    """The entries (key, en, zh) whose source text is nothing but glossary terms (en, zh) and separators and whose target is their translations.

    All terms of a text are found in one pass by an automaton; the leftmost, then longest, are taken in one walk over what it found. Keys are unique.
    """
    terms = glossary.select(F.lower("en").alias("pattern"), F.col("zh").alias("out"))
    per = spans(entries.where("en <> ''").select("key", F.lower("en").alias("low")), terms, "key", "low").join(entries.select("key", "en", "zh"), "key")
    nothing = lambda a, b: F.regexp_replace(F.substring("en", a, b - a), GAP, "") == ""
    walked = F.aggregate(
        "spans", F.struct(F.lit(1).alias("at"), F.lit(True).alias("ok"), F.lit("").alias("out")),
        lambda a, h: F.when(h["s"] < a["at"], a).otherwise(F.struct((h["s"] + h["n"]).alias("at"), (a["ok"] & nothing(a["at"], h["s"])).alias("ok"), F.concat(a["out"], h["out"]).alias("out"))),
    )
    done = per.withColumn("w", walked)
    rest = F.regexp_replace(F.expr("substring(en, w.at)"), GAP, "") == ""
    return done.where(F.col("w.ok") & rest & (F.col("w.out") == F.col("zh"))).select("key", "en", "zh")


def route(entries: DataFrame, flagged: DataFrame, glossary: DataFrame | None, settings: Settings = DEFAULTS) -> DataFrame:
    """The entries (key, en, zh) with a route: flagged, required, uncovered or pass; all but the last go to review.

    flagged: key. Without a glossary, or with one that has no terms, no entry is uncovered. Only the entries that the cheaper tests leave are
    compared with the glossary.
    """
    rows = entries.join(flagged.select("key").distinct().withColumn("f", F.lit(True)), "key", "left")
    first = F.when(F.col("f").isNotNull(), "flagged").when(t.needs_review(F.col("key"), F.coalesce("en", F.lit("")), settings), "required")
    rows = rows.withColumn("route", first).drop("f")
    if glossary is None or glossary.isEmpty():
        return rows.withColumn("route", F.coalesce("route", F.lit("pass")))
    ok = covered(rows.where("route is null"), glossary).select("key").withColumn("c", F.lit(True))
    return rows.join(ok, "key", "left").withColumn("route", F.coalesce("route", F.when(F.col("c").isNotNull(), "pass").otherwise("uncovered"))).drop("c")


def split_untranslated(routed: DataFrame, format_verdicts: DataFrame) -> DataFrame:
    """Entries for review with queue: untranslated (a rule found equal texts) or review."""
    same = format_verdicts.where(F.contains("reason", F.lit("值相同"))).select("key").distinct().withColumn("u", F.lit(True))
    return routed.where("route <> 'pass'").join(same, "key", "left").withColumn("queue", F.when(F.col("u").isNotNull(), "untranslated").otherwise("review")).drop("u")


def _parts(entries: DataFrame) -> DataFrame:
    return entries.withColumns({"base": t.multipart_base(F.col("key")), "digits": t.multipart_number(F.col("key"))}).where("digits <> ''")


def _texts(parts: DataFrame) -> DataFrame:
    """base, parts (in order), full_en, full_zh of each text of two parts or more."""
    part = F.struct(F.col("digits").cast("decimal(38,0)").alias("n"), "key", F.coalesce("en", F.lit("")).alias("en"), F.coalesce("zh", F.lit("")).alias("zh"))
    whole = parts.groupBy("base").agg(F.array_sort(F.collect_list(part)).alias("parts")).where(F.size("parts") >= 2)
    text = lambda c: F.array_join(F.transform("parts", lambda p: p[c]), "")
    return whole.select("base", "parts", text("en").alias("full_en"), text("zh").alias("full_zh"))


def multipart(entries: DataFrame) -> DataFrame:
    """key, full_en, full_zh of entries that are numbered parts of one text (base.N or base[N], two or more), joined in order of N.

    Each part has the whole text, so a text of many parts is many rows of its length: see texts_of_parts.
    """
    return _texts(_parts(entries)).select(F.explode("parts").alias("p"), "full_en", "full_zh").select("p.key", "full_en", "full_zh")


def texts_of_parts(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """id, full_en, full_zh of each text that multipart finds, as one row; and id, key of its parts. What a text has is found once and not for each part."""
    rows = _parts(entries)
    id_ = F.concat(F.lit("text "), "base").alias("id")
    several = rows.groupBy("base").agg(F.count("*").alias("n")).where("n >= 2").select("base")
    return _texts(rows).select(id_, "full_en", "full_zh"), rows.select("base", "key").join(several, "base").select(id_, "key")


def batch_numbers(rows: DataFrame, group: str, order: list[str], size: int) -> DataFrame:
    """The rows with batch, from 0 in each group; guide pages are batches of their own. Rows are sorted and written, so they are best keys without texts."""
    per = F.when(F.col(group) == GUIDE_PREFIX, 1).otherwise(size)
    return numbered(rows, order, group).withColumn("batch", F.floor(F.col("nth") / per).cast("long")).drop("nth")


def input_guidance(rows: DataFrame, by: list[str]) -> DataFrame:
    """By batch: whether texts name keyboard keys or mouse actions."""
    return rows.groupBy(*by).agg(F.bool_or(F.col("en").rlike(t.KEYBOARD)).alias("keyboard"), F.bool_or(F.concat("en", "zh").rlike(t.MOUSE)).alias("mouse"))


def glossary_hints(entries: DataFrame, glossary: DataFrame, most: int = 5) -> DataFrame:
    """key, hints: up to ``most`` glossary terms (en, zh) that the source text contains, in the glossary's order.

    All terms of a text are found in one pass by an automaton. What they find is dealt by key over tasks of as many entries each, whatever the number of entries.
    """
    terms = glossary.select(F.col("en").alias("term"), F.col("zh").alias("std"), F.lower("en").alias("pattern"))
    hits = contained(entries.select("key", F.lower("en").alias("low")), terms.select("pattern"), "key", "low").join(terms, "pattern").select("key", "term", "std")
    hits = by_key(hits, "key", tasks_for(entries)).distinct()
    few = hits.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("term", "std"))).where(F.col("nth") <= most)
    one = F.concat(F.lit('"'), "term", F.lit('" → "'), "std", F.lit('"'))
    return few.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", one.alias("hint")))), lambda x: x["hint"]), ", ").alias("hints"))


def dictionary_lines(entries: DataFrame, dictionary: DataFrame, lemmas: DataFrame | None = None, settings: Settings = DEFAULTS, most: int = 3) -> DataFrame:
    """key, known: a line with what a dictionary has of the words of a text, those that most modules have first, then in the text's order.

    Words travel with their keys alone, and a word is looked up once, however many texts have it.
    """
    stop = F.array(*[F.lit(w) for w in settings.stop_words])
    words = entries.select("key", F.posexplode(t.all_matches(F.col("en"), r"[A-Za-z]+")).alias("at", "shown")).withColumn("word", F.lower("shown")).where(~F.array_contains(stop, F.col("word")))
    words = words.groupBy("key", "shown", "word").agg(F.min("at").alias("at"))
    # of one word no more can be among the first of a text, as they stand in the same order
    found = lookup(words.select("word").distinct(), dictionary, lemmas, top=most).select("word", "zh", "n_mods", "mods")
    first = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("n_mods"), "at", "zh"))
    few = words.join(found, "word").withColumn("nth", first).where(F.col("nth") <= most)
    one = F.concat(F.lit('"'), "shown", F.lit('" -> "'), "zh", F.lit('" 来源Mod: ['), "mods", F.lit("]"))
    lines = few.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("nth", one.alias("l")))).alias("all"))
    return lines.select("key", F.concat(F.lit("  外部词典: "), F.array_join(F.transform("all", lambda x: x["l"]), " | ")).alias("known"))


def entry_blocks(entries: DataFrame, verdicts: DataFrame | None = None, similar: DataFrame | None = None, hints: DataFrame | None = None, parts: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """key, block: what a reviewer is shown of an entry. Texts are cut to bound a prompt's size; guide pages aren't."""
    rows = entries
    rows = rows.join(parts, "key", "left") if parts is not None else rows.withColumns({"full_en": F.lit(None).cast("string"), "full_zh": F.lit(None).cast("string")})
    if verdicts is not None:
        line = F.concat(F.lit("  自动检查: "), "verdict", F.lit(" — "), "reason")
        rows = rows.join(verdicts.groupBy("key").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("auto")), "key", "left")
    if similar is not None:
        line = F.concat(F.lit("    sim="), F.col("similarity").cast("string"), F.lit('% | EN: "'), F.substring("en", 1, 100), F.lit('" | ZH: "'), F.substring("zh", 1, 100), F.lit('"'))
        top = similar.where("nth <= 3").groupBy(F.col("q_key").alias("key")).agg(F.array_sort(F.collect_list(F.struct("nth", line.alias("l")))).alias("s"))
        rows = rows.join(top.select("key", F.concat(F.lit("  模糊匹配:\n"), F.array_join(F.transform("s", lambda x: x["l"]), "\n")).alias("memory")), "key", "left")
    if hints is not None:
        rows = rows.join(hints.select("key", F.concat(F.lit("  术语: "), "hints").alias("terms")), "key", "left")
    whole, n = F.col("full_en").isNotNull(), F.when(t.is_guide(F.col("key")), 2**31 - 1).when(F.col("full_en").isNotNull(), 600).otherwise(300)
    label = F.when(whole, " (完整上下文)").otherwise("")
    shown = lambda name, full, c: F.concat(F.lit(name), label, F.lit(': "'), F.substring(F.coalesce(full, c), F.lit(1), n), F.lit('"'))
    lines = [F.concat(F.lit("key: `"), "key", F.lit("`")), shown("EN", F.col("full_en"), F.col("en")), shown("ZH", F.col("full_zh"), F.col("zh"))]
    for c in ("old_en", "old_zh"):
        if c in entries.columns:
            lines.append(F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f'{c}: "'), F.substring(c, 1, 300), F.lit('"'))))
    rows = rows.join(known, "key", "left") if known is not None else rows
    lines += [F.col(c) for c, d in (("auto", verdicts), ("memory", similar), ("terms", hints), ("known", known)) if d is not None]
    return rows.select("key", F.concat_ws("\n", *lines).alias("block"))


def prompts(blocks: DataFrame, header: Column, settings: Settings = DEFAULTS, size: int | None = None, entries: DataFrame | None = None) -> DataFrame:
    """prefix, batch, n, keys, prompt: blocks (key, block) by key prefix in batches, under a header.

    header: a column of prefix, label, focus (what to look at in entries of this prefix), n and guidance (what to mind about
    keyboard and mouse if the batch's texts name them; empty without entries, which are key, en, zh).
    """
    rows = blocks.withColumn("prefix", t.key_prefix(F.col("key"), settings))
    rows = rows.join(batch_numbers(rows.select("prefix", "key"), "prefix", ["key"], size or settings.review_batch).drop("prefix"), "key")
    if entries is not None:
        seen = entries.select("key", F.coalesce("en", F.lit("")).alias("en"), F.coalesce("zh", F.lit("")).alias("zh"))
        seen = seen.select("key", F.col("en").rlike(t.KEYBOARD).alias("keyboard"), F.concat("en", "zh").rlike(t.MOUSE).alias("mouse"))
        rows = rows.join(seen, "key", "left")
    else:
        rows = rows.withColumns({"keyboard": F.lit(False), "mouse": F.lit(False)})
    per = rows.groupBy("prefix", "batch").agg(F.array_sort(F.collect_list(F.struct("key", "block"))).alias("all"), F.bool_or("keyboard").alias("keyboard"), F.bool_or("mouse").alias("mouse"))
    focus = F.lit(settings.default_review_focus)
    for p, text in settings.focus.items():
        focus = F.when(F.col("prefix") == p, text).otherwise(focus)
    guidance = F.concat_ws("\n", F.when(F.col("keyboard"), settings.keyboard_guidance), F.when(F.col("mouse"), settings.mouse_guidance))
    per = per.withColumns({"n": F.size("all"), "label": t.prefix_label(F.col("prefix"), settings), "focus": focus, "guidance": guidance})
    return per.select("prefix", "batch", "n", F.transform("all", lambda x: x["key"]).alias("keys"), F.concat(header, F.lit("\n\n"), F.array_join(F.transform("all", lambda x: x["block"]), "\n\n")).alias("prompt"))
