"""Answers of a reviewer about terms: merging of clusters, corrections of the glossary, and the cache that learns from them."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, MERGE_PROMPT, VERIFY_PROMPT, Settings
from ..functions import text as t
from .glossary import pick_contexts, term_hits
from .numbering import numbered
from .review import Call, retrying

_ARRAY = re.compile(r"\[.*\]", re.DOTALL)
_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.DOTALL)


def _list(text: str) -> list | None:
    try:
        found = json.loads(text)
    except ValueError:
        return None
    return found if isinstance(found, list) else []


def parse_merges(answer: str) -> dict[str, str]:
    """Canonical term of each member that an answer names (a JSON array, whole or inside other text); a canonical term is its own."""
    found = _list(answer)
    if found is None:
        inside = _ARRAY.search(answer)
        found = (_list(inside[0]) if inside else None) or []
    out: dict[str, str] = {}
    for x in found:
        canonical, members = (x.get("canonical"), x.get("members")) if isinstance(x, dict) else (None, None)
        if isinstance(canonical, str) and canonical and isinstance(members, list) and members:
            out |= {m: canonical for m in members if isinstance(m, str)}
            out.setdefault(canonical, canonical)
    return out


def parse_corrections(answer: str) -> dict[str, str]:
    """New translation of each term (in lower case) that an answer corrects; the array may stand in a fenced block."""
    fenced = _FENCE.search(answer)
    out = {}
    for x in _list((fenced[1] if fenced else answer).strip()) or []:
        if isinstance(x, dict) and isinstance(x.get("en"), str) and isinstance(x.get("new_zh"), str):
            en, zh = x["en"].lower().strip(), x["new_zh"].strip()
            if en and zh:
                out[en] = zh
    return out


def _asked(prompts: DataFrame, call: Call, parse, settings: Settings) -> DataFrame:
    """a, b: what the answers to the prompts map to what. A prompt that fails maps nothing."""
    retries = settings.review_retries

    def run(parts):
        ask = retrying(call, retries)
        for part in parts:
            rows = []
            for prompt in part["prompt"]:
                try:
                    rows += parse(ask(prompt)).items()
                except Exception:  # noqa: BLE001  the terms stay as they are
                    continue
            yield pd.DataFrame(rows, columns=["a", "b"]).astype(str)

    return prompts.select("prompt").mapInPandas(run, "a string, b string")


def _batches(blocks: DataFrame, size: int, head: str) -> DataFrame:
    """prompt: the blocks (column block) in the order of their numbers (column nth), ``size`` in each, under a head."""
    per = blocks.groupBy(F.floor(F.col("nth") / size).alias("batch")).agg(F.array_sort(F.collect_list(F.struct("nth", "block"))).alias("all"))
    return per.select("batch", F.concat(F.lit(head + "\n\n"), F.array_join(F.transform("all", lambda x: x["block"]), "\n\n")).alias("prompt"))


def merge_prompts(clusters: DataFrame, buckets: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """batch, prompt: clusters of terms (norm, cluster) to be judged, the most frequent term of each first."""
    rows = clusters.join(buckets.select("norm", "freq"), "norm")
    terms = F.array_sort(F.collect_list(F.struct((-F.col("freq")).alias("f"), "norm")))
    per = rows.groupBy("cluster").agg(terms.alias("terms")).join(numbered(rows.select("cluster").distinct(), ["cluster"]), "cluster")
    lines = F.array_join(F.transform("terms", lambda x: F.concat(F.lit("  - "), x["norm"])), "\n")
    block = F.concat(F.lit("## 候选组 "), (F.col("nth") + 1).cast("string"), F.lit("\n"), lines)
    return _batches(per.select("nth", block.alias("block")), settings.merge_batch, MERGE_PROMPT)


def ask_merges(clusters: DataFrame, buckets: DataFrame, call: Call, settings: Settings = DEFAULTS) -> DataFrame:
    """norm, target: what the reviewer merges into what; one target a term."""
    found = _asked(merge_prompts(clusters, buckets, settings), call, parse_merges, settings)
    return found.groupBy(F.col("a").alias("norm")).agg(F.min("b").alias("target"))


def verify_prompts(glossary: DataFrame, entries: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """batch, prompt: terms (en, zh) with the longest and the four shortest texts (entries: key, en, zh, pos) that have them; terms with one text aren't asked about."""
    low = F.lower("en")
    terms = glossary.select(low.alias("term"), F.array(low).alias("variants"), F.col("zh").alias("std_zh"))
    hits = term_hits(entries.select("key", "en", "zh"), terms).join(entries.select("key", "pos"), "key")
    some = pick_contexts(hits.select("term", F.col("en").alias("text"), "pos"))
    line = F.transform(F.array_sort(F.collect_list(F.struct("nth", "text"))), lambda x, i: F.concat(F.lit("  ["), (i + 1).cast("string"), F.lit('] "'), x["text"], F.lit('"\n')))
    per = some.groupBy("term").agg(F.array_join(line, "").alias("lines")).join(glossary.select(low.alias("term"), "en", "zh"), "term")
    block = F.concat(F.lit('Term: "'), "en", F.lit('" -> "'), "zh", F.lit('"\n'), "lines")
    # terms of one spelling in lower case are one number apart, by their own spelling
    nth = numbered(per.select("term", "en", "zh"), ["term", "en", "zh"])
    return _batches(per.join(nth, ["term", "en", "zh"]).select("nth", block.alias("block")), settings.verify_batch, VERIFY_PROMPT)


def corrected(glossary: DataFrame, corrections: DataFrame) -> DataFrame:
    """The glossary with the translations of corrections (en in lower case, new_zh)."""
    one = corrections.groupBy(F.col("en").alias("low")).agg(F.min("new_zh").alias("new_zh"))
    return glossary.join(one, F.lower("en") == F.col("low"), "left").withColumn("zh", F.coalesce("new_zh", "zh")).select(glossary.columns)


def verify_glossary(glossary: DataFrame, entries: DataFrame, call: Call, settings: Settings = DEFAULTS) -> DataFrame:
    """The glossary after the reviewer's corrections."""
    found = _asked(verify_prompts(glossary, entries, settings), call, parse_corrections, settings)
    return corrected(glossary, found.select(F.col("a").alias("en"), F.col("b").alias("new_zh")))


def variant_map(cache: DataFrame) -> DataFrame:
    """variant, canonical: each variant's first canonical term. cache: canonical, variants (null: the term itself)."""
    rows = cache.select("canonical", F.explode(F.coalesce("variants", F.array("canonical"))).alias("v")).select("canonical", t.strip(F.lower("v")).alias("variant"))
    return rows.groupBy("variant").agg(F.min("canonical").alias("canonical"))


def record_merges(cache: DataFrame, merges: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The cache (canonical, variants, freq) after merges (norm, target) are learned.

    A variant that had another canonical term moves; that one's frequency falls by one for each, never below 0, and the new one's
    rises by one for each member and one for itself. Terms that aren't valid are left out.
    """
    m = merges.where(t.valid_term(F.col("norm"), settings) & t.valid_term(F.col("target"), settings)).select(t.strip(F.lower("norm")).alias("variant"), F.col("target").alias("to"))
    m = m.unionByName(m.select(t.strip(F.lower("to")).alias("variant"), "to")).distinct()
    old = variant_map(cache)
    both = old.join(m, "variant", "full")
    now = both.select("variant", F.coalesce("to", "canonical").alias("canonical"))
    gained = m.groupBy(F.col("to").alias("canonical")).agg(F.count("*").alias("gained"))
    lost = both.where("to is not null and canonical is not null and variant <> lower(to)").groupBy("canonical").agg(F.count("*").alias("lost"))
    freq = cache.groupBy("canonical").agg(F.max("freq").alias("freq")).join(lost, "canonical", "left").select("canonical", F.greatest(F.lit(0), F.col("freq") - F.coalesce("lost", F.lit(0))).alias("kept"))
    rows = now.groupBy("canonical").agg(F.array_sort(F.collect_set("variant")).alias("variants"))
    counted = rows.join(freq, "canonical", "left").join(gained, "canonical", "left")
    return counted.select("canonical", "variants", (F.coalesce("kept", F.lit(0)) + F.coalesce("gained", F.lit(0))).cast("long").alias("freq"))


def cache_stats(cache: DataFrame) -> DataFrame:
    """entries (canonical terms) and variants of a cache."""
    return variant_map(cache).agg(F.count_distinct("canonical").alias("entries"), F.count("*").alias("variants"))
