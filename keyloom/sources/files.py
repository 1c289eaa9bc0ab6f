"""Language files as rows: JSON maps, key-value ``.lang`` files, guide pages, saved change lists, dictionaries, verdict stores."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.text import strip, valid_term
from ..operators.align import GUIDE_PATH
from .change_pages import read_pages

PAIRS = "array<struct<key: string, value: string, warning: string>>"


def parse_json_map(text: str, clean: bool = True) -> list[tuple[str, str, str | None]]:
    """Key, value and warning of a flat JSON object, in order; of a repeated key the last value, at the first place.

    clean: without keys that begin with _comment, and with warnings about repeated keys.
    """
    values: dict[str, str] = {}
    repeated = set()
    for k, v in json.loads(text.lstrip("﻿") or "{}", object_pairs_hook=list) or []:
        if clean and k.startswith("_comment"):
            continue
        if k in values:
            repeated.add(k)
        values[k] = v if isinstance(v, str) else json.dumps(dict(v) if isinstance(v, list) and v and isinstance(v[0], tuple) else v, ensure_ascii=False)
    return [(k, v, f"repeated key {k!r}: the last value counts" if clean and k in repeated else None) for k, v in values.items()]


# Escapes of .lang files that stand for other characters.
_NAMED = {"n": "\n", "t": "\t", "r": "\r"}
_ESCAPE = re.compile(r"\\(u[0-9a-fA-F]{4}|.)", re.DOTALL)
_PLAIN_SPLIT = re.compile(r"[=:]")
_ESCAPED_SPLIT = re.compile(r"(?:\\.|[^\\=:])*?(?=[=:])", re.DOTALL)
_DIRECTIVE = ("#PARSE_ESCAPE", "#PARSE_ESCAPES")


def _unescaped(text: str) -> str:
    def one(m: re.Match) -> str:
        c = m[1]
        if c in _NAMED:
            return _NAMED[c]
        if len(c) == 5:
            return chr(int(c[1:], 16))
        return c if c in "\\:=#!" else "\\" + ("" if c != "u" else "u")

    return _ESCAPE.sub(one, text)


def parse_lang(text: str) -> list[tuple[str, str, str | None]]:
    """The same of a .lang text: comments, continued lines, escapes where a directive asks for them."""
    values: dict[str, str] = {}
    repeated, escapes, pending = set(), False, None
    lines = text.lstrip("﻿").splitlines()
    for i, line in enumerate(lines):
        if pending is not None:
            line, pending = pending + line, None
        else:
            bare = line.strip()
            if bare.upper() in _DIRECTIVE:
                escapes = True
                continue
            if not bare or bare[0] in "#!":
                continue
        if line.endswith("\\") and i + 1 < len(lines):
            pending = line[:-1]
            continue
        cut = (_ESCAPED_SPLIT.match(line) if escapes else None) or (None if escapes else _PLAIN_SPLIT.search(line))
        if cut is None:
            if not escapes:
                continue
            key, value = line.strip(), ""
        else:
            at = cut.end() if escapes else cut.start()
            key, value = line[:at].strip(), line[at + 1 :].strip()
        if not key:
            continue
        if escapes:
            key, value = _unescaped(key), _unescaped(value)
        if key in values:
            repeated.add(key)
        values[key] = value
    return [(k, v, f"repeated key {k!r}: the last value counts" if k in repeated else None) for k, v in values.items()]


def _pairs(parse):
    @F.pandas_udf(PAIRS)
    def parsed(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"key": k, "value": v, "warning": w} for k, v, w in parse(x)] if x is not None else [] for x in texts])

    return parsed


def map_rows(files: DataFrame, kind: str = "json", text: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, value, warning, pos of each pair of whole texts. kind: json, plain (JSON without cleaning) or lang.

    A file is the unit of reading and has to fit in memory; files are read in parallel.
    """
    parse = {"json": parse_json_map, "plain": lambda x: parse_json_map(x, clean=False), "lang": parse_lang}[kind]
    rows = files.select(*keep, F.posexplode(_pairs(parse)(F.col(text))).alias("pos", "x"))
    return rows.select(*keep, F.col("x.key").alias("key"), F.col("x.value").alias("value"), F.col("x.warning").alias("warning"), F.col("pos").cast("long").alias("pos"))


def read_map(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """The pairs of the file or files at a path, with the path; by the ending .lang or as JSON."""
    files = spark.read.text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    kind = kind or ("lang" if path.endswith(".lang") else "json")
    return map_rows(files, kind, keep=("path",))


def read_guides(spark: SparkSession, *paths: str) -> DataFrame:
    """path, key, lang, value: each guide page, or each below a folder, as one value.

    Spark doesn't list folders whose names begin with an underscore, so those of translations are named themselves.
    """
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(list(paths), wholetext=True)
    rows = files.select(F.regexp_extract(F.col("_metadata.file_path"), r"(projects/.*)$", 1).alias("path"), "value").where(F.col("path").rlike(GUIDE_PATH))
    g = lambda i: F.regexp_extract("path", GUIDE_PATH, i)
    return rows.select("path", F.concat(F.lit("ae2guide:"), g(7)).alias("key"), F.when(g(6) != "", "zh_cn").otherwise("en_us").alias("lang"), "value")


def read_alignment(spark: SparkSession, path: str) -> DataFrame:
    """The entries of saved change alignments."""
    entry = "struct<key: string, en: string, zh: string, namespace: string, format: string, old_en: string, old_zh: string, review_type: string>"
    rows = spark.read.schema(f"all_entries array<{entry}>").json(path, multiLine=True)
    return rows.select(F.explode("all_entries").alias("e")).select("e.*")


def read_changed_files(spark: SparkSession, path: str) -> DataFrame:
    """filename, status of saved change lists (JSON arrays, a page each)."""
    return spark.read.schema("filename string, status string").json(path, multiLine=True)


def list_changed_files(spark: SparkSession, page: Callable[[int], list[dict]], size: int = 100, tasks: int = 1) -> DataFrame:
    """The same from a service: page(n) gives the n-th page, from 1; one with fewer than ``size`` files is the last.

    One task never asks beyond the last page; more of them do, once each.
    """
    return read_pages(spark, page, size, tasks)


#: Columns of a table of known keys, each row being a text that stood through some versions; and of the plain one, a row for each version.
KEY_INTERVALS = "key string, category string, en_us string, zh_cn string, version_start string, version_end string, changes int"
KEY_VERSIONS = "key string, category string, en_us string, zh_cn string, version string"


def read_keys(spark: SparkSession, path: str, schema: str = KEY_INTERVALS, translated: bool = False) -> DataFrame:
    """A Parquet table of known keys; the columns that aren't used and, if only translated keys are asked for, the others' rows stay unread."""
    rows = spark.read.schema(schema).parquet(path)
    return rows.where("zh_cn IS NOT NULL AND zh_cn <> ''") if translated else rows


def read_lemma_cache(spark: SparkSession, path: str, settings: Settings = DEFAULTS) -> DataFrame:
    """canonical, variants, freq of a saved lemma cache (one JSON object of canonical terms), without terms that aren't valid.

    Without a list of variants the canonical term is its own. A variant of several canonical terms stays with the first of them.
    """
    rows = spark.read.text(path, wholetext=True)
    kind = "map<string, struct<variants: array<string>, freq: bigint>>"
    rows = rows.select(F.posexplode(F.from_json("value", kind)).alias("pos", "canonical", "x")).where(valid_term(F.col("canonical"), settings))
    v = rows.select("pos", "canonical", F.coalesce("x.freq", F.lit(0)).alias("freq"), F.explode(F.coalesce("x.variants", F.array("canonical"))).alias("v")).select("*", strip(F.lower("v")).alias("variant"))
    v = v.where(valid_term(F.col("v"), settings)).groupBy("variant").agg(F.min(F.struct("pos", "canonical", "freq")).alias("first")).select("variant", "first.*")
    return v.groupBy("canonical").agg(F.array_sort(F.collect_set("variant")).alias("variants"), F.max("freq").alias("freq"))


def with_fallback(get: Callable[[str, str], str], token: str) -> Callable[[str], str]:
    """get(url, token), and where the token is refused (401, or 403 that isn't a rate limit) without it."""

    def one(url: str) -> str:
        if not token:
            return get(url, "")
        try:
            return get(url, token)
        except Exception as e:
            said = str(e)
            if "401" in said or ("403" in said and "rate limit" not in said.lower()):
                return get(url, "")
            raise

    return one


def with_retries(get: Callable[[str], str], tries: int = 3, wait: Callable[[int], float] = lambda k: 2.0 * k, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], str]:
    """get(url), repeated with growing pauses where the connection fails or takes too long; what a server answers isn't asked again."""

    def one(url: str) -> str:
        for k in range(1, tries + 1):
            try:
                return get(url)
            except (TimeoutError, ConnectionError, OSError):
                if k == tries:
                    raise
                sleep(wait(k))
        raise AssertionError

    return one


def fetched(requests: DataFrame, fetch, column: str = "url") -> DataFrame:
    """The requests with the text that a callable gives for each, null where it fails; see with_fallback and with_retries."""

    @F.pandas_udf("string")
    def get(urls: pd.Series) -> pd.Series:
        def one(u):
            try:
                return fetch(u)
            except Exception:  # noqa: BLE001  a file that can't be had is absent
                return None

        return urls.map(one)

    return requests.withColumn("text", get(F.col(column)))
