"""External review: prompts go to a callable, answers are parsed tolerantly into rows."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULTS, REVIEW, Settings
from .answers import AnswerLog
from .verdicts import COLUMNS

Call = Callable[[str], str]
_ARRAY = re.compile(r"\[.*\]", re.DOTALL)
SCHEMA = ", ".join(f"{c} string" for c in COLUMNS)
ERROR_KEY = "__llm_error__"


def as_text(value) -> str:
    """A field of an answer as text: of an object its zh, text or value, or else its JSON."""
    if isinstance(value, str):
        return value
    if isinstance(value, dict):
        for name in ("zh", "text", "value"):
            if value.get(name):
                return as_text(value[name])
        return json.dumps(value, ensure_ascii=False)
    return "" if value is None else str(value)


def parse_answer(answer: str) -> list[dict]:
    """The objects of an answer: a JSON array or an object with verdicts; else an array inside other text; else one object a line."""

    def loaded(text: str):
        try:
            return json.loads(text)
        except ValueError:
            return None

    whole = loaded(answer)
    if isinstance(whole, dict) and isinstance(whole.get("verdicts"), list):
        whole = whole["verdicts"]
    if not isinstance(whole, list):
        inside = _ARRAY.search(answer)
        whole = loaded(inside[0]) if inside else None
    if not isinstance(whole, list):
        lines = (x.strip() for x in answer.split("\n"))
        objects = (loaded(x) for x in lines if x.startswith("{") and x.endswith("}"))
        whole = [x for x in objects if isinstance(x, dict) and "key" in x and "verdict" in x]
    return [x for x in whole if isinstance(x, dict)]


def is_truncated(answer: str) -> bool:
    return answer.count("{") != answer.count("}") or answer.count("[") != answer.count("]")


def retrying(call: Call, retries: int = DEFAULTS.review_retries, wait: Callable[[int], float] = lambda k: min(5 * 2**k, 60), sleep: Callable[[float], None] = time.sleep) -> Call:
    """The call, repeated with growing pauses if it fails or its answer is cut off or a web page; the last failure is raised."""

    def called(prompt: str) -> str:
        for k in range(retries + 1):
            try:
                answer = call(prompt)
                if answer.lstrip().lower().startswith(("<!doctype", "<html")):
                    raise ValueError("the answer is a web page")
                if is_truncated(answer):
                    raise ValueError("the answer is cut off")
                return answer
            except Exception:
                if k == retries:
                    raise
                sleep(wait(k))
        raise AssertionError

    return called


class Usage:
    """What reviewers were asked and said: calls, failures, and the characters of prompts and answers, as tasks report them when they end.

    A task that is repeated is counted again, so this is for observation alone.
    """

    def __init__(self, spark: SparkSession):
        self.calls, self.failures, self.asked, self.answered = (spark.sparkContext.accumulator(0) for _ in range(4))

    def counting(self, call: Call) -> Call:
        """The call, counted."""
        calls, failures, asked, answered = self.calls, self.failures, self.asked, self.answered

        def counted(prompt: str) -> str:
            calls.add(1)
            asked.add(len(prompt))
            try:
                answer = call(prompt)
            except Exception:
                failures.add(1)
                raise
            answered.add(len(answer))
            return answer

        return counted


def review(prompts: DataFrame, call: Call, source: str = "llm_review", settings: Settings = DEFAULTS, parallel: int | None = None, log: AnswerLog | None = None) -> DataFrame:
    """The verdicts that the callable gives for each prompt; a REVIEW row for a prompt that fails.

    With a log, prompts that it has answers to aren't asked, and what is returned reads it: it asks nobody, however often it is computed. Without one
    nothing is kept, and each computation of the result asks. Filter before this step: nothing is pushed through it. parallel bounds how many
    tasks ask at once, and settings.max_workers how many calls each of them has under way.
    """
    retries, workers = settings.review_retries, settings.max_workers

    def rows_of(answer: str | None, error: str | None) -> list[dict]:
        if error is not None:
            return [{"key": ERROR_KEY, "verdict": REVIEW, "reason": f"LLM调用失败: {error}", "source": "llm_error"}]
        return [{c: as_text(x.get(c)) for c in COLUMNS} | {"source": source} for x in parse_answer(answer)]

    def table(found) -> pd.DataFrame:
        return pd.DataFrame([r for rows in found for r in rows], columns=COLUMNS).fillna("").astype(str)

    if log is not None:
        def read(parts):
            for part in parts:
                yield table(rows_of(None if e is not None else a, e) for a, e in zip(part["answer"], part["error"], strict=True))

        return log.ask(prompts, retrying(call, retries), settings, parallel).select("answer", "error").mapInPandas(read, SCHEMA)

    def run(parts):
        ask = retrying(call, retries)

        def asked(prompt: str) -> list[dict]:
            try:
                return rows_of(ask(prompt), None)
            except Exception as e:  # noqa: BLE001  a failing batch becomes a row
                return rows_of(None, str(e))

        with ThreadPoolExecutor(workers) as pool:
            for part in parts:
                yield table(pool.map(asked, part["prompt"]))

    rows = prompts.select("prompt")
    return (rows.repartition(parallel) if parallel else rows).mapInPandas(run, SCHEMA)


def unanswered(prompts: DataFrame, answers: DataFrame) -> DataFrame:
    """Keys that were asked about and not answered."""
    return prompts.select(F.explode("keys").alias("key")).join(answers.select("key"), "key", "left_anti")


def with_unanswered(answers: DataFrame, queued: DataFrame) -> DataFrame:
    """The answers, and for each entry of the untranslated queue that they leave out the row that it has where nobody is asked."""
    return answers.unionByName(without_review(queued.join(answers.select("key").distinct(), "key", "left_anti")).select(answers.columns))


def without_review(queued: DataFrame) -> DataFrame:
    """A REVIEW row for each entry of the untranslated queue, where there is nobody to ask."""
    blank = F.lit("")
    return queued.where("queue = 'untranslated'").select("key", F.col("en").alias("en_current"), F.col("zh").alias("zh_current"), F.lit(REVIEW).alias("verdict"), blank.alias("suggestion"), F.lit("疑似未翻译（值相同，需人工判断）").alias("reason"), F.lit("untranslated_review").alias("source"))


def parse_answers(answers: DataFrame, column: str = "answer") -> DataFrame:
    """key, verdict, reason of answers that are JSON arrays, whole or inside other text, by built-in functions."""
    kind = "array<struct<key: string, verdict: string, reason: string>>"
    whole, inside = F.from_json(column, kind), F.from_json(F.regexp_extract(column, r"(?s)\[.*\]", 0), kind)
    return answers.select("*", F.explode(F.when(F.size(F.filter(whole, lambda x: x["key"].isNotNull())) > 0, whole).otherwise(inside)).alias("v")).select(*[c for c in answers.columns if c != column], "v.*").where("key is not null")
