"""Answers of a reviewer that outlive the tasks that asked: a prompt is asked once, whatever is repeated afterwards.

Answers are rows by the digest of their prompt, in a folder. Prompts that have an answer aren't asked; the others are asked in rounds
and a round's answers are written before anything reads them, so a lost executor, a second action on a lazy result or a second run
asks for nothing that is written. Within a round only a task that is lost asks again, and a task is short: the first round has a task
of few prompts for each core, any other as many a task as were asked in SECONDS in the round before, from those few to MOST. So a slow
reviewer's tasks have few prompts, and a quick one's aren't mostly the start of a task and the end of a file.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from .tables import by_key, cut, scratch_path

#: Prompts of a bucket, of which a round takes whole ones, and of the shortest task for each of its workers.
EACH, PER_WORKER = 20_000, 8
#: Most prompts of a task, how long it asks, and how many of the tasks of a round a core has.
MOST, SECONDS, WAVES = 1_000, 5, 8
_ROW = "id string, answer string, error string"


def _asking(call: Callable[[str], str], workers: int, spent: Accumulator, n: Accumulator) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Answers to the prompts of a task, so many at once; adds the seconds that it asked, and how many prompts."""

    def asked(prompt: str) -> tuple[str | None, str | None]:
        try:
            return call(prompt), None
        except Exception as e:  # noqa: BLE001  a failing prompt is a row
            return None, str(e) or type(e).__name__

    def run(parts):
        with ThreadPoolExecutor(workers) as pool:
            for part in parts:
                began = time.monotonic()
                found = list(pool.map(asked, part["prompt"]))
                spent.add(time.monotonic() - began)
                n.add(len(found))
                yield pd.DataFrame({"id": part["id"], "answer": [a for a, _ in found], "error": [e for _, e in found]}, columns=["id", "answer", "error"])

    return run


class AnswerLog:
    """The answers in a folder, which is made if it isn't there."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        # a first, empty part, so that there is always something to read
        spark.createDataFrame([], _ROW).write.mode("ignore").parquet(f"{self.path}/part=first")

    def rows(self) -> DataFrame:
        """id (SHA-256 of a prompt), answer, error (null if it was answered), as written so far."""
        return self.spark.read.schema(f"{_ROW}, part string").parquet(self.path).drop("part")

    def ask(self, prompts: DataFrame, call: Callable[[str], str], settings: Settings = DEFAULTS, parallel: int | None = None) -> DataFrame:
        """id, answer, error of each distinct prompt (column prompt); one that failed before is asked again. A null prompt is none.

        parallel: so many tasks are a round, whatever a task then has.
        """
        # prompts are made once: the result reads their ids from this table too
        wanted = cut(prompts.where("prompt is not null").select(F.sha2("prompt", 256).alias("id"), "prompt").dropDuplicates(["id"]))
        todo = wanted.join(self.rows().where("error is null").select("id"), "id", "left_anti")
        n = todo.count()
        few, cores = PER_WORKER * settings.max_workers, parallel or self.spark.sparkContext.defaultParallelism
        first = min(few * cores, EACH)
        buckets = (n - first) // EACH + 1 if n > first else 0
        if buckets:
            # a round reads its own prompts and neither those of others nor what was answered meanwhile
            later = F.pmod(F.xxhash64("id", F.lit("later")), F.lit(buckets)) + 1
            todo, path = todo.withColumn("bucket", F.when(F.pmod(F.xxhash64("id"), F.lit(n)) < first, 0).otherwise(later)), scratch_path(self.spark)
            by_key(todo, "bucket", buckets).write.partitionBy("bucket").parquet(path)
            todo = self.spark.read.schema(todo.schema).parquet(path)  # the files are listed once and not for each round
        # the first round is bucket 0, or all prompts
        at, many, rows, size = 0, 1, first if buckets else n, few
        while n and at <= buckets:
            some = todo.where(F.col("bucket").between(at, at + many - 1)).drop("bucket") if buckets else todo
            spent, asked = self.spark.sparkContext.accumulator(0.0), self.spark.sparkContext.accumulator(0)
            run = _asking(call, settings.max_workers, spent, asked)
            some.repartition(parallel or -(-rows // size), "id").mapInPandas(run, _ROW).write.parquet(f"{self.path}/part={uuid.uuid4().hex}")
            if asked.value:
                size = max(few, min(MOST, int(SECONDS * asked.value / max(spent.value, 1e-6))))
            at += many
            many = max(1, min(size * (parallel or WAVES * cores) // EACH, buckets + 1 - at))
            rows = (n - first) * many // max(1, buckets) + 1
        found = self.rows().groupBy("id").agg(F.max("answer").alias("answer"), F.max("error").alias("error"), F.bool_or(F.col("error").isNull()).alias("ok"))
        return wanted.select("id").join(found, "id").select("id", "answer", F.when(~F.col("ok"), F.col("error")).alias("error"))
