"""State that lives across batches and restarts: the filter's decisions and the learned merges, kept by key in a state store.

Both are stateful processors over streams: a row meets only the state of its own key, the store keeps what doesn't fit in memory on disk, and
a stream that is started again from its checkpoint goes on with the state that its last finished batch left. What each gives over all batches
is what the batch joins (verdicts.split_by_cache and upsert, lemma.record_merges and variant_map) give over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.text import cache_key, strip

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_text = lambda *names: StructType([StructField(n, StringType()) for n in names])
DECIDED = _text("cache_key", "key", "action", "reason")
MOVED = _text("variant", "canonical", "was")
_DECIDED, _MOVED = Row(*DECIDED.fieldNames()), Row(*MOVED.fieldNames())


def use_rocksdb(spark: SparkSession) -> None:
    """State in RocksDB on the executors' disks, with its changes in the checkpoint; stateful processors need it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class FilterDecisions(StatefulProcessor):
    """For each cache key the decision with the largest ``ord``, and the keys of verdicts that wait for one.

    A verdict whose decision is known is answered at once, others when it comes; a later decision holds for later verdicts. Of decisions
    with the same ``ord`` in a batch the last by action and reason counts, no reason being the last.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.decision = handle.getValueState("decision", StructType([StructField("ord", LongType()), *_text("action", "reason").fields]))
        self.waiting = handle.getListState("waiting", _text("key"))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        asked: list[str] = []
        top = None
        for _, asks, action, reason, ord_ in rows:
            if action is None:
                asked.append(asks)
            elif top is None or (ord_, action, reason is None, reason or "") > top:
                top = ord_, action, reason is None, reason or ""
        was = self.decision.get()
        best = was if top is None or (was is not None and top[0] < was[0]) else (top[0], top[1], top[3])
        if best is None:
            self.waiting.appendList([(k,) for k in asked])
            return
        if best != was:
            self.decision.update(best)
        answer = lambda k: _DECIDED(key[0], k, best[1], best[2])
        if was is None:
            n = 0
            for (k,) in self.waiting.get():
                n += 1
                yield answer(k)
            if n:
                self.waiting.clear()
        for k in asked:
            yield answer(k)

    def close(self) -> None:
        pass


class LearnedMerges(StatefulProcessor):
    """For each variant its canonical term: that of the merge with the largest ``ord``, of several with it the first by name."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.canonical = handle.getValueState("canonical", StructType([StructField("ord", LongType()), StructField("canonical", StringType())]))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        was = best = self.canonical.get()
        for _, to, ord_ in rows:
            if best is None or ord_ > best[0] or (ord_ == best[0] and to < best[1]):
                best = ord_, to
        if best != was:
            self.canonical.update(best)
            if was is None or was[1] != best[1]:
                yield _MOVED(key[0], best[1], None if was is None else was[1])

    def close(self) -> None:
        pass


def decided(verdicts: DataFrame, decisions: DataFrame) -> DataFrame:
    """cache_key, key, action, reason of each verdict once a decision on it is known, as a stream.

    verdicts: a stream of key, verdict, zh_current, reason. decisions: a stream of cache_key, action, reason, ord.
    """
    none = lambda kind: F.lit(None).cast(kind)
    asked = verdicts.select(cache_key(F.col("key"), F.col("verdict"), F.col("zh_current"), F.col("reason")).alias("cache_key"), "key", none("string").alias("action"), none("string").alias("reason"), none("long").alias("ord"))
    made = decisions.select("cache_key", none("string").alias("key"), "action", "reason", F.col("ord").cast("long").alias("ord"))
    return asked.unionByName(made).groupBy("cache_key").transformWithState(FilterDecisions(), DECIDED, "Append", "None")


def merged_terms(merges: DataFrame) -> DataFrame:
    """variant, canonical, was: each move of a variant to a canonical term, as a stream.

    merges: a stream of norm, target, ord; a target is a variant of itself.
    """
    rows = merges.select(F.explode(F.array("norm", "target")).alias("v"), F.col("target").alias("canonical"), F.col("ord").cast("long").alias("ord"))
    return rows.select(strip(F.lower("v")).alias("variant"), "canonical", "ord").groupBy("variant").transformWithState(LearnedMerges(), MOVED, "Append", "None")


def store(stream: DataFrame, path: str, checkpoint: str):
    """Takes what there is into a folder of Parquet, each row once, and ends; started again, it goes on from its checkpoint."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
