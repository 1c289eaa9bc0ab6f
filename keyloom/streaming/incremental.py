"""Review of changes as they arrive: a stream of changed entries, checked batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.rules import check_entries
from ..operators.align import change_warnings, classify_changes, is_deletion
from ..operators.review import Call, review
from ..operators.routing import entry_blocks, prompts
from ..operators.verdicts import merge_verdicts, union_verdicts
from ..sources.sinks import save_verdicts

CHANGES = "key string, old_en string, new_en string, old_zh string, new_zh string"


def changed_entries(spark: SparkSession, path: str) -> DataFrame:
    """A stream of JSON lines of CHANGES, classified; unchanged keys are dropped. Stateless, so no watermark is needed."""
    rows = spark.readStream.schema(CHANGES).json(path)
    return classify_changes(rows.na.fill(""))


def start_review(changes: DataFrame, store: str, checkpoint: str, settings: Settings = DEFAULTS, then: Callable[[DataFrame, int], None] | None = None, call: Call | None = None):
    """Checks each batch by the rules, warns of sources that changed alone, and asks the reviewer (if there is one) about what the rules leave.

    The verdicts of a batch are stored, one a key, as a phase of its own, so a repeated batch replaces itself.
    """

    def batch(df: DataFrame, number: int) -> None:
        rows = df.where(~is_deletion())
        fmt = check_entries(rows.select("key", "en", "zh"), settings)
        parts = [fmt, change_warnings(rows)]
        if call:
            todo = rows.select("key", "en", "zh", "old_en", "old_zh").join(fmt.select("key").distinct(), "key", "left_anti")
            parts.append(review(prompts(entry_blocks(todo), F.concat("label", F.lit(": "), "focus"), settings, entries=todo), call, settings=settings))
        found = merge_verdicts(union_verdicts(*parts))
        save_verdicts(found, store, f"batch{number}")
        if then:
            then(found, number)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
