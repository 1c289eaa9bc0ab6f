"""Versions of keyed texts compacted to intervals in which nothing changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import by_key, cut, tasks_for

#: Most versions of a task, which sorts them for its windows and joins; of a key all are in one.
EACH = 200_000


def intervals(versions: DataFrame, keys: list[str], order: list[Column], values: list[str], version: str, with_end: bool = False, tasks: int | None = None) -> DataFrame:
    """keys, values, version_start, version_end, changes (1 if the key's values ever change), nth; with_end: end, where the run's last row stands in the order.

    A run is a longest sequence of rows, in order, with the same values. One sort by key serves all windows. Rows are dealt by key over
    as many tasks as leave each EACH rows, whatever the session would take; tasks: how many, where that is known.
    """
    versions = by_key(versions, keys, tasks or tasks_for(versions, rows=EACH))
    w = Window.partitionBy(*keys).orderBy(*order)
    first = F.row_number().over(w) == 1
    same = F.lit(True)
    for v in values:
        same = same & F.col(v).eqNullSafe(F.lag(v).over(w))
    rows = versions.withColumn("_new", F.when(first | ~same, 1).otherwise(0))
    rows = rows.withColumns({"_run": F.sum("_new").over(w), "_nth": F.row_number().over(w)})
    # each value is constant in a run; the ends are found by position
    edge = lambda f: f(F.struct("_nth", F.col(version).alias("v")))["v"]
    runs = rows.groupBy(*keys, "_run").agg(*[F.first(v).alias(v) for v in values], edge(F.min).alias("version_start"), edge(F.max).alias("version_end"), *([F.max(F.struct(*order)).alias("end")] if with_end else []))
    changed = (F.max("_run").over(Window.partitionBy(*keys)) > 1).cast("int")
    return runs.select(*keys, *values, "version_start", "version_end", changed.alias("changes"), F.col("_run").cast("long").alias("nth"), *(["end"] if with_end else []))


def extend_intervals(runs: DataFrame, versions: DataFrame, new: DataFrame, keys: list[str], order: list[Column], values: list[str], version: str) -> DataFrame:
    """What intervals (with_end) gives for all rows, from the runs of the old ones and the new rows.

    Runs of other keys stay as they are. Of a key whose new rows all come after its last run only that run is looked at. Only for
    keys with rows that come late are the old rows (versions) read again. Keys aren't null.
    """
    columns = [*keys, *values, "version_start", "version_end", "changes", "nth", "end"]
    at = F.struct(*order)
    # what several steps read is a table, and each step one of its own: so a task sorts for one step, over as many tasks as rows ask for
    new = cut(new.select(*keys, *values, F.col(version).alias("_version"), at.alias("_at")))
    tasks = tasks_for(versions, new, rows=EACH)
    dealt = lambda df: by_key(df, keys, tasks)
    touched = dealt(new.select(*keys, "_at")).groupBy(*keys).agg(F.min("_at").alias("_first"))
    key = Window.partitionBy(*keys)
    runs = dealt(runs.select(columns)).join(touched, keys, "left").withColumn("_last", F.max("nth").over(key) == F.col("nth"))
    runs = cut(runs.withColumn("_late", F.coalesce(F.max(F.col("_last") & (F.col("_first") <= F.col("end"))).over(key), F.lit(False))))
    last = runs.where("_last and _first is not null")
    late, known = last.where("_late").select(*keys), last.where("not _late")
    # the last run stands before the new rows as one row of its values
    before = known.select(*keys, *values, F.col("version_end").alias("_version"), F.col("end").alias("_at"))
    met = lambda df, how: dealt(df).join(dealt(late), keys, how)
    of = lambda rows: cut(intervals(rows, keys, [F.col("_at")], values, "_version", True, tasks).withColumn("end", F.col("end._at")))
    after = of(before.unionByName(met(new, "left_anti")))
    after = dealt(after).join(dealt(known.select(*keys, F.col("nth").alias("_nth"), F.col("version_start").alias("_start"))), keys, "left").withColumns({
        "version_start": F.when((F.col("nth") == 1) & F.col("_nth").isNotNull(), F.col("_start")).otherwise(F.col("version_start")),
        "changes": F.when(F.col("_nth") > 1, 1).otherwise(F.col("changes")),
        "nth": F.col("nth") + F.coalesce("_nth", F.lit(1)) - 1,
    })
    old = versions.select(*keys, *values, F.col(version).alias("_version"), at.alias("_at"))
    again = of(met(old, "left_semi").unionByName(met(new, "left_semi")))
    # runs of other keys, and those before the last of keys without late rows
    kept = runs.where("_first is null or not (_last or _late)")
    return kept.select(columns).unionByName(after.select(columns)).unionByName(again.select(columns))


def interval_stats(runs: DataFrame, keys: list[str]) -> DataFrame:
    key = F.struct(*keys)
    return runs.agg(F.count("*").alias("n_intervals"), F.count_if(F.col("changes") == 1).alias("n_changed_rows"), F.count_distinct(key).alias("n_keys"), F.count_distinct(F.when(F.col("changes") == 1, key)).alias("n_changed_keys"))
