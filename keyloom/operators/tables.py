"""Tables that are computed once, written to the folder that all executors share, and read from there on."""

from __future__ import annotations

import atexit
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of our own only where none is set and there is one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file:///tmp/keyloom-engine-{spark.sparkContext.applicationId}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the JVM may be gone at exit; the folder is scratch
        pass


def broadcast_by_true_size(spark: SparkSession) -> None:
    """Only tables whose rows have been counted in a shuffle are broadcast, up to the session's threshold.

    Before that the planner knows the sizes of compressed files alone, of which a few MB may be a driver's whole memory of rows.
    """
    static = "spark.sql.autoBroadcastJoinThreshold"
    most = spark.conf.get(static)
    if most != "-1" and spark.conf.get("spark.sql.adaptive.enabled") == "true":
        if spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None:
            spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", most)
        spark.conf.set(static, "-1")


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted at the end of the process."""
    broadcast_by_true_size(spark)
    path = f"{shared_folder(spark)}/keyloom-engine/{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


#: Most rows of a task where rows are dealt by a key.
ROWS = 20_000


def by_key(df: DataFrame, key: str | list[str], tasks: int) -> DataFrame:
    """The rows dealt over this many tasks by a key (of one column or several), which what joins, groups or numbers them by it then keeps.

    Left to itself a session deals any number of rows over as many tasks as it has cores, so that what a task holds grows with the table.
    """
    return df.repartition(tasks, *([key] if isinstance(key, str) else key))


def tasks_for(*tables: DataFrame, rows: int | None = None) -> int:
    """How many tasks leave each of them ``rows`` rows of all these tables at most (ROWS, if it isn't said)."""
    return max(tables[0].sparkSession.sparkContext.defaultParallelism, sum(df.count() for df in tables) // (rows or ROWS) + 1)


class Cut:
    """Tables of a computation: ``cut(df)`` writes the rows and gives them as they are read again; ``drop(df)`` deletes one.

    What isn't dropped goes at the end of the process, as lazy results may still read it.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.paths = spark, scratch_path(spark), {}

    def __call__(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{len(self.paths)}"
        # a column of nulls has no type that files know
        df = df.withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "void"})
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = out, path
        return out

    def drop(self, df: DataFrame) -> None:
        _delete(self.spark, self.paths[id(df)][1])


def cut(df: DataFrame) -> DataFrame:
    """The rows, computed once and read from the shared folder from here on."""
    return Cut(df.sparkSession)(df)
