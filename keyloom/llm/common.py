"""What the operators share: reading tables, scratch tables in the shared folder, Arrow batches of bounded size."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch that Spark hands to a Python worker (one row may be longer).
BATCH_BYTES = 4 << 20
#: Rows of such a batch.
BATCH_ROWS = 4096


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


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The whole table, through Spark's reader, so any store that Spark knows will do."""
    broadcast_by_true_size(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches are cut by bytes as well as by rows, so that long texts don't pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")


def shared_root(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of our own only where none is set, which a cluster isn't allowed."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file:///tmp/keyloom-{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", root)
        atexit.register(_delete, spark, root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the JVM may be gone at exit; the folder is scratch
        pass


class Scratch:
    """Tables written under the shared folder and read again: they cut lineage and outlive executors.

    ``with Scratch(spark) as s``: s.table(df, name) lasts to the end of the block,
    s.keep(df) to the end of the process.
    """

    def __init__(self, spark: SparkSession):
        broadcast_by_true_size(spark)
        self.spark, self.root = spark, f"{shared_root(spark)}/keyloom/{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        _delete(self.spark, self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"

    def _write(self, df: DataFrame, path: str) -> DataFrame:
        # once the table is written, nothing reads the shuffle files that led to it
        name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(name, None)
        self.spark.conf.set(name, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.unset(name) if before is None else self.spark.conf.set(name, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def table(self, df: DataFrame, name: str = "t") -> DataFrame:
        return self._write(df, self.path(name))

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}-kept-{uuid.uuid4().hex[:8]}"
        atexit.register(_delete, self.spark, path)
        return self._write(df, path)

    def drop(self, df: DataFrame) -> None:
        """Deletes a table of this scratch before the block ends."""
        for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
            if f.startswith(self.root) or self.root.removeprefix("file://") in f:
                _delete(self.spark, f)


def release() -> None:
    """Hands free memory of this worker back to the system; allocators keep it for a next time that is another task's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def rechunk(batches: Iterator[pa.RecordBatch], size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Joins small batches until they hold about ``size`` bytes, so that vector code has enough to do."""
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.nbytes
        if n >= size:
            yield _joined(held)
            held, n = [], 0
            release()
    if held:
        yield _joined(held)
        held = []
    release()


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def partitions_for(spark: SparkSession, df: DataFrame, each: int = 64 << 20) -> int:
    """Partitions of about ``each`` bytes by the planner's sizes of what ``df`` reads; at least the session's setting.

    The leaves' sizes are added up: that of a join is estimated as a product.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // each + 1)
