"""A translation memory's index that is kept in a folder, searched again and again, and updated by the lines that changed.

An update is a generation of its own: the words of new and changed lines, the lines' digests, and which lines of earlier generations no longer
count. What earlier generations wrote stays as it is until ``compact``. The dictionary of words is kept sorted and numbered, so a beginning is an
interval of numbers; its ends are found among the first words of blocks of BLOCK words, and only blocks that an interval touches are read.

A generation counts once its row in ``commits`` is written, which is last, so an update that was lost midway is as if it hadn't been.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .numbering import numbered
from .recall import index_tokens

#: Words of a block of the dictionary; blocks of an interval that one row lists.
BLOCK, AT_ONCE = 256, 4096
#: Sorts after whatever a word may go on with.
_LAST = "\U0010ffff"


def digest(memory: DataFrame) -> DataFrame:
    """key, digest of each line's texts; null and empty texts differ from each other in nothing that is indexed."""
    return memory.select("key", F.sha2(F.to_json(F.struct(F.coalesce("en", F.lit("")).alias("en"), F.coalesce("zh", F.lit("")).alias("zh"))), 256).alias("digest"))


class RecallIndex:
    """The index in a folder, as of its last generation or the one that is named."""

    def __init__(self, spark: SparkSession, path: str, generation: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.generation = self._read("commits").agg(F.max("generation")).first()[0] if generation is None else generation

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    @classmethod
    def build(cls, memory: DataFrame, path: str) -> RecallIndex:
        """A new index of a memory (unique key, en, zh), in a folder that has none."""
        return cls(memory.sparkSession, path, -1)._write(memory, None)

    def update(self, memory: DataFrame) -> RecallIndex:
        """The index of the memory as it is now: lines that are new, changed or gone are told by their digests; no other line is cut into words again."""
        was = self.lines().select("key", F.col("digest").alias("was"), "generation")
        both = digest(memory).join(was, "key", "full")
        differs = both.where(~F.col("digest").eqNullSafe(F.col("was"))).select("key", "digest", "generation")
        return self._write(memory, differs)

    def _write(self, memory: DataFrame, differs: DataFrame | None) -> RecallIndex:
        gen, own = self.generation + 1, lambda name: f"{self.path}/{name}/generation={self.generation + 1}"
        if differs is not None:
            differs.write.mode("overwrite").parquet(own("differs"))
            differs = self.spark.read.schema(differs.schema).parquet(own("differs"))
            memory = memory.join(differs.where("digest is not null").select("key"), "key", "left_semi")
        index_tokens(memory).write.mode("overwrite").parquet(own("postings"))
        fresh = self.spark.read.parquet(own("postings"))
        words = fresh.groupBy("key").agg(F.first("words").alias("words"))
        digest(memory).join(words, "key", "left").select("key", "digest", F.coalesce("words", F.lit(0)).alias("words")).write.mode("overwrite").parquet(own("lines"))
        counts = fresh.groupBy("token").agg(F.count("*").alias("lines"))
        if differs is not None:
            gone = differs.where("generation is not null").select("key", F.col("generation").cast("int").alias("of"))
            gone.write.mode("overwrite").parquet(own("gone"))
            gone = self.spark.read.parquet(own("gone")).select(F.col("key").alias("_key"), "of")
            lost = self._stored("postings").join(gone, (F.col("key") == F.col("_key")) & (F.col("generation") == F.col("of")), "left_semi")
            counts = counts.unionByName(lost.groupBy("token").agg((-F.count("*")).alias("lines"))).unionByName(self.dictionary().select("token", "lines"))
            counts = counts.groupBy("token").agg(F.sum("lines").alias("lines")).where("lines > 0")
        numbered(counts, ["token"], name="rank").write.mode("overwrite").parquet(own("dictionary"))
        self.spark.range(1).select(F.lit(gen).alias("generation")).write.mode("append").parquet(f"{self.path}/commits")
        return RecallIndex(self.spark, self.path, gen)

    def _stored(self, name: str) -> DataFrame:
        """All rows of generations up to this one, those that no longer count included."""
        return self._read(name).where(F.col("generation") <= self.generation)

    def _current(self, name: str) -> DataFrame:
        rows = self._stored(name)
        if self.generation == 0:
            return rows
        gone = self._stored("gone").select(F.col("key").alias("_key"), "of")
        return rows.join(gone, (F.col("key") == F.col("_key")) & (F.col("generation") == F.col("of")), "left_anti")

    def lines(self) -> DataFrame:
        """key, digest, words, generation of each line."""
        return self._current("lines")

    def postings(self) -> DataFrame:
        """key, token, tf, words."""
        return self._current("postings").select("key", "token", "tf", "words")

    def dictionary(self) -> DataFrame:
        """token, lines (that have it), rank (from 0, by the words' bytes)."""
        return self.spark.read.parquet(f"{self.path}/dictionary/generation={self.generation}")

    def size(self) -> tuple[int, float]:
        """The number of lines with words, and their mean words."""
        row = self.lines().where("words > 0").agg(F.count("*").alias("n"), F.avg("words").alias("mean")).first()
        return row["n"], row["mean"]

    def blocks_of(self, prefixes: DataFrame) -> DataFrame:
        """prefix, block: the blocks of the dictionary that may hold words with each prefix.

        A prefix and its end are put among the first words of all blocks; how many stand before them says which blocks lie between.
        """
        firsts = self.dictionary().where(F.col("rank") % BLOCK == 0).select(F.col("token").alias("s"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("prefix"))
        marks = prefixes.select("prefix").distinct().select("prefix", F.explode(F.array(F.struct(F.col("prefix").alias("s"), F.lit(0).alias("kind")), F.struct(F.concat("prefix", F.lit(_LAST)).alias("s"), F.lit(2).alias("kind")))).alias("m")).select("m.s", "m.kind", "prefix")
        among = numbered(marks.unionByName(firsts), ["s", "kind"], name="all").where("prefix is not null")
        own = numbered(marks, ["s", "kind"], name="own").select("prefix", "kind", "own")
        before = among.join(own, ["prefix", "kind"]).select("prefix", "kind", (F.col("all") - F.col("own")).alias("before"))
        ends = before.groupBy("prefix").agg(F.greatest(F.max(F.when(F.col("kind") == 0, F.col("before"))) - 1, F.lit(0)).alias("low"), (F.max(F.when(F.col("kind") == 2, F.col("before"))) - 1).alias("high")).where("high >= low")
        # in two steps, so that no row holds a long list
        some = ends.select("prefix", "high", F.explode(F.sequence("low", "high", F.lit(AT_ONCE).cast("long"))).alias("from"))
        return some.select("prefix", F.explode(F.sequence("from", F.least(F.col("from") + (AT_ONCE - 1), F.col("high")))).alias("block"))

    def matching(self, prefixes: DataFrame) -> DataFrame:
        """prefix, token, rank: the words that begin with each prefix."""
        words = self.dictionary().select("token", "rank", F.floor(F.col("rank") / BLOCK).alias("block"))
        return self.blocks_of(prefixes).join(words, "block").where(F.startswith("token", "prefix")).select("prefix", "token", "rank")

    def compact(self, path: str) -> RecallIndex:
        """The same index as one generation, in a folder of its own."""
        for name in ("lines", "postings"):
            self._current(name).drop("generation").write.parquet(f"{path}/{name}/generation=0")
        self.dictionary().write.parquet(f"{path}/dictionary/generation=0")
        self.spark.range(1).select(F.lit(0).alias("generation")).write.mode("append").parquet(f"{path}/commits")
        return RecallIndex(self.spark, path, 0)
