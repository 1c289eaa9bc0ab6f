"""A training-data pipeline of five stages over ``documents``; counted as part of keyloom.llm.

Each stage takes all rows that its predecessor kept and either keeps or drops each one by its operator's
decision; the last gives the packed pieces. Between stages, run() writes Parquet in the shared folder
and reads it again.

But for language ID, rows are told apart by doc_id: rows with a null doc_id or one that repeats are decided
together with the rows of the same doc_id (a document is kept if one of its rows is). Null and empty texts are dropped by
the first stage. Repeated rows are copies of each other, of which the third stage keeps those with the smallest doc_id. Long texts
are read whole by all stages. Further columns, also ones named as an operator names its own, are carried through all stages but
the last. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.common import Scratch, read_table
from keyloom.llm.decontaminate import decontaminate
from keyloom.llm.kneser_ney import quality
from keyloom.llm.language_id import identify
from keyloom.llm.near_copies import near_copies
from keyloom.llm.packing import pack


def _kept(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id the operator kept; decided: doc_id, keep."""
    # the ids are made a hash table in each partition, so the texts needn't be sorted
    ids = decided.where("keep").select(F.col("doc_id").alias("kept_id")).distinct().hint("shuffle_hash")
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["kept_id"]), "left_semi").select(docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under a model of trusted texts is usual in their language."""
    return _kept(docs, quality(docs, read_table(spark, sf_dir, "labels")))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are near a centroid of some language."""
    # the operator adds columns, and documents may have ones of the same names
    inner = docs.toDF(*[f"doc_{c}" for c in docs.columns])
    found = identify(inner, inner, "doc_doc_id", "doc_text", "doc_lang", keep=tuple(inner.columns)).where("not rejected")
    return found.select(inner.columns).toDF(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of copies and of texts at 0.8 or more in shingles of five words."""
    return _kept(docs, near_copies(docs).select("doc_id", F.col("component_id").eqNullSafe(F.col("doc_id")).alias("keep")))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = decontaminate(docs, read_table(spark, sf_dir, "benchmark", "item_id", "text"))
    return _kept(docs, found.select("doc_id", (~F.col("contaminated")).alias("keep")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document, with its sequence and place."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("best-fit packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; the rows of the last."""
    docs = read_table(spark, sf_dir, "documents")
    with Scratch(spark) as s:
        for name, stage in STAGES[:-1]:
            docs = s.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        return STAGES[-1][1](spark, docs, sf_dir)  # its rows are written and read again by the operator


#: The model-based stages can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None
