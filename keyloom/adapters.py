"""Two-language entries from the driver's tables, which hold no bilingual data: every row and whole texts, with texts altered so that the operators find something.

The expressions are plain SQL that Spark and DuckDB both take; queries.py puts them into the SQL that results are compared with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .operators.tables import broadcast_by_true_size


#: Most rows, and bytes as they are stored, that a task takes of a table.
ROWS, BYTES = 20_000, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table; one whose files give too few tasks for its rows, its bytes or the cores (few row groups) is dealt over as many as these ask for, any other is read as it lies."""
    broadcast_by_true_size(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    tasks = max(spark.sparkContext.defaultParallelism, df.count() // ROWS, size // BYTES)  # the count is read from the files' footers
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks)


KEY = """concat(CASE page_id % 8 WHEN 0 THEN 'item.' WHEN 1 THEN 'subtitles.' WHEN 2 THEN 'book.' WHEN 3 THEN 'music_disc.' WHEN 4 THEN 'death.' WHEN 5 THEN 'block.' WHEN 6 THEN 'sound.' ELSE 'gui.' END, CAST(page_id AS STRING), CASE WHEN page_id % 8 = 3 THEN '.desc' ELSE '' END)"""
EN = """CASE WHEN page_id % 8 IN (1, 6) AND page_id % 3 = 0 THEN 'Iron door opens' WHEN page_id % 7 = 1 THEN 'Iron Sword' ELSE concat(html, CASE page_id % 5 WHEN 0 THEN ' %1$s of %d {name} %hp% {name}' WHEN 1 THEN ' §aGreen &b $(l:x) 10 FE' WHEN 2 THEN ' 5 RF and 3 kJ' ELSE '' END) END"""
ZH = """CASE WHEN page_id % 11 = 0 THEN en WHEN page_id % 13 = 0 THEN '' WHEN page_id % 8 IN (1, 6) AND page_id % 3 = 0 THEN '铁门打开' WHEN page_id % 7 = 1 THEN CASE WHEN page_id % 2 = 0 THEN '钢剑' ELSE '铁剑 ' END
 ELSE concat(CASE page_id % 4 WHEN 0 THEN replace(html, '<br>', '') WHEN 1 THEN replace(html, '&amp;', '') WHEN 2 THEN replace(html, '<p>', '') ELSE html END, CASE page_id % 5 WHEN 0 THEN '译文 %s 的 {name} %mp%' WHEN 1 THEN '译文 §b绿 &c 10能量FE...' WHEN 2 THEN '译文 , 红石 。(五)RF：' ELSE '' END) END"""
NAMESPACE = "regexp_extract(url, '^https?://([^/]+)', 1)"

#: The same in DuckDB: a view named entries, to be put before a query.
ENTRIES_SQL = f"""entries AS (SELECT *, {ZH} AS zh FROM (SELECT page_id, page_id AS pos, html, {NAMESPACE} AS namespace, {KEY} AS key, {EN} AS en FROM pages))"""


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, en, zh, namespace, pos from pages."""
    rows = table(spark, sf_dir, "pages").selectExpr("page_id", "page_id AS pos", "html", f"{NAMESPACE} AS namespace", f"{KEY} AS key", f"{EN} AS en")
    return rows.selectExpr("key", "en", f"{ZH} AS zh", "namespace", "pos")


SOURCE_MAP = ("CAST(doc_id AS STRING)", "text")
TARGET_MAP = ("concat(CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE '' END, CAST(doc_id AS STRING))", "CASE WHEN doc_id % 3 = 0 THEN concat(text, '!') WHEN doc_id % 17 = 1 THEN 'Word' ELSE text END")
#: key and value of the four maps of a change, from documents.
REVISIONS = {
    "old_en": ("concat(CASE WHEN doc_id % 10 = 0 THEN 'old' ELSE '' END, CAST(doc_id AS STRING))", "text"),
    "new_en": ("concat(CASE WHEN doc_id % 11 = 0 THEN 'new' ELSE '' END, CAST(doc_id AS STRING))", "CASE WHEN doc_id % 3 = 0 THEN concat(text, ' more') ELSE text END"),
    "old_zh": ("concat(CASE WHEN doc_id % 10 = 0 THEN 'old' ELSE '' END, CAST(doc_id AS STRING))", "concat('译', text)"),
    "new_zh": ("concat(CASE WHEN doc_id % 11 = 0 THEN 'new' ELSE '' END, CAST(doc_id AS STRING))", "CASE WHEN doc_id % 4 = 0 THEN concat('新', text) ELSE concat('译', text) END"),
}


def language_map(spark: SparkSession, sf_dir: str, pair: tuple[str, str]) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(f"{pair[0]} AS key", f"{pair[1]} AS value")


#: Keyed names: key, en (two words), zh, pos, from part.
PART_ZH = "CASE WHEN p_partkey % 10 < 7 THEN concat(split_part(p_name, ' ', 1), '料') WHEN p_partkey % 10 < 9 THEN concat(split_part(p_name, ' ', 1), '料', p_type) ELSE p_brand END"
PARTS_SQL = f"parts AS (SELECT concat('item.', CAST(p_partkey AS STRING)) AS key, p_name AS en, {PART_ZH} AS zh, p_partkey AS pos, p_type, p_brand FROM part)"


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("concat('item.', CAST(p_partkey AS STRING)) AS key", "p_name AS en", f"{PART_ZH} AS zh", "p_partkey AS pos", "p_type", "p_brand")
