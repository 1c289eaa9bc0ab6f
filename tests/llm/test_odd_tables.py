"""Each operator on tables with further columns named as its own, very long texts, repeated rows and nothing at all."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from keyloom.llm.chat import format_and_read
from keyloom.llm.collocations import collocations
from keyloom.llm.decontaminate import decontaminate
from keyloom.llm.kneser_ney import quality
from keyloom.llm.language_id import identify
from keyloom.llm.lsh_forest import nearest
from keyloom.llm.near_copies import near_copies
from keyloom.llm.packing import pack
from keyloom.llm.ppm import score_texts
from keyloom.llm.simhash import near_duplicates
from keyloom.llm.token_count import count_tokens
from keyloom.llm.toxicity import toxicity
from keyloom.llm.variants import spelling_groups
from keyloom.llm.warc import round_trip

NAMES = "key payload sha1 n full refers_to archive frame offset segment row items n_hit piece start length task nth before sequence_id flag block kind shard asked counts train held trusted same fp bits more prefix rep component_id variant name x y a b root node score rejected lang_pred id vec ids asks dim tree part hash n_tokens phrase a l r rank k cut longer word form variant y h at _h _y _text predicted names".split()


def text(rnd, n):
    return " ".join("".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(2)
    rows = [(i, text(rnd, rnd.randrange(1, 60)), "en") for i in range(40)] + [(50, None, None), (51, "", "en"), (52, text(rnd, 50_000), "en"), (None, "no key", "en")]
    return spark.createDataFrame(rows + rows[3:6], "doc_id long, text string, lang string").repartition(2)


def labels(docs):
    return docs.where("doc_id is not null").select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))


OPERATORS = {
    "warc": lambda d: round_trip(d.withColumnsRenamed({"doc_id": "page_id", "text": "html", "lang": "url"})).drop("frame", "offset"),
    "decontaminate": lambda d: decontaminate(d, d.where("doc_id < 5").selectExpr("doc_id AS item_id", "text")),
    "chat": lambda d: format_and_read(d.selectExpr("*", "doc_id AS conv_id", "1L AS turn", "lang AS role")),
    "packing": lambda d: pack(d, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "piece", "start", "length", "ids_crc32"),
    "ppm": lambda d: score_texts(d.withColumn("learn", F.col("doc_id") % 3 != 0), "learn"),
    "simhash": near_duplicates,
    "near_copies": near_copies,
    "kneser_ney": lambda d: quality(d, labels(d)),
    "token_count": lambda d: count_tokens(d, public_tokenizers.path("word_bpe_49k.json")),
    "language_id": lambda d: identify(d, d),
    "collocations": lambda d: collocations(d, least=2),
    "variants": lambda d: spelling_groups(d).where("n > 2"),
    "toxicity": lambda d: toxicity(d, labels(d).withColumn("toxic", (F.col("doc_id") % 2).cast("int")), F.col("_id") % 3 != 1),
    "lsh_forest": lambda d: nearest(d.selectExpr("*", "doc_id AS vec_id", "array(cast(doc_id + 1 as float), 1f, cast(length(text) as float)) AS embedding"), F.col("vec_id") % 10 == 0),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_further_columns_change_nothing(docs, name):
    def rows(df):
        return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in OPERATORS[name](df).collect()), key=str)

    plain = rows(docs)
    own = {"warc": {"doc_id", "lang", "text"}}.get(name, set())
    assert plain and plain == rows(docs.withColumns({c: F.lit("clash") for c in NAMES if c not in own}))


@pytest.mark.parametrize("name", OPERATORS)
def test_an_empty_table_gives_no_rows(docs, name):
    assert OPERATORS[name](docs.where(F.lit(False))).collect() == []


def test_a_very_long_text_is_taken_whole(docs, spark):
    """Its end counts as well as its beginning."""
    long = docs.where("doc_id = 52").first().text
    item = spark.createDataFrame([(1, " ".join(long.split(" ")[-10:]))], "item_id long, text string")
    assert decontaminate(docs.where("doc_id = 52"), item).first().n_hit == 10
    assert sum(r.length for r in pack(docs.where("doc_id = 52"), public_tokenizers.path("byte_bpe_50k.json")).collect()) > 50_000
    two = spark.createDataFrame([(1, long), (2, long + " " + long[::-1][:200]), (3, long[len(long) // 2 :])], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_copies(two).collect()} == {1: 1, 2: 1, 3: 3}
    scored = score_texts(docs.where("doc_id = 52").withColumn("learn", F.lit(True)), "learn").first()
    assert scored.n_tokens == 50_001 == scored.n_known == scored.train_tokens
