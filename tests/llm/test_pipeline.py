import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p

LANGS = {"en": "abcdefgh", "xx": "qrstuvwx"}


def text_of(rnd, lang, n):
    return " ".join("".join(rnd.choice(LANGS[lang]) for _ in range(rnd.randrange(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(9)
    at = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, text_of(rnd, "en" if i % 2 else "xx", rnd.randrange(60, 300)), "en" if i % 2 else "xx") for i in range(120)]
    item = text_of(rnd, "en", 25)
    rows += [(200 + i, rows[i][1], rows[i][2]) for i in range(5)]  # exact copies
    rows += [(300 + i, rows[i][1] + " " + text_of(rnd, "en", 1), rows[i][2]) for i in (7,)]  # may or may not be a near copy
    rows += [(400, text_of(random.Random(10), "en", 150) + "\n" + item + ".", "en")]  # a benchmark passage
    rows += [(401, rows[21][1] + "\n" + item + ".", "en")]  # another one, in what is a near copy of 21 (similarity 0.91)
    rows += [(500 + i, "".join(chr(rnd.randrange(33, 64)) for _ in range(900)), "en") for i in range(5)]  # junk
    rows += [(600, None, "en"), (601, "", None)]
    docs = spark.createDataFrame([(*r, "src", len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(120)] + [(500, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages_drop_what_they_should_and_keep_the_rest(spark, folder):
    docs, gone = spark.read.parquet(f"{folder}/documents.parquet"), {}
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        gone[name], ids = ids - now, now
    assert gone["quality classifier"] >= {*range(500, 505), 600, 601}
    clean = set(range(120))
    assert len(gone["quality classifier"] & clean) <= 3 and not gone["language ID"] & clean
    assert gone["SimHash near-dedup"] >= {*range(200, 205)} - gone["quality classifier"] and not gone["SimHash near-dedup"] & clean
    assert 401 in gone["SimHash near-dedup"] | gone["quality classifier"]
    assert gone["benchmark decontamination"] | gone["quality classifier"] >= {400} and not gone["benchmark decontamination"] & clean


def test_run_packs_what_is_kept(spark, folder):
    rows = p.run(spark, folder).collect()
    ids = {r.doc_id for r in rows}
    assert len(ids & set(range(120))) >= 117 and not ids & {*range(200, 205), *range(500, 505), 600, 601}
    assert all(0 < r.length <= 1024 and r.offset + r.length <= 1024 for r in rows)


def test_nothing_left(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where(F.lit(False))
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, folder)
    assert p.STAGES[-1][1](spark, docs, folder).collect() == []


def test_clashing_columns_and_a_very_long_text(spark, folder):
    """Columns named as the operators name theirs are carried through; a long text is decided as a whole."""
    names = ["score", "rejected", "lang_pred", "keep", "train", "held", "trusted", "same", "kept_id", "component_id", "contaminated", "n_hit", "segment", "piece"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rnd = random.Random(4)
    long = text_of(rnd, "en", 60_000)
    more = spark.createDataFrame([(700, long, "en", "src", len(long)), (701, long.upper() + "\n", "en", "src", len(long))], docs.schema)
    docs = docs.unionByName(more).withColumns({n: F.lit(f"x{i}") for i, n in enumerate(names)})
    columns = docs.columns
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == columns
    kept = {r.doc_id: r for r in docs.collect()}
    assert 700 in kept and 701 not in kept and kept[700].text == long and kept[700].score == "x0" and kept[700].rejected == "x1"
    pieces = [r for r in p.STAGES[-1][1](spark, docs, folder).where("doc_id = 700").collect()]
    assert len(pieces) > 20 and sorted(r.piece for r in pieces) == list(range(len(pieces)))
