import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.llm.language_id import counts, identify, is_held_out, kmeans
from keyloom.llm.textvec import texts

import pyarrow as pa

WORDS = {
    "en": "the and of with this thing other which would there about could people water little number".split(),
    "de": "der und nicht eine über können straße wasser größer menschen wenig zwischen schön nach".split(),
    "fr": "les une été être avec dans pour français où même très première général eau petite".split(),
}


def make(n, seed=1):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        k = rnd.choice(list(WORDS))
        out.append((k, " ".join(rnd.choice(WORDS[k]) for _ in range(rnd.randrange(20, 200)))))
    return out


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, t, k, "x") for i, (k, t) in enumerate(make(300))]
    rows += [(1000, None, "en", "x"), (1001, "", "de", "x"), (1002, "123 !? 4", "fr", "x"), (1003, "the people there", None, "x"), (None, "der und nicht", "de", "x"), (1004, "语言" * 2000, None, "x"), (1005, "a", None, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string").withColumn("held_out", is_held_out("doc_id", 3, 1))


def test_held_out_accuracy_and_odd_rows(table):
    got = {r.doc_id: r for r in identify(table, table.where("not held_out"), keep=("held_out",)).collect()}
    truth = {r.doc_id: r.lang for r in table.collect()}
    assert set(got) == set(truth)
    held = [i for i in range(300) if got[i].held_out]
    assert len(held) > 50 and all(got[i].lang_pred == truth[i] for i in held)
    assert not any(got[i].rejected for i in range(300))
    for i in (1000, 1001, 1002):
        assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True)
    assert got[1003].lang_pred == "en" and got[1005].lang_pred in WORDS
    assert got[None].lang_pred == "de"
    assert got[1004].rejected and got[1004].lang_pred in WORDS
    assert all(0 <= r.score <= 1 for r in got.values())


def test_score_is_the_largest_cosine_by_brute_force(spark):
    df = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(make(30, 7))], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in identify(df, df).collect()}
    # with as many clusters as there are rows of a language, each text is its own centroid
    few = spark.createDataFrame([(1, "the people", "en"), (2, "une eau", "fr")], "doc_id long, text string, lang string")
    same = identify(few, few).collect()
    assert all(abs(r.score - 1) < 1e-5 for r in same) and {r.lang_pred for r in same} == {"en", "fr"}
    assert len(got) == 30


def test_nothing_to_learn_and_empty(spark, table):
    none = table.where(F.lit(False))
    assert {r.lang_pred for r in identify(table, none).collect()} == {"und"}
    assert identify(none, table).collect() == []


def test_counts_by_brute_force():
    t = ["Ab c!", "", "É", "x"]
    got = counts(*texts(pa.array(t)))
    assert list(got.sum(1)) == [3, 0, 2, 1]
    assert (counts(*texts(pa.array(["AB", "ÀÉ"]))) == counts(*texts(pa.array(["ab", "àé"])))).all()


def test_kmeans_separates():
    x = np.repeat(np.eye(3, 5), 10, axis=0)
    c, r = kmeans(x, 3)
    assert len(c) == 3 and np.allclose(r, 0)
