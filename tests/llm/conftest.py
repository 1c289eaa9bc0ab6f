import random

import pytest
from pyspark.sql import types as T


@pytest.fixture(scope="session")
def odd_texts():
    rnd = random.Random(5)
    alphabet = "abcdeé ñ Σσς 'strd  \n\t12٣!?.#%_中文🙂é  \x1c\x1fİß"
    texts = [None, "", " ", "a", "a" * 3000, "x<|endoftext|>y", "<|startoftext|> don't WE'LL", "ΑΣ ΟΔΟΣ", "It's\x1cok", "café au lait", "<|endoftext|"]
    return texts + ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(200))) for _ in range(300)]


@pytest.fixture(scope="session")
def as_docs(spark):
    def make(texts, ids=None, **more):
        """Documents with a null row, and columns with clashing names."""
        schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_tokens", T.StringType()), T.StructField("task", T.StringType())] + [T.StructField(k, T.StringType()) for k in more])
        rows = [(ids[i] if ids else i, t, "x", "y", *(v[i] for v in more.values())) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, schema)

    return make
