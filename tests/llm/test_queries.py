"""The registered queries, over small tables of their own, against plain Python written from their contracts."""

import math
import random
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from keyloom.llm import kneser_ney
from keyloom.llm import queries as q
from keyloom.llm.ppm import ORDER, Trie

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SYLLABLES = {"en": ["th", "er", "an", "on", "in", "st"], "de": ["sch", "ein", "ch", "ß", "ü", "ver"], "fr": ["eau", "è", "qu", "ou", "aille", "ç"]}


def words_of(t):
    return [w for w in (t or "").translate(LOWER).replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]


@pytest.fixture(scope="module")
def docs():
    rnd = random.Random(21)
    word = lambda lang: "".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randrange(1, 4)))
    text = lambda lang, n: " ".join(word(lang) for _ in range(n))
    langs = ["en", "de", "fr"]
    rows = [(i, text(langs[i % 3], rnd.randrange(20, 200)), langs[i % 3]) for i in range(150)]
    rows += [(200 + i, rows[i][1], rows[i][2]) for i in range(10)]  # copies
    for i in range(20):  # near copies
        w = rows[i][1].split(" ")
        w[len(w) // 2] = word("en")
        rows.append((300 + i, " ".join(w), rows[i][2]))
    rows += [(400, None, "en"), (401, "", None), (402, " \n\t", "de"), (403, "12 34 !?", "fr"), (404, text("en", 9000), "en"), (405, "ONE", "en"), (406, "one two", None), (407, "<|endoftext|> x <|im_end|>", "en"), (408, "中文 текст é", "en")]
    return rows


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(*r, "s", len(r[1] or ""), 1.5, "clash", 7) for r in docs], "doc_id long, text string, lang string, source string, n_chars long, score double, fingerprint string, n_tokens int").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(r[0], 1, 0) for r in docs if r[0] < 150], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    rnd = random.Random(5)
    vec = [(i, [rnd.gauss(0, 1) for _ in range(6)], 0) for i in range(300)] + [(300, None, 0), (350, [0.0] * 6, 0), (400, [float("nan")] * 6, 0), (450, [1.0, 2.0], 0), (451, [2.0, 1.0], 0)]
    spark.createDataFrame(vec, "vec_id long, embedding array<double>, label int").write.parquet(f"{at}/embeddings.parquet")
    return at


def test_op4_packs_every_token_once(spark, folder, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found, places = {}, {}
    for r in q.op4_best_fit_packing(spark, folder).collect():
        found.setdefault(r.doc_id, []).append(r)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(found) == {d[0] for d in docs}
    for i, t, _ in docs:
        ids, at = [*library.encode(t or "", add_special_tokens=False).ids, 2], 0
        for n, r in enumerate(sorted(found[i], key=lambda r: r.piece)):
            part = ids[at : at + r.length]
            assert (r.piece, r.start, r.ids_crc32) == (n, at, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)))
            at += r.length
        assert at == len(ids) and (len(found[i]) == -(-len(ids) // 1024))
    for seq in places.values():
        at = 0
        for offset, n in sorted(seq):
            assert offset == at
            at += n
        assert at <= 1024


def test_op5_counts_and_scores(spark, folder, docs):
    rest = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    counts, trie = {}, Trie(ORDER)
    for i, t, _ in docs:
        if not rest(i):
            for w in [*words_of(t), None]:
                counts[w] = counts.get(w, 0) + 1
            data = (t or "").translate(LOWER).encode()
            for k in range(len(data) + 1):
                trie.learn(trie.context(data, k), data[k] if k < len(data) else 256)
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in q.op5_ppm_scoring(spark, folder).collect()}
    assert set(got) == {d[0] for d in docs}
    for i, t, _ in docs:
        tokens, r = [*words_of(t), None], got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (rest(i), len(tokens), sum(w in counts for w in tokens), n), i
        assert math.isclose(r.base_score, sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in tokens), rel_tol=1e-9)
        if i < 40 or i >= 400 and i != 404:
            assert math.isclose(r.score, trie.score((t or "").translate(LOWER).encode(), False) / math.log(10), rel_tol=1e-9), i


def test_op6_fingerprints_and_components(spark, folder, docs):
    prints = {}
    for i, t, _ in docs:
        w = words_of(t)
        grams = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
    root = {i: i for i in prints}
    moved = True
    while moved:
        moved = False
        for i in prints:
            for j in prints:
                if root[j] < root[i] and (prints[i] ^ prints[j]).bit_count() <= 2:
                    root[i], moved = root[j], True
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in q.op6_simhash_near_dedup(spark, folder).collect()}
    assert got == {i: (f"{prints[i]:016x}", root[i]) for i in prints}


def test_op7_answers_every_row(spark, folder, docs):
    got = {r.doc_id: r for r in q.op7_quality_classifier(spark, folder).collect()}
    assert set(got) == {d[0] for d in docs} and not any(got[i].keep for i in (400, 401))
    assert sum(not got[i].keep for i in range(150)) <= 5


def test_op7_decides_by_the_quantiles_of_held_out_rows(spark, folder):
    """Limits and decisions from the perplexities (which test_kneser_ney holds against plain counting) by numpy's own quantiles."""
    rows = q.op7_quality_classifier(spark, folder).toPandas()
    ids = spark.range(150).select("id", F.pmod(F.xxhash64("id", F.lit("held")), F.lit(1 << 20)).alias("h")).toPandas()
    held = rows[rows.doc_id.isin(ids[ids.h < 1 << 19]["id"]) & (rows.n_bytes > 0)]
    assert 50 < len(held) < 100
    middle = {g: np.quantile(np.log(x.perplexity), 0.5) for g, x in [*held.groupby("lang"), (None, held)]}
    n = rows.n_bytes
    smoothed = (np.log(rows.perplexity) * n + rows.lang.map(lambda g: middle.get(g, middle[None])).astype(float) * kneser_ney.PRIOR) / (n + kneser_ney.PRIOR)
    assert np.allclose(smoothed, np.log(rows.smoothed), atol=2 * kneser_ney.BIN)
    s = smoothed[held.index]
    spread = np.quantile(s, kneser_ney.KEPT) - np.quantile(s, 0.5)
    limit = {None: np.quantile(s, kneser_ney.KEPT)}
    for g, x in s.groupby(held.lang):
        m = np.quantile(x, 0.5)
        limit[g] = m + (len(x) * (np.quantile(x, kneser_ney.KEPT) - m) + kneser_ney.SHRINK * spread) / (len(x) + kneser_ney.SHRINK)
    want = rows.lang.map(lambda g: limit.get(g, limit[None])).astype(float)
    assert np.allclose(np.log(rows.threshold), want, atol=4 * kneser_ney.BIN)
    clear = (smoothed - want).abs() > 6 * kneser_ney.BIN
    assert clear.mean() > 0.9 and ((smoothed <= want) & (n > 0))[clear].equals(rows.keep[clear])


def test_op8_counts_like_the_library(spark, folder, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in q.op8_token_counts(spark, folder).collect()}
    for i, t, _ in docs:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert got[i] == (len((t or "").encode()), n, n > 2048), i


def test_op9_finds_the_nearest(spark, folder):
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect() if r.embedding and all(map(math.isfinite, r.embedding)) and any(r.embedding)}
    got = {}
    for r in q.op9_hash_prefix_forest(spark, folder).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for i, x in rows.items():
        if i % 50 == 0:
            cos = lambda y, x=x: sum(a * b for a, b in zip(x, y, strict=True)) / (math.sqrt(sum(a * a for a in x)) * math.sqrt(sum(b * b for b in y)))
            best = sorted(((-cos(y), j) for j, y in rows.items() if j != i and len(y) == len(x)))[:5]
            assert [(r, j) for r, j, _ in got[i]] == [(n + 1, j) for n, (_, j) in enumerate(best)]
            assert all(math.isclose(s, -b, rel_tol=1e-12) for (_, _, s), (b, _) in zip(got[i], best, strict=True))
    assert set(got) == {i for i in rows if i % 50 == 0}


def test_op10_holds_out_a_third_and_knows_the_languages(spark, folder, docs):
    got = {r.doc_id: r for r in q.op10_language_id(spark, folder).collect()}
    right = []
    for i, t, lang in docs:
        r = got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1
        letters = any(unicodedata.category(c).startswith("L") for c in t or "")
        assert (r.lang_pred == "und") == (not letters) and r.lang_pred in ("und", "en", "de", "fr")
        if r.held_out and i < 400:
            right.append(r.lang_pred == lang)
    assert sum(right) >= 0.95 * len(right) > 20
