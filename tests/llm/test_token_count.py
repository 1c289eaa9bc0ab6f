import public_tokenizers
from tokenizers import Tokenizer

from keyloom.llm.token_count import count_tokens, counter

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_counts_equal_the_library(as_docs, odd_texts):
    lib = Tokenizer.from_file(PATH)
    got = {r.doc_id: r for r in count_tokens(as_docs(odd_texts), PATH).collect()}
    assert len(got) == len(odd_texts)
    for i, t in enumerate(odd_texts):
        want = len(lib.encode(t or "", add_special_tokens=False).ids)
        assert got[i].n_tokens == want, (i, t)
        assert got[i].n_bytes == len((t or "").encode())
        assert got[i].over_limit == (want > 2048)


def test_limit_and_repeated_rows(as_docs):
    rows = count_tokens(as_docs(["a b c", "a b c", None], ids=[1, 1, None]), PATH, limit=2).collect()
    assert sorted((r.n_tokens, r.over_limit) for r in rows) == [(0, False), (3, True), (3, True)]


def test_empty_table(as_docs):
    assert count_tokens(as_docs([]), PATH).collect() == []


def test_long_word_is_merged_whole():
    c = counter(PATH)
    assert c.merged(b"ab" * 50_000) == len(Tokenizer.from_file(PATH).encode("ab" * 50_000, add_special_tokens=False).ids)
