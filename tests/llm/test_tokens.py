"""Cached token counts against the library on whole texts."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioflow.llm import tokens
from folioflow.llm._store import work_dir

P = pytest.importorskip("public_tokenizers")
SPEC = tokens.read_spec(P.path("word_bpe_49k.json"))
COUNT = tokens.counter(SPEC, tokens.tokenizer_version(SPEC))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet="aB é́'sS  \t\n<|endoftx>1２", max_size=60))
def test_counts_equal_the_library(text):
    assert COUNT([tokens.normalised(text.encode())]) == tokens.brute_counts([text], SPEC)


def test_special_strings():
    texts = ["<|endoftext|>", "a<|startoftext|>b <|ENDOFTEXT|>", "<|endof text|>", " <|endoftext|> <|endoftext|>"]
    assert COUNT([tokens.normalised(t.encode()) for t in texts]) == tokens.brute_counts(texts, SPEC)


def test_cache(spark):
    texts = ["a b", "a  b\n", None, "", "x" * 50_000, "a b", "été"]
    df = spark.createDataFrame([(k, t, "v") for k, t in enumerate(texts)] + [(None, "a b", "v")], "doc_id long, text string, version string")
    cache = work_dir(spark, "tokens")
    got = {r["doc_id"]: r for r in tokens.count_tokens(df, ["doc_id"], cache, SPEC).collect()}
    want = tokens.brute_counts([*texts, "a b"], SPEC)
    assert [got[k]["n_tokens"] for k in range(len(texts))] + [got[None]["n_tokens"]] == want
    assert got[6]["n_bytes"] == 5 and got[2]["n_bytes"] == 0
    stored = spark.read.parquet(cache)
    assert stored.count() == 4  # "a b" in two spellings, the empty text, the long one, one accented
    tokens.fill_cache(df, cache, SPEC)
    assert spark.read.parquet(cache).count() == 4  # nothing was missing
    assert tokens.count_tokens(df.limit(0), ["doc_id"], work_dir(spark, "tokens"), SPEC).count() == 0


def test_memo_keeps_what_comes_again():
    asked = []

    def lengths(words):
        asked.append(sorted(words))
        return [len(w) for w in words]

    memo = tokens.Memo(words=3, size=1000)
    for words in ({b"a", b"bb"}, {b"a", b"c"}, {b"a", b"d", b"e"}, {b"a", b"f", b"g", b"h", b"i"}):
        assert memo.lookup(words, lengths) == {w: len(w) for w in words}
        assert len(memo.new) <= 3 and len(memo.old) <= 3
    assert asked[0] == ["a", "bb"] and all("a" not in x for x in asked[1:])
    long = tokens.Memo(words=10, size=8)
    assert long.lookup({b"x" * 100, b"y"}, lengths) == {b"x" * 100: 100, b"y": 1} and not long.new


def test_hot_digest_and_small_memo(spark, monkeypatch):
    monkeypatch.setattr(tokens, "HOT", 4)
    monkeypatch.setattr(tokens, "SEEN", 2)
    texts = ["hot text"] * 30 + [f"own {k}" for k in range(20)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(df, ["doc_id"], work_dir(spark, "tokens"), SPEC).collect()}
    assert [got[k] for k in range(len(texts))] == tokens.brute_counts(texts, SPEC)


def test_registered_query(spark, tmp_path):
    from folioflow.llm.queries import op5_token_counts

    texts = ["a b", None, "", "word " * 3000, "été", "a b"]
    spark.createDataFrame([(k, t, 9) for k, t in enumerate(texts)], "doc_id long, text string, n_tokens int").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op5_token_counts(spark, str(tmp_path)).collect()}
    want = tokens.brute_counts(texts, SPEC)
    assert [(got[k]["n_bytes"], got[k]["n_tokens"], got[k]["over_limit"]) for k in range(6)] == [(len((t or "").encode()), n, n > 2048) for t, n in zip(texts, want, strict=True)]
