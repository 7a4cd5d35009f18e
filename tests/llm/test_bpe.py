import base64

import pytest
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from helpers import awkward, documents, sha

from slotscribe.llm import bpe as op

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def judge():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("judge", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def tokenizer():
    return op.Tokenizer(op.read_ranks(PATH), public_tokenizers.PATTERN)


def test_perfect_hash_is_minimal_and_exact():
    keys = [f"key {i}".encode() for i in range(5_000)]
    ph = op.PerfectHash(keys)
    assert sorted(ph.slots(keys)) == list(range(5_000))
    assert set(ph.slots([k + b"!" for k in keys])) == {-1}
    assert op.PerfectHash([]).slots([b"a"]) == [-1] and op.PerfectHash([b"a"]).slots([b"a", b"b"]) == [0, -1]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text_like_the_library(judge, tokenizer, text):
    text = text.encode("utf-8", "ignore").decode()
    (ids,) = tokenizer.encode([text])
    assert ids == judge.encode_ordinary(text)
    assert tokenizer.decode(ids) == text.encode()


def test_forgetting_changes_nothing(judge, monkeypatch):
    import pickle

    monkeypatch.setattr(op, "REMEMBERED", 6)
    monkeypatch.setattr(op, "LONGEST", 5)
    tokenizer = pickle.loads(pickle.dumps(op.Tokenizer(op.read_ranks(PATH), public_tokenizers.PATTERN)))
    texts = ["one two three four", "abcdefghijk two", "", "one two three four five six seven eight nine ten", "two abcdefghijk"] * 3
    for text, ids in zip(texts, tokenizer.encode(texts)):
        assert ids == judge.encode_ordinary(text)
        assert tokenizer.listed(text) == (",".join(map(str, ids)).encode(), text.encode())
        assert len(tokenizer.known) <= 12


def test_query_equals_library(spark, judge):
    texts = [*awkward(), "<|endoftext|> it's   spaced \n\n out", "ab" * 5_000 + "漢" * 3_000]
    got = {r["doc_id"]: tuple(r)[1:] for r in op.report(documents(spark, texts), PATH, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = judge.encode_ordinary(t or "")
        assert got[i] == (len(ids), sha(",".join(map(str, ids))), sha(t or ""))


def test_round_trip_columns_and_empty_table(spark, judge):
    docs = documents(spark, awkward()).selectExpr("*", "1 as n_tokens")
    out = op.decode(op.encode(docs, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN)
    assert out.columns == [*docs.columns, "ids", "decoded"]
    for r in out.collect():
        assert r["ids"] == judge.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()
    listed = {r["doc_id"]: r["ids"] for r in op.tokenized(docs, PATH, public_tokenizers.PATTERN).collect()}
    assert listed == {i: judge.encode_ordinary(t or "") for i, t in enumerate(awkward())}
    assert op.report(docs.where("false"), PATH, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(ValueError):
        op.encode(docs, PATH, public_tokenizers.PATTERN, ids_col="text")


def test_cache_starts_anew(judge, monkeypatch):
    monkeypatch.setattr(op, "REMEMBERED", 5)
    t = op.Tokenizer(op.read_ranks(PATH), public_tokenizers.PATTERN)
    texts = ["one two three four five six seven", "one eight nine ten", "zzzqqq xxxyyy one"]
    assert list(t.encode(texts)) == [judge.encode_ordinary(x) for x in texts]


def test_missing_bytes_are_an_error():
    with pytest.raises(ValueError):
        list(op.Tokenizer({b"a": 0}, r"\w+").encode(["ab"]))
