import random
import re
import time
import zlib

import numpy as np
import pytest
from helpers import awkward, documents, rows, sha
from hypothesis import given, settings
from hypothesis import strategies as st

from slotscribe.llm import periodic as op


def brute(words, least=24, turns=3):
    """Every run, from every period in turn: the stretches on which words q apart agree."""
    n, stretches = len(words), {}
    for q in range(1, n // turns + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i:
                start, length = i, j - i + q
                if length >= max(least, turns * q):
                    stretches.setdefault((start, length), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in stretches.items())


def runs(words, **limits):
    ids = np.unique(np.array(words, dtype=object).astype(str), return_inverse=True)[1] if words else np.zeros(0, int)
    return op.find_runs(ids.astype(np.int64), **limits)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(3, 9))
def test_all_runs_of_short_texts(words, least):
    assert runs(words, least_words=least) == brute(words, least)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 12)), max_size=6))
def test_runs_of_repeated_phrases(parts):
    words = [w for phrase, k in parts for w in phrase * k]
    assert runs(words) == brute(words)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 1), max_size=50), max_size=6), st.integers(3, 17))
def test_the_filter_misses_no_repeat(texts, depth):
    words = [[b"%d" % w for w in t] for t in texts]
    got = op.repeats_within(*op.numbered(words), depth)
    for t, found in zip(texts, got):
        grams = [tuple(t[i : i + depth]) for i in range(len(t) - depth + 1)]
        assert found == (len(set(grams)) < len(grams))


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    dropped = {k for s, length, q in found for k in range(s + q, s + length)}
    top = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None, None, None)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    exponent = 1000 * top[1] // top[2] if found else None
    return (doc_id, len(found), *top, exponent, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(kept))


def test_report_equals_brute_force(spark):
    rng = random.Random(3)
    texts = [t for t in awkward() if len(t or "") < 100_000]
    for _ in range(150):
        pieces = [" ".join(rng.choice("abcde") for _ in range(rng.randrange(1, 8))) + rng.choice([" ", "  ", "\n", " "]) for _ in range(3)]
        texts.append("".join(rng.choice(pieces) * rng.randrange(1, 20) for _ in range(4)))
    docs = documents(spark, [*enumerate(texts), (5, "a b " * 40), (5, "a b " * 40)], "").selectExpr("*", "1 as n_runs", "'x' as `start`")
    got = {r: 1 for r in rows(op.report(docs))}
    assert sorted(got, key=str) == sorted({expected(i, t) for i, t in [*enumerate(texts), (5, "a b " * 40)]}, key=str)
    assert op.report(docs).count() == len(texts) + 2


def test_sample_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 9000")
    want = [expected(r["doc_id"], r["text"]) for r in docs.collect()]
    assert any(w[1] for w in want)
    assert rows(op.report(docs)) == sorted(want, key=lambda r: tuple((x is None, str(x)) for x in r))


def test_long_texts_take_linear_time():
    start = time.time()
    assert op.find_runs(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]
    phrase = np.arange(50_000)
    assert op.find_runs(np.concatenate([phrase] * 4)) == [(0, 200_000, 50_000)]
    # Many places with many left words: no pairs of a group are listed.
    passage = np.arange(20)
    spread = np.concatenate([np.r_[passage, 100 + i] for i in range(10_000)])
    assert op.find_runs(spread) == []
    assert time.time() - start < 60


def test_general_functions(spark):
    phrase = "one two three four "
    docs = documents(spark, ["before " + phrase * 9 + "after", None, "", "plain  text", "word " * 500])
    found = {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in op.find(docs).collect()}
    assert found == {0: [(1, 36, 4)], 1: [], 2: [], 3: [], 4: [(0, 500, 1)]}
    cut = op.collapse(docs)
    assert cut.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == {0: "before one two three four after", 1: None, 2: "", 3: "plain  text", 4: "word"}
    with pytest.raises(ValueError):
        op.find(docs.selectExpr("*", "1 as Runs"))


def test_null_ids_and_empty_table(spark):
    docs = documents(spark, [(None, "x " * 30), (None, None)])
    assert [(r["n_runs"], r["length"]) for r in op.report(docs).orderBy("n_runs").collect()] == [(0, None), (1, 30)]
    assert op.report(docs.where("false")).collect() == []
