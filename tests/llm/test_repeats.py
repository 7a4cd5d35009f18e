import random

import numpy as np
import pytest
from helpers import awkward, documents, sha

from slotscribe.llm import repeats as op


def brute(docs):
    least = {}
    for i, text in docs:
        raw = (text or "").encode()
        for p in range(len(raw) - 49):
            if i is not None:
                g = raw[p : p + 50]
                least[g] = min(least.get(g, i), i)
    out = []
    for i, text in docs:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 49):
            if i is not None and least[raw[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        runs = sum(1 for k, x in enumerate(gone) if x and (k == 0 or not gone[k - 1]))
        out.append((i, len(raw), sum(gone), runs, sha(bytes(b for b, x in zip(raw, gone) if not x))))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


def noise(rng, n):
    return "".join(rng.choice("abcdefgh éß") for _ in range(n))


def corpus(seed):
    """Passages shared at every offset and length around 50 bytes, copies, edits, periodic texts."""
    rng = random.Random(seed)
    passage = noise(rng, 300)
    docs = [noise(rng, rng.randrange(0, 400)) for _ in range(20)]
    for n in (30, 47, 48, 49, 50, 51, 52, 60, 75, 99, 150, 250):
        a = rng.randrange(0, 300 - n + 1)
        docs.append(noise(rng, rng.randrange(80)) + passage[a : a + n] + noise(rng, rng.randrange(80)))
    for _ in range(5):
        w = list(noise(rng, 500))
        docs += ["".join(w)] * 2
        for _ in range(5):
            w[rng.randrange(500)] = "X"
            docs.append("".join(w))
    docs += ["ab" * 100, "ab" * 60 + "c" + "ab" * 70, "z" * 200, "z" * 49, "z" * 50, passage + passage, "", None]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    docs = corpus(seed)
    assert got(op.report(documents(spark, docs).repartition(4))) == brute(docs)


def test_small_units_ranges_and_chunks(spark, monkeypatch):
    docs = corpus(3)
    monkeypatch.setattr(op, "UNIT_BYTES", 700)
    monkeypatch.setattr(op, "RANGE_ANCHORS", 40)
    monkeypatch.setattr(op, "CHUNK_BYTES", 300)
    assert got(op.report(documents(spark, docs).repartition(3))) == brute(docs)


def test_one_passage_in_most_documents(spark):
    rng = random.Random(9)
    line = noise(rng, 120)
    docs = list(enumerate(noise(rng, rng.randrange(60)) + line[rng.randrange(30) :] + noise(rng, rng.randrange(60)) for _ in range(400)))
    assert got(op.report(documents(spark, docs).repartition(4))) == brute(docs)


def test_fragments_at_the_edge_of_a_shared_passage_are_told_apart(spark):
    # Before the passage all differ, under one anchor with equal sides: 24 bits of hash had about 20,000^2 / 2^25 false copies here.
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefgh") for _ in range(160))
    docs = list(enumerate("".join(rng.choice("abcdefghijklmnop") for _ in range(40)) + passage for _ in range(20_000)))
    assert got(op.report(documents(spark, docs).repartition(4))) == brute(docs)


def test_no_task_holds_all_fragments_of_a_hot_anchor(spark, monkeypatch):
    rng = random.Random(6)
    passage = noise(rng, 160)
    docs = list(enumerate(noise(rng, 30) + passage + noise(rng, 30) for _ in range(600)))
    docs += [(i + 600, text[rng.randrange(20) :]) for i, text in docs[:100]]
    monkeypatch.setattr(op, "CHUNK_BYTES", 4_000)
    # What is sorted together is what answer() is given of one anchor.
    sizes, usual = [], op.answer
    def watched(sent, partitions):
        sizes.extend(r["n"] for r in sent.selectExpr("anchor", "length(piece) as n").groupBy("anchor").agg({"n": "sum"}).toDF("anchor", "n").collect())
        return usual(sent, partitions)
    monkeypatch.setattr(op, "answer", watched)
    assert got(op.report(documents(spark, docs).repartition(4))) == brute(docs)
    assert sizes and max(sizes) <= 4_000


def test_awkward_rows(spark):
    docs = [*enumerate(t for t in awkward() if t is None or len(t) < 25_000), (3, "y" * 80), (3, "y" * 90), (60, "q" * 70 + "y" * 85), (None, "y" * 80), (None, None)]
    frame = documents(spark, docs).selectExpr("*", "1 as n_removed", "'x' as rid", "2 as codes", "3 as range")
    assert got(op.report(frame)) == brute(docs)
    assert op.report(frame.where("false")).count() == 0


def test_nearest_smaller_values():
    rng = np.random.default_rng(0)
    for values in ([], [1], list(range(50)), list(range(50))[::-1], rng.integers(0, 6, 200).tolist()):
        want = [max((j for j in range(i) if values[j] < v), default=-1) for i, v in enumerate(values)]
        assert op.nearest_smaller(np.array(values, np.int64)).tolist() == want


def test_suffix_ranks_order_the_strings():
    text = np.frombuffer(noise(random.Random(1), 400).encode() + b"ab" * 90, np.uint8)
    ranks = op.suffix_ranks(text)
    strings = [text[k : k + 50].tobytes() for k in range(len(ranks))]
    assert len(ranks) == len(text) - 49
    order = sorted(range(len(strings)), key=strings.__getitem__)
    assert all((ranks[a] < ranks[b]) == (strings[a] < strings[b]) for a, b in zip(order, order[1:]))


def test_suffix_ranks_of_some_places_order_their_strings():
    text = np.frombuffer(noise(random.Random(2), 300).encode() + b"ab" * 90, np.uint8)
    places = np.r_[np.arange(3, 40), np.arange(200, 215), np.arange(310, len(text) - 49)]
    strings = [text[k : k + 50].tobytes() for k in places]
    assert op.suffix_ranks(text, places).tolist() == [sorted(set(strings)).index(x) for x in strings]


def test_bytes_under_an_anchor_are_those_of_its_fragments(spark):
    raw = bytes(range(200))
    shown = np.array([[7, 0, 5, op.ASKS], [8, 10, 10, op.SHOWS], [7, 60, 90, op.SHOWS]], np.int64)
    rows = [(1, 10, 200, b"", raw, shown.tobytes(), None), (2, 11, 200, b"", raw, shown[:1].tobytes(), None), (3, 12, 200, b"", None, b"", "x")]
    placed = spark.createDataFrame(rows, op.PLACED)
    assert sorted(map(tuple, op.sent_bytes(placed).collect())) == [(7, 55 + 80 + 55), (8, 50)]
    under = lambda inside: sorted((r["anchor"], r["rid"], r["doc_id"], r["first"], r["asks"], bytes(r["piece"])) for r in op.fragments(placed, [8], inside).collect())
    assert under(True) == [(8, 1, 10, 10, False, raw[10:60])]
    assert under(False) == [(7, 1, 10, 0, True, raw[:55]), (7, 1, 10, 60, False, raw[60:140]), (7, 2, 11, 0, True, raw[:55])]
