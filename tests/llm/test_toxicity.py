import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import awkward, documents

from slotscribe.llm import toxicity as op


def brute_segments(scores):
    """Maximal scoring subsequences by definition: best segment, then left and right of it."""
    best, at = 0.0, None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > best + 1e-9:
                best, at = total, (i, j + 1)
    if at is None:
        return []
    left, right = brute_segments(scores[: at[0]]), brute_segments(scores[at[1] :])
    return [*left, (at[0], at[1], best), *((a + at[1], b + at[1], s) for a, b, s in right)]


@pytest.mark.parametrize("seed", range(30))
def test_segments_equal_the_definition(seed):
    rng = random.Random(seed)
    scores = np.array([rng.randint(-5, 4) + rng.random() for _ in range(rng.randrange(0, 40))])
    got, want = op.maximal_segments(scores), brute_segments(scores)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want])


def corpus(seed, n=1_500):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("abdeinorst") for _ in range(rng.randrange(2, 9))) for _ in range(1_500)]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(plain) for _ in range(rng.randrange(30, 200))]
        toxic = rng.random() < 0.15
        if toxic:
            for _ in range(rng.randrange(2, 6)):
                w[rng.randrange(len(w))] = rng.choice(["vilex", "grumpx", f"scorx{rng.choice(plain)}"])
        docs.append((i, " ".join(w)))
        if rng.random() < 0.7:
            labels.append((i, 1, int(toxic)))
        docs[-1] = (*docs[-1], toxic)
    return docs, labels


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_held_out_accuracy_and_columns(spark):
    docs, labels = corpus(1)
    out = {r["doc_id"]: r for r in op.report(documents(spark, [d[:2] for d in docs]), labelled(spark, labels)).collect()}
    assert len(out) == len(docs)
    for i, _, _ in docs:
        assert out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= out[i]["score"] <= 1 and out[i]["predicted"] == int(out[i]["score"] >= 0.3)
    held = [(toxic, out[i]["predicted"]) for i, _, toxic in docs if out[i]["held_out"]]
    assert sum(p for t, p in held if t) >= 0.95 * sum(t for t, _ in held)
    assert sum(p for t, p in held if not t) <= 0.03 * len(held)


def test_held_out_labels_teach_nothing(spark):
    docs, labels = corpus(2, 400)
    frame = documents(spark, [d[:2] for d in docs])
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels]
    scores = [sorted(tuple(r) for r in op.report(frame, labelled(spark, x)).collect()) for x in (labels, flipped)]
    assert scores[0] == scores[1]


def test_passages_point_at_the_words(spark):
    docs, labels = corpus(3)
    model = op.fit(documents(spark, [d[:2] for d in docs]), labelled(spark, labels))
    text = " ".join([*docs[0][1].split()[:40], "vilex grumpx vilex", *docs[1][1].split()[:40]])
    found = model.passages(op.words(text))
    assert any(a <= 40 and b >= 43 and b - a < 15 for a, b, _ in found)


def test_awkward_texts_and_labels(spark):
    docs, labels = corpus(4, 300)
    n = len(docs)
    all_docs = [*[d[:2] for d in docs], *((n + i, t) for i, t in enumerate(awkward())), (None, "vilex"), (3, "vilex"), (3, "vilex")]
    all_labels = [*labels, (n + 1, None, 1), (n + 2, None, None), (None, 1, 1), (99_999, 1, 1), labels[0]]
    frame = documents(spark, all_docs).selectExpr("*", "1 as score", "2 as toxicity", "3 as fold", "4 as toxic")
    assert op.report(frame, labelled(spark, all_labels)).count() == len(all_docs)
    kept = op.keep_civil(frame, labelled(spark, all_labels))
    assert kept.columns == frame.columns and 0 < kept.count() < len(all_docs)
    assert kept.where("text is null or text = ''").count() == frame.where("text is null or text = ''").count()


def test_nothing_to_learn_from(spark):
    docs = documents(spark, ["a b", "c d", None])
    for rows in ([], [(0, 1, 0)], [(0, 1, 1), (1, 1, 1)]):
        assert {r["score"] for r in op.report(docs, labelled(spark, rows)).collect()} == {0.0}
    assert op.report(docs.where("false"), labelled(spark, [(0, 1, 1)])).count() == 0


def test_tail_law():
    rng = np.random.default_rng(1)
    scores = rng.choice([-1.0, 1.0], p=[0.75, 0.25], size=200_000)
    best = [(200, max([0, *(s for _, _, s in op.maximal_segments(scores[k : k + 200]))])) for k in range(0, 100_000, 200)]
    decay, scale = op.fit_tail(best, scores)
    # E[exp(lambda x)] = 1 has the root ln 3 here.
    assert decay == pytest.approx(np.log(3), abs=0.05) and scale > 0


def brute_scores(docs, labels):
    """Every document's score, step by step in plain Python."""
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    forms = lambda w: [*(w[:n] + "*" for n in (4, 5, 6) if len(w) > n), w]
    text, part = dict(docs), {i: zlib.crc32(str(i).encode()) % 4 for i, _ in docs}
    seen = {0: Counter(), 1: Counter()}
    for i, _, toxic in labels:
        if part[i] in (0, 1):
            seen[toxic].update(f for w in words(text[i]) for f in forms(w))
    corpus = Counter(f for t in text.values() for w in words(t) for f in forms(w))
    total = [sum(n for f, n in seen[k].items() if f[-1] != "*") for k in (0, 1)]
    everything, odds = sum(n for f, n in corpus.items() if f[-1] != "*"), {}
    for f in sorted((f for f, n in seen[1].items() if n >= 2), key=lambda f: (f[-1] != "*", len(f))):
        stem = f.rstrip("*")
        above = [odds[stem[:n] + "*"] for n in (6, 5, 4) if n < len(stem) and stem[:n] + "*" in odds]
        even = 1 / (1 + math.exp(-above[0])) if above else 0.5
        weight = 1 + 1_000 * corpus[f] / everything
        odds[f] = math.log((seen[1][f] + 2 * weight * even) / (seen[0][f] * total[1] / total[0] + 2 * weight * (1 - even)))

    def rate(t):
        return [next((odds[f] for f in reversed(forms(w)) if f in odds), 0.0) - 1.5 for w in words(t)]

    held = [(rate(text[i]), toxic) for i, _, toxic in labels if part[i] == 3]
    spread = [x for r, toxic in held if not toxic for x in r]
    low, high = 1e-3, 20.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(math.exp(middle * x) for x in spread) < len(spread) else (low, middle)
    # Without a good word in clean texts the law has no root, and lambda is 1.
    decay = (low + high) / 2 if max(spread) > 0 else 1.0
    tops = [(len(r), max((s for _, _, s in brute_segments(r)), default=0.0)) for r, toxic in held if not toxic]
    scale = len(tops) / sum(n * math.exp(-decay * s) for n, s in tops)

    def evidence(r):
        rated = [decay * s - math.log(scale * len(r)) for _, _, s in brute_segments(r)]
        return math.log1p(sum(x for x in rated if x > -math.log(0.05)))

    x, y = np.array([evidence(r) for r, _ in held]), np.array([t for _, t in held])
    slope, offset = 0.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * x + offset, -30, 30)))
        v = p * (1 - p)
        g = np.array([(x * (y - p)).sum() - 0.01 * slope, (y - p).sum() - 0.01 * offset])
        h = np.array([[(v * x * x).sum() + 0.01, (v * x).sum()], [(v * x).sum(), v.sum() + 0.01]])
        slope, offset = np.array([slope, offset]) + np.linalg.inv(h) @ g
    return {i: 1 / (1 + math.exp(-(slope * evidence(rate(t)) + offset))) for i, t in docs}


@pytest.mark.parametrize("mild", [False, True])
def test_scores_equal_brute_force(spark, mild):
    docs, labels = corpus(5, 500)
    rng = random.Random(6)
    # With mild ones, some clean texts use a toxic word too.
    docs = [(i, t + " grumpx" * (mild and not toxic and i % 7 == 0)) for i, t, toxic in docs]
    # A text with far more words and segments than the others takes part in the fit as a whole.
    long = next(i for i, _, toxic in labels if toxic and zlib.crc32(str(i).encode()) % 4 == 3)
    docs[long] = (long, " ".join(rng.choice(["vilex", "grumpx", *docs[0][1].split()[:12]]) for _ in range(1_500)))
    want = brute_scores(docs, labels)
    got = {r["doc_id"]: r["score"] for r in op.report(documents(spark, docs), labelled(spark, labels)).collect()}
    assert got.keys() == want.keys()
    for i, p in want.items():
        assert got[i] == pytest.approx(p, abs=1e-6)


def test_law_sees_every_word(spark):
    model = op.Model(odds={"vilex": 3.0, "grumpx": 2.5})
    texts = [("vilex " + "plain " * 999) * 20, None, "", "grumpx grumpx"]
    rows = spark.createDataFrame([(t, 0) for t in texts], "t string, toxic int")
    counted = {r["score"]: r["n"] for r in op.word_scores(rows, model).collect()}
    assert counted == {1.5: 20, -1.5: 19_980, 1.0: 2}
    many = spark.createDataFrame([("vilex plain plain " * 3_000, 1)], "t string, toxic int")
    bound = -math.log(op.SIGNIFICANT)
    model.scale = math.exp(1.5 - 2 * bound) / 9_000
    assert op.evidence_of(many, model).first()["evidence"] == pytest.approx(3_000 * 2 * bound)
