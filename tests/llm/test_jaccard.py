import random

import pytest
from helpers import awkward, documents, words_of

from slotscribe.llm import jaccard as op

WORD = r"[^\x20\x09-\x0D]+"


def sets_of(docs):
    out = {}
    for i, text in docs:
        w = words_of(text, WORD)
        out.setdefault(i, []).append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    return out


def brute(docs):
    sets = sets_of(docs)
    parent = {i: i for i in sets if i is not None}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(parent)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            for x in sets[a]:
                for y in sets[b]:
                    if x and y and 100 * len(x & y) >= 80 * len(x | y):
                        p, q = sorted((top(a), top(b)))
                        parent[q] = p
    return sorted(((i, len(s), top(i) if i is not None else None) for i, ss in sets.items() for s in ss), key=str)


def got(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def text(rng, n, vocabulary=60):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edited(rng, base, edits):
    w = base.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10_000)}"
    return " ".join(w)


def corpus(seed):
    """Near copies at all distances around the threshold, shared passages, short and repeated texts."""
    rng = random.Random(seed)
    passage = text(rng, 60)
    docs = [text(rng, rng.randrange(1, 80)) for _ in range(30)]
    for _ in range(6):
        base = text(rng, rng.randrange(20, 300))
        docs += [base] * 3 + [edited(rng, base, k // 2) for k in range(1, 14)] + [base.upper()]
    docs += [f"{passage} {text(rng, n)}" for n in (0, 3, 8, 12, 14, 15, 16, 20, 60, 200)]
    docs += ["a b", "A b", "a b c", "a b c d e", "a b c d e f", "", None]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    docs = corpus(seed)
    assert got(op.report(documents(spark, docs).repartition(3))) == sorted(brute(docs), key=str)


def test_frequent_order_changes_nothing(spark, monkeypatch):
    docs = corpus(3)
    monkeypatch.setattr(op, "FREQUENT_IN_TASK", 1)
    monkeypatch.setattr(op, "FREQUENT", 50)
    assert got(op.report(documents(spark, docs))) == sorted(brute(docs), key=str)


def test_one_large_group_of_near_copies(spark):
    rng = random.Random(5)
    base = text(rng, 150)
    # Each differs from the base by a little, and from one another by twice that: linked through the base alone.
    docs = list(enumerate([edited(rng, base, 3) for _ in range(250)] + [base]))
    rng.shuffle(docs)
    assert got(op.report(documents(spark, docs))) == sorted(brute(docs), key=str)


def test_threshold_is_exact(spark):
    # 9 shared of 9 + 2 shingles is 0.818, 8 of 10 is exactly 0.8, 7 of 9 is below.
    w = [f"v{k}" for k in range(40)]
    docs = [(0, " ".join(w[:12])), (1, " ".join(w[:14])), (2, " ".join(w[20:32])), (3, " ".join(w[20:34])), (4, " ".join(w[20:35]))]
    assert got(op.report(documents(spark, docs))) == sorted(brute(docs), key=str)
    assert op.linked(8, 8, 10) and not op.linked(7, 8, 8) and op.linked(8, 9, 9) and not op.linked(7, 8, 9)


def test_prefix_lemma():
    for n in range(1, 80):
        need = op.required(n)
        assert 5 * need >= 4 * n > 5 * (need - 1)
        assert op.prefix_length(n, need) == n


def test_awkward_rows(spark):
    docs = [*enumerate(awkward()), (3, "a b c d e f g h i j k l m n o p"), (20, "other text"), (20, "plain words of an ordinary text that is neither long nor short, said twice"), (None, "a b c"), (None, None), (21, "a b c")]
    want = sorted(brute(docs), key=str)
    assert got(op.report(documents(spark, docs))) == want
    assert op.report(documents(spark, []).where("false")).count() == 0


def test_keep_one(spark):
    docs = [*corpus(4), (None, "a b"), (None, "a b"), (5_000, "unique words stand here alone"), (5_000, "unique words stand here alone")]
    frame = documents(spark, docs).selectExpr("*", "1 as component_id", "2 as class")
    kept = op.keep_one(frame)
    assert kept.columns == frame.columns
    want = sorted([i for i, _, c in brute(docs) if i is not None and i == c and i != 5_000] + [5_000])
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == want
    assert kept.where("doc_id is null").count() == 2


def test_documents_that_share_a_passage_meet_seldom(spark, monkeypatch):
    """A passage of two thirds of every text: no two are similar enough, and few rows are made to find out."""
    rng = random.Random(8)
    passage = text(rng, 100)
    docs = [(i, f"{passage} {' '.join(f'x{i}y{k}' for k in range(40))}") for i in range(150)]
    met, meet = [], op.first_meetings
    monkeypatch.setattr(op, "first_meetings", lambda mixed: (met.append(meet(mixed).count()), meet(mixed))[1])
    out = got(op.report(documents(spark, docs)))
    assert out == [(i, 136, i) for i, _ in sorted(docs, key=lambda d: str((d[0], 136, d[0])))]
    assert met and met[0] <= 150 * 149 // 2
