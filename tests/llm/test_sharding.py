import zlib

import numpy as np
import pytest
from helpers import awkward, documents, rows

from slotscribe.llm import sharding as op


def test_matrix_sums_are_exact():
    counts, sizes = [5, 0, 17, 1, 977], [125] * 8
    m = op.communication_matrix(counts, sizes)
    assert m.sum(axis=1).tolist() == counts and m.sum(axis=0).tolist() == sizes and (m >= 0).all()


@pytest.mark.parametrize("good,bad,n", [(3_000_000_000, 5_000_000_000, 1_000_000), (10, 2_000_000_000, 1_500_000_000), (1_500_000_000, 3, 1_500_000_000)])
def test_large_draws_follow_the_law(good, bad, n):
    rng = np.random.default_rng(1)
    drawn = np.array([op.draw_hypergeometric(rng, good, bad, n) for _ in range(400)])
    mean, total = n * good / (good + bad), good + bad
    spread = (n * good / total * bad / total * (total - n) / max(1, total - 1)) ** 0.5
    assert max(0, n - bad) <= drawn.min() and drawn.max() <= min(n, good)
    assert abs(drawn.mean() - mean) < 5 * spread / 20 + 0.6
    assert spread < 2 or 0.8 < drawn.std() / spread < 1.2


def test_large_draws_agree_with_small_ones(monkeypatch):
    small = [op.draw_hypergeometric(np.random.default_rng(s), 40, 60, 30) for s in range(3_000)]
    monkeypatch.setattr(op, "NUMPY_LIMIT", 10)
    rng = np.random.default_rng(5)
    large = [op.draw_hypergeometric(rng, 40, 60, 30) for _ in range(3_000)]
    assert abs(np.mean(small) - np.mean(large)) < 0.3 and abs(np.std(small) - np.std(large)) < 0.2


def test_every_row_once_sizes_exact_slots_gapless(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK_ROWS", 7)
    texts = awkward() * 12 + ["copy"] * 300
    docs = documents(spark, texts).repartition(5)
    out = op.report(docs).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == sorted(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in enumerate(texts)
    )
    by_shard = {s: sorted(r["slot"] for r in out if r["shard"] == s) for s in range(8)}
    assert all(slots == list(range(len(slots))) for slots in by_shard.values())
    sizes = [len(s) for s in by_shard.values()]
    assert max(sizes) - min(sizes) <= 1
    assert {r["law"] for r in out} == {"rows"} and {r["grown_shard"] for r in out} == {None}
    # Copies are spread like everything else.
    copies = [sum(1 for r in out if r["shard"] == s and r["text_crc32"] == zlib.crc32(b"copy")) for s in range(8)]
    assert min(copies) > 15


def test_order_is_random(spark):
    docs = documents(spark, [f"t{i}" for i in range(4_000)])
    out = op.shuffle(docs.select("doc_id"), 4).orderBy("shard", "slot").collect()
    ids = np.array([r["doc_id"] for r in out], float)
    assert abs(np.corrcoef(ids[1:], ids[:-1])[0, 1]) < 0.08


def test_repeated_rows_other_columns_and_empty_table(spark):
    docs = documents(spark, [(7, "same")] * 20 + [(None, None)] * 3).selectExpr("*", "'x' as part__", "'y' as block__")
    out = op.shuffle(docs, 3)
    assert out.columns == [*docs.columns, "shard", "slot"]
    assert rows(out, *docs.columns) == rows(docs)
    assert op.report(documents(spark, []).where("false")).count() == 0
    assert sorted(r["shard"] for r in op.shuffle(docs.limit(2), 8).collect()) == [0, 1]
