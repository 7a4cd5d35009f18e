import numpy as np
import pytest

from slotscribe.llm import neighbours as op

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(vectors, queries, k=10):
    out = []
    for q, x in queries:
        near = sorted((float(np.sqrt(((np.array(x, float) - np.array(y, float)) ** 2).sum())), i) for i, y in vectors if i != q and len(y) == len(x))
        out += [(q, n + 1, i, d) for n, (d, i) in enumerate(near[:k])]
    return out


def found(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


def same(got, want):
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("shard_rows", [30, 10_000])
def test_factor_one_is_exact_with_ties_and_copies(spark, shard_rows):
    rng = np.random.default_rng(3)
    # A small grid: many equal distances; a third of all rows are one vector.
    data = [(i, [float(x) for x in rng.integers(-1, 2, 4)]) for i in range(240)]
    data += [(i, [1.0, 0.0, 0.0, 1.0]) for i in range(240, 360)]
    data = [(i, v) for i, v in data if any(v)]
    df = spark.createDataFrame([(i, v, 0) for i, v in data], SCHEMA)
    queries = [(i, v) for i, v in data if i % 20 == 0]
    got = found(op.search(df, df.where("vec_id % 20 = 0"), factor=1.0, shard_rows=shard_rows))
    same(got, brute(data, queries))


def test_clustered_vectors_are_pruned_and_exact():
    rng = np.random.default_rng(4)
    data = np.concatenate([rng.normal(c * 10, 0.3, (400, 8)) for c in range(8)])
    tree = op.VantageTree(data, np.arange(len(data)))
    looked, take = [0], tree._take
    tree._take = lambda leaf, q, active, best, rows: (looked.__setitem__(0, looked[0] + len(leaf) * len(active)), take(leaf, q, active, best, rows))
    _, rows = tree.search(data[::40], 5)
    assert looked[0] < 0.3 * len(data) * len(data[::40])
    want = np.argsort(op.distances(data[::40], data), axis=1, kind="stable")[:, :5]
    assert (rows == want).all()


def test_clustered_vectors_are_asked_in_few_shards(spark):
    rng = np.random.default_rng(5)
    table = np.concatenate([rng.normal(size=6) * 30 + rng.normal(0, 0.2, (100, 6)) for _ in range(16)])
    data = [(i, x) for i, x in enumerate(table.astype(np.float32).tolist())]
    df = spark.createDataFrame([(i, x, 0) for i, x in data], SCHEMA)
    same(found(op.search(df, df.where("vec_id % 20 = 0"), shard_rows=50)), brute(data, data[::20]))
    entries = op.usable(df, "vec_id", "embedding").selectExpr("vec", "dim", "array(id) as ids")
    layout, shards = op.lay_out(entries, 50)
    assert shards >= 32
    placed = op.deal(entries, layout).collect()
    assert len(placed) == len(data) and {r["shard"] for r in placed} <= set(range(shards))
    asked = op.usable(df.where("vec_id % 20 = 0"), "vec_id", "embedding")
    # Within a limit that holds a cluster, a query goes to the groups of its cluster.
    sent = op.send(asked.selectExpr("*", "2D as limit"), layout, 1.0, False).count()
    assert sent < 0.15 * shards * asked.count()


def test_lengths_that_the_sample_lacks_are_searched_too(spark, monkeypatch):
    rng = np.random.default_rng(6)
    data = [(i, [float(x) for x in rng.integers(-9, 10, 2 + i % 3)]) for i in range(300)]
    data = [(i, v) for i, v in data if any(v)]
    df = spark.createDataFrame([(i, v, 0) for i, v in data], SCHEMA)
    monkeypatch.setattr(op, "TOP_SAMPLE", 1)
    same(found(op.search(df, df.where("vec_id % 7 = 0"), shard_rows=40)), brute(data, [d for d in data if d[0] % 7 == 0]))


def test_recall_of_the_query(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    data = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    want = brute(data, [d for d in data if d[0] % 100 == 0])
    got = found(op.report(table))
    assert len(got) == len(want)
    assert len({(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in want}) >= 0.9 * len(want)


@pytest.mark.parametrize("rank", [1, 2, 8, 16])
def test_recall_of_the_query_on_low_rank_vectors(spark, rank):
    rng = np.random.default_rng(rank)
    table = rng.normal(size=(4_000, rank)) @ rng.normal(size=(rank, 64))
    data = [(i, x) for i, x in enumerate(table.astype(np.float32).tolist())]
    got = found(op.report(spark.createDataFrame([(i, x, 0) for i, x in data], SCHEMA)))
    same(got, brute(data, data[::100]))


def test_unusable_vectors_repeats_and_few_candidates(spark):
    rows = [
        (0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (100, None, 1), (200, [0.0, 0.0], 1), (300, [float("nan"), 1.0], 1), (400, [None, 1.0], 1),
        (500, [float("inf"), 1.0], 1), (600, [], 1), (7, [0.0, 1.0], 1), (8, [1.0, 1.0], None), (9, [1.0, 1.0, 1.0], 1), (None, [1.0, 2.0], 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    same(found(op.report(df)), [(0, 1, 8, 1.0), (0, 2, 7, 2**0.5)])
    assert op.report(df.where("false")).count() == 0
    assert op.report(df.where("vec_id = 0")).count() == 0
