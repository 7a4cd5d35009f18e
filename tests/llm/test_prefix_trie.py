import random
import zlib
from collections import defaultdict

import pytest
from helpers import rows, sha
from pyspark.sql import functions as F

from slotscribe.llm import prefix_trie as op

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, place int"


def table(spark, given):
    return spark.createDataFrame([(*g, "x", 1) for g in given], SCHEMA)


def expected(given):
    turns = defaultdict(list)
    for c, t, role, text in given:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((t is not None, t or 0, sha(f"{len(role)}:{role}{text}"), (role, text)))
    own = {c: [x[-1] for x in sorted(ts)] for c, ts in turns.items()}
    whole = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        whole[c] = tuple(own.get(base, [])[:h] + ts[h:])
    members = defaultdict(list)
    for c, ts in sorted(whole.items()):
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    totals = {}
    for p in sorted(members, key=len, reverse=True):
        saved = (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        totals[p] = (sum(totals[k][0] for k in children[p]) or 1, saved + sum(totals[k][1] for k in children[p]))
    return sorted(
        ((m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(children[p]), *totals[p], sha(",".join(str(c) for c in m if len(whole[c]) == len(p)))) for p, m in members.items()),
        key=lambda r: tuple((x is None, str(x)) for x in r),
    )


def conversations(rng, n, texts, longest=9, start=0):
    return [(c, t, rng.choice("ua"), rng.choice(texts)) for c in range(start, start + n) for t in range(rng.randrange(1, longest))]


def test_equals_brute_force(spark):
    rng = random.Random(7)
    given = conversations(rng, 130, ["a", "bb", "é\U0001f600", ""])
    given += conversations(rng, 60, ["a", "bb"], start=-40)
    # NULLs, ties, repeated rows, rows without a conversation.
    given += [(200, None, None, None), (200, 1, "u", "z"), (200, 1, "u", "y"), (200, 1, "u", "y"), (None, 1, "u", "lost"), (301, 0, "u", "word " * 30_000)]
    # Copies of one conversation.
    given += [(c, t, "u", f"same {t}") for c in range(1000, 1400) for t in range(4)]
    assert rows(op.report(table(spark, given).repartition(5))) == expected(given)


def test_long_chains_and_wide_nodes(spark):
    rng = random.Random(2)
    given = [(c, t, "u", f"t{t}") for c, n in ((5, 300), (6, 170), (90, 300)) for t in range(n)]
    given += [(c, t, "u", f"t{t}" if t < 40 else f"{c}") for c in range(20, 40) for t in range(60)]
    given += [(c, 0, "u", rng.choice(["x", f"{c}"])) for c in range(600, 900)]
    assert rows(op.report(table(spark, given).repartition(3))) == expected(given)


def test_sample_equals_brute_force(spark):
    got = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert rows(op.report(got)) == expected([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in got.collect()])


def test_empty_and_turnless(spark):
    assert op.report(table(spark, [])).collect() == []
    assert op.report(table(spark, [(None, 1, "u", "x")])).collect() == []
    # Every conversation loses its few turns to a base that is not there.
    lost = [c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6]
    given = [(c, 0, "u", "x") for c in lost]
    got = op.report(table(spark, given)).collect()
    assert [(r["conv_id"], r["depth"], r["n_convs"], r["n_leaves"], r["ends_sha256"]) for r in got] == [(lost[0], 0, len(lost), 1, sha(",".join(map(str, lost))))]


def test_running_sums_cross_partitions(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(2_000).selectExpr("if(id < 1500, 0, id) as k", "id")
        got = op.running(df, ["k"], [F.col("id")], {"n": F.lit(1)}, "t")
        assert df.repartitionByRange("k", "id").withColumn("p", F.spark_partition_id()).where("k = 0").select("p").distinct().count() > 1
        assert sorted(r["n"] for r in got.where("k = 0").collect()) == list(range(1, 1501))
        assert {r["n"] for r in got.where("k > 0").collect()} == {1}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("piece", [1, 3])
def test_digests_of_groups_in_pieces(spark, monkeypatch, piece):
    monkeypatch.setattr(op, "PIECE_IDS", piece)
    df = spark.range(-3, 30).selectExpr("id % 2 as g", "id as m")
    got = {r["g"]: r["ends_sha256"] for r in op.digests(df, ["g"], "m").collect()}
    want = defaultdict(list)
    for m in range(-3, 30):
        want[m % 2 if m >= 0 else -(-m % 2)].append(str(m))
    assert got == {g: sha(",".join(ms)) for g, ms in want.items()}
