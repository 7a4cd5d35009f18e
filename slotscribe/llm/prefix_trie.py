"""Trie of conversations: every distinct sequence of first turns is a node, with totals of its subtree.

Prefixes are told apart by sums. A turn at a place is 120 bits of the SHA-256 of
place, role and text; a prefix is its depth and the sums of its turns. Sums are added up
inside ranges of rows and carried over, so that a conversation with a third of all
rows is spread over as many tasks as its rows need (``running``). Nodes are
those keys with partial counts; a node is named by its smallest member and its depth.

Subtree totals come from parallel tree contraction. Every round rakes all leaves (their
total is known; it goes to the parent with partial sums, so that a root with a
third of all nodes below it costs a row per task) and splices out nodes of unary
chains whose depth has the round's bit set while their parent's has not: no two
neighbours go at once, an unbroken chain halves, and any chain shrinks within as
many rounds as depths have bits. A spliced node notes its only child and what it
adds to that child's total. Re-expansion follows these notes, doubling its stride,
until each ends at a raked node. All work shrinks with the tree, and every round is
written to the shared folder, so that a lost executor costs its tasks only.

The digest of a node's own conversations needs their ids in order. Ranges of ids
become pieces of text in parallel, and the task of a node adds its pieces to the digest one
by one: a node that a third of all conversations end at streams through one task and
is never held there.

Defined results: turns are ordered by turn, NULL first, ties by the SHA-256 of role and
text; NULL role and text are empty; rows without a conv_id belong to no conversation
and are left out; repeated rows are turns of their own. ``%`` keeps the sign, as in SQL.
An empty table gives no rows, not even a root. Texts of any length are read once,
where they lie; other columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, stage

# Conversations that share the start of one of them, and the most turns they take from it, plus one.
FAMILY, BORROWED = 100, 6
# Ids that become one piece of a digest.
PIECE_IDS = 50_000
BIG = "decimal(38,0)"


def running(df: DataFrame, key: list[str], order: list[Column], sums: dict[str, Column], label: str) -> DataFrame:
    """``df`` with running sums (this row included) along ``order`` inside each key.

    Rows are dealt by ranges of key and order, not by key: a large key covers
    several partitions, whose sums are carried to those after them. ``order``
    must tell rows apart wherever many are equal otherwise; what is summed is not negative.
    """
    ranged = df.repartitionByRange(*[F.col(k) for k in key], *order).withColumn("part__", F.spark_partition_id())
    local = Window.partitionBy("part__", *key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = stage(ranged.withColumns({f"{n}__": F.sum(c).over(local) for n, c in sums.items()}), label)
    totals = rows.groupBy(*key, "part__").agg(*[F.max(f"{n}__").alias(n) for n in sums])
    before = Window.partitionBy(*key).orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)
    # A range shares no key but its first with those before it, so there is a row per partition at most.
    carried = totals.select(*key, "part__", *[F.sum(n).over(before).alias(n) for n in sums]).where(F.col(next(iter(sums))).isNotNull())
    found = rows.join(F.broadcast(carried), [*key, "part__"], "left")
    added = {n: F.col(f"{n}__") + F.coalesce(F.col(n), F.lit(0)) for n in sums}
    return found.select(*df.columns, *[c.cast(BIG).alias(n) for n, c in added.items()])


def ordered_turns(conversations: DataFrame, turn: str = "turn") -> DataFrame:
    """(conv_id, place, digest, n_chars) of every turn, places from 1.

    Sums are maxima of running counts, so equal turns are told apart by a row number of the scan.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = F.concat_ws(":", F.length(role), F.concat(role, text))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col(turn).alias("turn"), F.sha2(said.cast("binary"), 256).alias("digest"),
        F.length(text).cast("bigint").alias("n_chars"), F.monotonically_increasing_id().alias("row__"),
    )
    turns = stage(turns, "trie-turns")
    order = [F.col("turn").asc_nulls_first(), F.col("digest"), F.col("row__")]
    placed = running(turns, ["conv_id"], order, {"place": F.lit(1).cast("bigint")}, "trie-places")
    return placed.select("conv_id", F.col("place").cast("bigint").alias("place"), "digest", "n_chars")


def rebuilt(turns: DataFrame, family: int = FAMILY, borrowed: int = BORROWED) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the first of their family: (conv_id, n_turns), and the turns they then have.

    The first h turns come from conversation ``c - c % family``, h being the
    checksum of c's digits modulo ``borrowed``; c's own follow after its first h.
    """
    turns = stage(turns, "trie-ordered")
    convs = turns.groupBy("conv_id").agg(F.max("place").alias("own"))
    convs = convs.withColumns({
        "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % borrowed,
        "base": F.col("conv_id") - F.col("conv_id") % family,
    })
    bases = convs.where("conv_id = base").select("base", F.col("own").alias("base_own"))
    convs = convs.join(bases, "base", "left").withColumn("lent", F.least("h", F.coalesce("base_own", F.lit(0))))
    convs = convs.withColumn("n_turns", F.col("lent") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    convs = stage(convs.select("conv_id", "base", "h", "lent", "n_turns"), "trie-conversations")
    heads = turns.where((F.col("place") < borrowed) & (F.col("conv_id") % family == 0)).select(F.col("conv_id").alias("base"), "place", "digest", "n_chars")
    lent = convs.select("conv_id", "base", "lent").join(heads, "base").where("place <= lent")
    own = turns.join(convs.select("conv_id", "h", "lent"), "conv_id").where("place > h").withColumn("place", F.col("place") - F.col("h") + F.col("lent"))
    columns = ["conv_id", "place", "digest", "n_chars"]
    return convs.select("conv_id", "n_turns"), lent.select(*columns).unionByName(own.select(*columns))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, s1, s2, p1, p2, n_chars): the key of every prefix and of the prefix one turn shorter."""
    at = F.sha2(F.concat_ws(":", "place", "digest").cast("binary"), 256)
    part = lambda k: F.conv(F.substring(at, 1 + 15 * k, 15), 16, 10).cast(BIG)
    keyed = turns.select("conv_id", F.col("place").alias("depth"), "n_chars", part(0).alias("t1"), part(1).alias("t2"))
    summed = running(keyed, ["conv_id"], [F.col("depth")], {"s1": F.col("t1"), "s2": F.col("t2")}, "trie-prefixes")
    return summed.select("conv_id", "depth", "s1", "s2", (F.col("s1") - F.col("t1")).alias("p1"), (F.col("s2") - F.col("t2")).alias("p2"), "n_chars")


def nodes_of(convs: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All nodes, with parents and members, and the node that every conversation ends at."""
    paths = stage(prefixes(turns), "trie-paths")
    key = ["depth", "s1", "s2"]
    grouped = paths.groupBy(*key).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.max("n_chars").alias("n_chars")
    )
    grouped = stage(grouped, "trie-nodes")
    zero, none = F.lit(0).cast(BIG), F.lit(None).cast("bigint")
    first, n = convs.agg(F.min("conv_id"), F.count(F.lit(1))).first()
    root = convs.sparkSession.createDataFrame([(0, first, n, 0)] if n else [], "depth bigint, conv_id bigint, n_convs bigint, n_chars bigint")
    root = root.select("depth", zero.alias("s1"), zero.alias("s2"), "conv_id", "n_convs", "n_chars")
    all_nodes = grouped.select(*root.columns).unionByName(root)
    named = all_nodes.select((F.col("depth") + 1).alias("depth"), F.col("s1").alias("p1"), F.col("s2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    below = grouped.join(named, ["depth", "p1", "p2"]).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_chars")
    nodes = below.unionByName(root.select("conv_id", "depth", none.alias("parent_conv_id"), "n_convs", "n_chars"))
    last = paths.join(convs.withColumnRenamed("n_turns", "depth"), ["conv_id", "depth"]).select(F.col("conv_id").alias("member"), *key)
    last = last.join(grouped.select(*key, "conv_id"), key).select("conv_id", "depth", "member")
    turnless = convs.where("n_turns = 0").select(F.lit(first).cast("bigint").alias("conv_id"), F.col("n_turns").cast("bigint").alias("depth"), F.col("conv_id").alias("member"))
    return nodes, last.unionByName(turnless)


def subtree_sums(tree: DataFrame, weights: list[str]) -> DataFrame:
    """Sums of ``weights`` over every subtree of (conv_id, depth, parent, n_children, weights…).

    ``parent`` is the parent's conv_id, NULL at the root; its depth is one less.
    Returns conv_id, depth and the sums under the names of the weights.
    """
    key, up = ["conv_id", "depth"], ["up_conv", "up_depth"]
    # rest: children not yet removed. acc_: gathered so far. pass_: what a node adds to its total for its present parent.
    live = tree.select(
        *key, F.col("parent").alias("up_conv"), F.when(F.col("parent").isNotNull(), F.col("depth") - 1).alias("up_depth"), F.col("n_children").alias("rest"),
        *[F.col(w).alias(f"acc_{w}") for w in weights], *[F.lit(0).cast("bigint").alias(f"pass_{w}") for w in weights],
    )
    acc, extra = [f"acc_{w}" for w in weights], [f"pass_{w}" for w in weights]
    live = stage(live, "trie-live")
    bits = int(live.agg(F.max("depth")).first()[0] or 0).bit_length() or 1
    columns, raked, spliced, r = live.columns, [], [], 0
    while not live.isEmpty():
        bit = lambda c: F.shiftright(c, r % bits).bitwiseAND(1)  # noqa: B023, E731
        leaves, inner = live.where("rest = 0"), live.where("rest > 0")
        raked.append(leaves.select(*key, *[F.col(a).alias(w) for a, w in zip(acc, weights)]))
        given = leaves.where("up_conv is not null").groupBy(*[F.col(u).alias(k) for u, k in zip(up, key)]).agg(
            F.count(F.lit(1)).alias("gone"), *[F.sum(F.col(a) + F.col(x)).alias(f"given_{w}") for a, x, w in zip(acc, extra, weights)]
        )
        inner = inner.join(given, key, "left").select(
            *key, *up, (F.col("rest") - F.coalesce("gone", F.lit(0))).alias("rest"),
            *[(F.col(a) + F.coalesce(f"given_{w}", F.lit(0))).alias(a) for a, w in zip(acc, weights)], *extra,
        )
        leaves_too = (F.col("rest") == 1) & F.col("up_conv").isNotNull() & (bit(F.col("depth")) == 1) & (bit(F.col("up_depth")) == 0)
        inner = stage(inner.withColumn("out", F.coalesce(leaves_too, F.lit(False))), f"trie-raked-{r}")
        out = inner.where("out").select(
            *[F.col(k).alias(u) for k, u in zip(key, up)], F.col("up_conv").alias("new_conv"), F.col("up_depth").alias("new_depth"),
            *[F.col(a).alias(f"out_{a}") for a in acc], *[F.col(x).alias(f"out_{x}") for x in extra],
        )
        kept = inner.where("not out")
        # Only a child of a spliced node finds one here, and each finds one at most.
        moved = stage(kept.join(out, up, "left"), f"trie-spliced-{r}")
        there = F.col("new_conv").isNotNull()
        spliced.append(moved.where(there).select(
            *[F.col(u).alias(k) for u, k in zip(up, key)], F.col("conv_id").alias("child_conv"), F.col("depth").alias("child_depth"),
            *[(F.col(f"out_{a}") + F.col(x)).alias(w) for a, x, w in zip(acc, extra, weights)],
        ))
        live = moved.select(
            *key, F.when(there, F.col("new_conv")).otherwise(F.col("up_conv")).alias("up_conv"), F.when(there, F.col("new_depth")).otherwise(F.col("up_depth")).alias("up_depth"),
            "rest", *acc, *[F.when(there, F.col(x) + F.col(f"out_{a}") + F.col(f"out_{x}")).otherwise(F.col(x)).alias(x) for a, x in zip(acc, extra)],
        ).select(*columns)
        r += 1
    known = reduce(DataFrame.unionByName, raked) if raked else live.select(*key, *[F.col(a).alias(w) for a, w in zip(acc, weights)])
    if not spliced:
        return known
    notes = stage(reduce(DataFrame.unionByName, spliced), "trie-notes")
    there = F.col("next_conv").isNotNull()
    while True:
        step = notes.select(*[F.col(k).alias(f"child_{n}") for k, n in zip(key, ("conv", "depth"))], F.col("child_conv").alias("next_conv"), F.col("child_depth").alias("next_depth"), *[F.col(w).alias(f"more_{w}") for w in weights])
        joined = notes.join(step, ["child_conv", "child_depth"], "left")
        longer = stage(joined.select(
            *key, F.coalesce("next_conv", "child_conv").alias("child_conv"), F.coalesce("next_depth", "child_depth").alias("child_depth"),
            *[(F.col(w) + F.coalesce(f"more_{w}", F.lit(0))).alias(w) for w in weights], there.alias("more"),
        ), "trie-notes")
        notes = longer.drop("more")
        if longer.where("more").isEmpty():
            break
    ends = known.select(F.col("conv_id").alias("child_conv"), F.col("depth").alias("child_depth"), *[F.col(w).alias(f"end_{w}") for w in weights])
    expanded = notes.join(ends, ["child_conv", "child_depth"]).select(*key, *[(F.col(w) + F.col(f"end_{w}")).alias(w) for w in weights])
    return known.unionByName(expanded)


def digests(members: DataFrame, by: list[str], member: str) -> DataFrame:
    """``by`` and ends_sha256: the SHA-256 of each group's ids, ascending, joined by commas."""
    names = [*by, "first__", "piece__"]
    kinds = ", ".join(f"{b} bigint" for b in by)
    ranged = members.repartitionByRange(*by, member).sortWithinPartitions(*by, member).select(*by, member)

    def pieces():
        def cut(batch: pa.RecordBatch):
            rows, columns = [], [c.to_pylist() for c in batch.columns]
            for *group, m in zip(*columns):
                if rows and rows[-1][0] == group and len(rows[-1][1]) < PIECE_IDS:
                    rows[-1][1].append(m)
                else:
                    rows.append((group, [m]))
            yield [*map(list, zip(*(g for g, _ in rows))), [ids[0] for _, ids in rows], [",".join(map(str, ids)) for _, ids in rows]] if rows else [[] for _ in names]

        return cut

    cut = map_batches(ranged, pieces, f"{kinds}, first__ bigint, piece__ string")
    # Ids are distinct in a group, so pieces never tie.
    dealt = cut.repartition(*by).sortWithinPartitions(*by, "first__").select(*by, "piece__")

    def chain(batches):
        now, state = None, None
        for batch in batches:
            done = []
            for *group, piece in zip(*(c.to_pylist() for c in batch.columns)):
                if group != now:
                    if now is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = group, hashlib.sha256(piece.encode())
                else:
                    state.update(b"," + piece.encode())
            if done:
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in list(zip(*done))[:-1]), pa.array([d[-1] for d in done])], names=[*by, "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in now), pa.array([state.hexdigest()])], names=[*by, "ends_sha256"])

    return dealt.mapInArrow(chain, f"{kinds}, ends_sha256 string")


EMPTY = hashlib.sha256(b"").hexdigest()


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """Every node of the trie of (conv_id, n_turns) and their (conv_id, place, digest, n_chars)."""
    nodes, ends = nodes_of(convs, turns)
    nodes = stage(nodes, "trie-named")
    children = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = stage(nodes, "trie-counted")
    weighted = nodes.select(
        "conv_id", "depth", F.col("parent_conv_id").alias("parent"), "n_children",
        (F.col("n_children") == 0).cast("bigint").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("n_chars")).alias("saved_tokens"),
    )
    sums = subtree_sums(weighted, ["n_leaves", "saved_tokens"])
    found = nodes.join(sums, ["conv_id", "depth"]).join(digests(ends, ["conv_id", "depth"], "member"), ["conv_id", "depth"], "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")
    )


def report(conversations: DataFrame) -> DataFrame:
    """The trie of all conversations after ``rebuilt``."""
    return trie(*rebuilt(ordered_turns(conversations)))
