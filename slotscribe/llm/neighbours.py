"""Nearest neighbours: a vantage-point tree per shard, searched in blocks of queries.

Shards follow the vectors. The upper levels of one vantage tree, fitted on at most
``TOP_SAMPLE`` distinct vectors, deal all vectors into at most ``GROUPS`` groups; a
group is cut by hash into shards of about ``SHARD_ROWS``. Of every group the least and
greatest distance to each vantage point above it are known, over all its vectors. A
query is answered in its own group first; the k-th distance found there is its
limit, and it is sent on only to groups that the triangle inequality cannot
exclude. Which vectors are sampled changes the cost, never the result.

A task reads its shard, builds a tree (each node splits its vectors at the median
distance from one of them) and streams the queries through it: first every query
goes down to its nearest leaf, which bounds its distances; then the tree is
walked once for the whole block, and a branch is left out for a query when the
triangle inequality says that it lies further than ``1 / factor`` of the k-th
distance so far. ``factor`` 1 is the exact search, and what the query uses; more
leaves out more, and on vectors of low intrinsic dimension loses true neighbours.
The best of all shards are merged by a row-number filter.

Equal vectors are one tree entry with its k + 1 smallest ids: further ones can
never be among the k nearest, so a vector that a third of all rows share costs
no more than another.

Defined results: vectors that are NULL, empty, zero, or hold NULL or non-finite
components take no part, as queries or candidates; vectors are compared with
those of the same length only; repeated rows of one id and vector count once; a
query never finds its own id; fewer than k candidates give fewer rows; ties go to
the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

SHARD_ROWS = 16_384
# Leaves of the upper tree, and distinct vectors it is fitted on. The driver and every task hold GROUPS vantage points.
GROUPS = 256
TOP_SAMPLE = 8_192
LEAF = 32
# Queries that walk a tree together.
BLOCK = 512
# Pruning of the production query: exact. What a larger factor loses depends on the vectors; where it would lose little, as
# on the sample, whose vectors point evenly into all directions, bounds are so loose that it also saves little.
FACTOR = 1.0
NEAREST = 10


@dataclass
class Node:
    """An inner node: the vantage point and, for each side, the range of its distances."""

    point: int
    near: "Node | np.ndarray"
    far: "Node | np.ndarray"
    near_range: tuple[float, float]
    far_range: tuple[float, float]


class VantageTree:
    """Tree over the rows of ``vectors``; ``ids`` are the smallest id of each, for ties."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, leaf: int = LEAF, seed: int = 7):
        self.vectors, self.ids, self.leaf = vectors, ids, leaf
        self.rng = np.random.default_rng(seed)
        self.root = self._build(np.arange(len(vectors)))

    def _build(self, rows: np.ndarray) -> "Node | np.ndarray":
        """Halves the rows, so the depth is the logarithm of their number, ties or not."""
        if len(rows) <= self.leaf:
            return rows
        # Of a few points the one that spreads the distances most.
        tried = self.rng.choice(rows, size=min(5, len(rows)), replace=False)
        some = rows[self.rng.choice(len(rows), size=min(100, len(rows)), replace=False)]
        point = max(tried.tolist(), key=lambda p: float(distances(self.vectors[[p]], self.vectors[some]).std()))
        d = distances(self.vectors[[point]], self.vectors[rows])[0]
        half = len(rows) // 2
        order = np.argpartition(d, half)
        near, far = order[:half], order[half:]
        return Node(
            point, self._build(rows[near]), self._build(rows[far]),
            (float(d[near].min()), float(d[near].max())), (float(d[far].min()), float(d[far].max())),
        )

    def search(self, queries: np.ndarray, k: int, factor: float = 1.0, limits: np.ndarray | float = np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Distances and rows of the k nearest of each query within its limit; rows are -1 where there are fewer."""
        best = np.repeat(np.broadcast_to(limits, len(queries)).astype(float)[:, None], k, axis=1)
        rows = np.full((len(queries), k), -1, dtype=np.int64)
        home = np.full(len(queries), -1, dtype=np.int64)
        self._descend(self.root, queries, np.arange(len(queries)), best, rows, home)
        self._walk(self.root, queries, np.arange(len(queries)), best, rows, home, factor)
        return best, rows

    def _take(self, leaf: np.ndarray, queries: np.ndarray, active: np.ndarray, best: np.ndarray, rows: np.ndarray) -> None:
        """Merge a leaf into the lists of the active queries."""
        d = np.concatenate([best[active], distances(queries[active], self.vectors[leaf])], axis=1)
        r = np.concatenate([rows[active], np.broadcast_to(leaf, (len(active), len(leaf)))], axis=1)
        ids = np.where(r < 0, np.iinfo(np.int64).max, self.ids[r])
        order = np.lexsort((ids, d), axis=1)[:, : best.shape[1]]
        best[active], rows[active] = np.take_along_axis(d, order, 1), np.take_along_axis(r, order, 1)

    def _descend(self, node, queries, active, best, rows, home) -> None:
        if not len(active):
            return
        if isinstance(node, np.ndarray):
            if len(node):
                home[active] = node[0]
                self._take(node, queries, active, best, rows)
            return
        d = distances(queries[active], self.vectors[[node.point]])[:, 0]
        near = d <= (node.near_range[1] + node.far_range[0]) / 2
        self._descend(node.near, queries, active[near], best, rows, home)
        self._descend(node.far, queries, active[~near], best, rows, home)

    def _walk(self, node, queries, active, best, rows, home, factor) -> None:
        if not len(active):
            return
        if isinstance(node, np.ndarray):
            fresh = active[home[active] != node[0]] if len(node) else active[:0]
            if len(fresh):
                self._take(node, queries, fresh, best, rows)
            return
        d = distances(queries[active], self.vectors[[node.point]])[:, 0]
        for child, (low, high) in ((node.near, node.near_range), (node.far, node.far_range)):
            bound = np.maximum(d - high, low - d)
            # Rounding, of the distances to the point too, must never turn a tie into a miss.
            self._walk(child, queries, active[bound * factor <= best[active, -1] * (1 + 1e-12) + (d + high) * 1e-12], best, rows, home, factor)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of ``a`` to all rows of ``b``, by their differences."""
    out = np.empty((len(a), len(b)))
    step = max(1, 1_000_000 // max(1, b.size))
    for i in range(0, len(a), step):
        difference = a[i : i + step, None, :] - b[None, :, :]
        out[i : i + step] = np.sqrt((difference * difference).sum(axis=2))
    return out


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec, dim) of the vectors that take part, in double precision."""
    vec = F.col("vec")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    return rows.where(F.col("id").isNotNull() & (F.size(vec) > 0) & finite & F.exists(vec, lambda x: x != 0)).withColumn("dim", F.size(vec))


class Top:
    """The upper levels of a vantage tree for vectors of one length: a complete binary tree."""

    def __init__(self, sample: np.ndarray, levels: int, seed: int = 7):
        self.levels = levels
        self.points = np.zeros((2**levels - 1, sample.shape[1]))
        self.radii = np.zeros(2**levels - 1)
        rng = np.random.default_rng(seed)
        held = {0: np.arange(len(sample))}
        for node in range(2**levels - 1):
            rows = held.pop(node)
            point = sample[rng.choice(rows) if len(rows) else 0]
            d = distances(point[None], sample[rows])[0]
            self.points[node], self.radii[node] = point, np.median(d) if len(rows) else 0.0
            held[2 * node + 1], held[2 * node + 2] = rows[d <= self.radii[node]], rows[d > self.radii[node]]

    def descend(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Group of every vector, and its distances to the vantage points above."""
        node, path = np.zeros(len(vectors), dtype=np.int64), np.zeros((len(vectors), self.levels))
        for level in range(self.levels):
            difference = vectors - self.points[node]
            path[:, level] = np.sqrt((difference * difference).sum(axis=1))
            node = 2 * node + 1 + (path[:, level] > self.radii[node])
        return node - (2**self.levels - 1), path


@dataclass
class Group:
    """Shards of a group, numbered from ``first``, and the ranges of its distances to the points above it."""

    first: int
    pieces: int
    low: np.ndarray
    high: np.ndarray


class Layout:
    """Where vectors lie: a top and its groups for each sampled length; any other length is one shard."""

    def __init__(self, tops: dict[int, Top], groups: dict[tuple[int, int], Group]):
        self.tops, self.groups = tops, groups

    def home(self, dim: int, vectors: np.ndarray) -> list[int]:
        return self.tops[dim].descend(vectors)[0].tolist() if dim in self.tops else [0] * len(vectors)

    def shards(self, dim: int, group: int) -> range:
        if dim not in self.tops:
            return range(-dim, -dim + 1)
        place = self.groups.get((dim, group))
        return range(place.first, place.first + place.pieces) if place else range(0)

    def others(self, dim: int, vectors: np.ndarray, limits: np.ndarray, factor: float) -> list[list[int]]:
        """For each query the shards outside its own group that may hold something within its limit."""
        out: list[list[int]] = [[] for _ in vectors]
        if dim not in self.tops:
            return out
        top = self.tops[dim]
        home, d = np.array(self.home(dim, vectors)), distances(vectors, top.points)
        for (length, group), place in self.groups.items():
            if length != dim:
                continue
            above = [(group + 2**top.levels) // 2 ** (top.levels - level) - 1 for level in range(top.levels)]
            bound = np.maximum(d[:, above] - place.high, place.low - d[:, above]).max(axis=1)
            # Rounding must never turn a tie into a miss.
            slack = (d[:, above].max(axis=1) + place.high.max()) * 1e-12
            for i in np.flatnonzero((home != group) & (bound * factor <= limits * (1 + 1e-12) + slack)).tolist():
                out[i] += self.shards(dim, group)
        return out


def lay_out(entries: DataFrame, shard_rows: int) -> tuple[Layout, int]:
    """The layout of distinct vectors and its number of shards."""
    n = entries.count()
    levels = max(0, min(GROUPS, -(-n // shard_rows)) - 1).bit_length()
    if not levels:
        return Layout({}, {}), 1
    sampled: dict[int, list] = {}
    # Cut by hash to somewhat more than the sample, so that tasks do not each send a whole sample to be merged.
    share = min(1.0, (2 * TOP_SAMPLE + 64) / n)
    drawn = entries.select("vec", F.xxhash64("vec").alias("h")).where(F.pmod("h", F.lit(1 << 40)) < int(share * (1 << 40)))
    for row in drawn.orderBy("h", "vec").limit(TOP_SAMPLE).collect():
        sampled.setdefault(len(row["vec"]), []).append(row["vec"])
    tops = {dim: Top(np.array(rows, dtype=np.float64), levels) for dim, rows in sampled.items()}

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in by_length(batch):
                if dim in tops:
                    group, path = tops[dim].descend(matrix(part.column(1), dim))
                    columns = [part.column(0).cast(pa.int32()), pa.array(group, pa.int32()), pa.array(list(path), pa.list_(pa.float64()))]
                    yield pa.RecordBatch.from_arrays(columns, names=["dim", "at", "path"])

    located = entries.select("dim", "vec").mapInArrow(locate, "dim int, at int, path array<double>")
    ends = [f(F.col("path")[i]).alias(f"{f.__name__}_{i}") for i in range(levels) for f in (F.min, F.max)]
    groups, total = {}, 0
    for row in located.groupBy("dim", "at").agg(F.count("*").alias("n"), *ends).collect():
        low, high = (np.array([row[f"{name}_{i}"] for i in range(levels)]) for name in ("min", "max"))
        groups[row["dim"], row["at"]] = Group(total, -(-row["n"] // shard_rows), low, high)
        total += groups[row["dim"], row["at"]].pieces
    return Layout(tops, groups), max(1, total)


DEALT = "shard int, role int, dim int, id bigint, ids array<bigint>, vec array<double>, `limit` double"


def deal(entries: DataFrame, layout: Layout) -> DataFrame:
    """Every distinct vector with its shard, in the columns of ``DEALT``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in by_length(batch):
                held = [layout.shards(dim, g) for g in layout.home(dim, matrix(part.column(1), dim))]
                yield dealt_rows([r[h % len(r)] for r, h in zip(held, part.column(3).to_pylist())], 0, part, None, part.column(2), None)

    return entries.select("dim", "vec", "ids", F.xxhash64("vec").alias("h")).mapInArrow(run, DEALT)


def send(asked: DataFrame, layout: Layout, factor: float, home: bool) -> DataFrame:
    """Every query, once for each shard it goes to: those of its own group, or those of others within its limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in by_length(batch):
                for at in range(0, part.num_rows, BLOCK):
                    block = part.slice(at, BLOCK)
                    vectors, limits = matrix(block.column(1), dim), block.column(3).to_numpy(zero_copy_only=False)
                    to = [layout.shards(dim, g) for g in layout.home(dim, vectors)] if home else layout.others(dim, vectors, limits, factor)
                    rows = block.take(pa.array([i for i, shards in enumerate(to) for _ in shards], pa.int64()))
                    yield dealt_rows([n for shards in to for n in shards], 1, rows, rows.column(2), None, rows.column(3))

    return asked.select("dim", "vec", "id", "limit").mapInArrow(run, DEALT)


def dealt_rows(shards: list[int], role: int, part: pa.RecordBatch, ids, lists, limits) -> pa.RecordBatch:
    """Rows of ``DEALT``; ``part`` begins with the columns dim and vec."""
    n = part.num_rows
    columns = [
        pa.array(shards, pa.int32()), pa.array([role] * n, pa.int32()), part.column(0).cast(pa.int32()), pa.nulls(n, pa.int64()) if ids is None else ids,
        pa.nulls(n, pa.list_(pa.int64())) if lists is None else lists, part.column(1), pa.nulls(n, pa.float64()) if limits is None else limits,
    ]
    return pa.RecordBatch.from_arrays(columns, names=["shard", "role", "dim", "id", "ids", "vec", "limit"])


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of each vector length (the first column)."""
    lengths = batch.column(0).to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths).tolist():
        yield dim, batch.take(pa.array(np.flatnonzero(lengths == dim)))


def search(
    vectors: DataFrame, queries: DataFrame, k: int = NEAREST, *, id_col: str = "vec_id", vec_col: str = "embedding",
    factor: float = FACTOR, shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest vectors found for every query."""
    own = Window.partitionBy("vec").orderBy("id")
    few = usable(vectors, id_col, vec_col).dropDuplicates(["id", "vec"]).withColumn("n", F.row_number().over(own)).where(F.col("n") <= k + 1)
    entries = stage(few.groupBy("vec", "dim").agg(F.sort_array(F.collect_list("id")).alias("ids")), "vectors")
    layout, shards = lay_out(entries, shard_rows)
    placed = deal(entries, layout)
    asked = usable(queries, id_col, vec_col).dropDuplicates(["id", "vec"]).withColumn("limit", F.lit(float("inf")))

    def nearest(found: DataFrame) -> DataFrame:
        best = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    found = nearest(ask(placed, send(asked, layout, factor, True), shards, k, factor))
    if not layout.tops:
        return found
    found = stage(found, "home")
    limits = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("limit"))
    bound = asked.drop("limit").join(limits, "id", "left").withColumn("limit", F.coalesce("limit", F.lit(float("inf"))))
    further = ask(placed, send(bound, layout, factor, False), shards, k, factor)
    return nearest(found.drop("rank").unionByName(further))


def ask(placed: DataFrame, sent: DataFrame, shards: int, k: int, factor: float) -> DataFrame:
    """(query_id, vec_id, score): the nearest of each shard for the queries sent to it."""
    # By range, for hashes of few numbers collide: a task gets about one shard.
    dealt = placed.unionByName(sent).repartitionByRange(shards, "shard").sortWithinPartitions("shard", "dim", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, tree = None, [], None
        for batch in batches:
            for where, role, part in runs_of(batch):
                if where != key:
                    key, held, tree = where, [], None
                if role == 0:
                    held.append(part)
                    continue
                if tree is None:
                    tree, ids = plant(held, where[1])
                    held = []
                if tree is None:
                    continue
                query_ids = part.column(3).to_numpy(zero_copy_only=False)
                block = matrix(part.column(5), where[1])
                limits = part.column(6).to_numpy(zero_copy_only=False) * (1 + 1e-12)
                for i in range(0, len(block), BLOCK):
                    yield answers(tree, ids, query_ids[i : i + BLOCK], block[i : i + BLOCK], limits[i : i + BLOCK], k, factor)

    return dealt.mapInArrow(run, "query_id bigint, vec_id bigint, score double")


def runs_of(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], int, pa.RecordBatch]]:
    """Stretches of a sorted batch with the same shard, vector length and role."""
    columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 1)]
    changes = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
    for a, b in zip([0, *changes.tolist()], [*changes.tolist(), batch.num_rows]):
        if b > a:
            yield (int(columns[0][a]), int(columns[1][a])), int(columns[2][a]), batch.slice(a, b - a)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def plant(parts: list[pa.RecordBatch], dim: int) -> tuple[VantageTree | None, list[list[int]]]:
    if not parts:
        return None, []
    ids = [x for p in parts for x in p.column(4).to_pylist()]
    return VantageTree(np.concatenate([matrix(p.column(5), dim) for p in parts]), np.array([x[0] for x in ids], dtype=np.int64)), ids


def answers(tree: VantageTree, ids: list[list[int]], query_ids: np.ndarray, block: np.ndarray, limits: np.ndarray, k: int, factor: float) -> pa.RecordBatch:
    """The k nearest ids of each query in this shard: k + 1 distinct vectors always hold them."""
    best, rows = tree.search(block, k + 1, factor, limits)
    out: list[tuple[int, int, float]] = []
    for q, ds, rs in zip(query_ids.tolist(), best.tolist(), rows.tolist()):
        near = sorted((d, i) for d, r in zip(ds, rs) if r >= 0 for i in ids[r] if i != q)[:k]
        out += [(q, i, d) for d, i in near]
    columns = [pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.float64())]
    return pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "score"])


def report(embeddings: DataFrame) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 100."""
    return search(embeddings, embeddings.where(F.col("vec_id") % 100 == 0))
