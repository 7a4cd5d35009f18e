"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its five-word shingles. Shingles have one global order:
those known to be frequent last, all others by hash. Two sets with at least
``ALPHA`` of either in common share ``m`` shingles among their first
``size - ceil(ALPHA * size) + m`` ones, for every m; so a longer prefix may
demand more shared shingles of a candidate. Each document picks the m with
the least estimated cost: the postings its prefix would meet, and the candidates
these leave (postings over m) times the price of verifying one. A pair is
verified when it shares as many prefix shingles as the smaller m of both, and as
many as its own sizes ask for: linked sets of sizes a and b share 4 (a + b) / 9
shingles, and no more than one rest behind the prefixes holds can be missing from
the prefixes. Nor does a shared shingle count whose places in both sets leave room
for too few others before and after it; before it only those have a partner that any
other prefix holds, as a set that holds the later one in its prefix holds them there too.

Documents with equal sets are one class from the start, by a hash of the set, so
exact copies are never paired. Near copies are linked in two steps: in each
shingle's list only the most central document is paired with the others; a last
join pairs what is still in different components, at shingles that have as many
more behind them in both prefixes as the pair must share, so that long lists meet
at their first shared shingles only. Members of one component are
never paired there, so a group of copies costs its size, not its square, yet no
link between components is lost. Components spread smallest ids along links,
halving paths, with every round written to the shared folder.

Shingles are 64-bit hashes and sets are compared as such; classes use 128 bits.

Defined results: A-Z are lower-cased; NULL and empty texts have no shingles and
link with nothing; fewer than five words are one shingle; rows with one doc_id
are one node of the graph, linked through any of its texts; rows without doc_id
have a size but no component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, slices, stage, texts_of

SHINGLE = 5
# Similarity as a fraction of integers, so that the threshold is exact.
NUMERATOR, DENOMINATOR = 4, 5
# Largest number of shared prefix shingles a document may demand.
MOST_MATCHES = 8
# Shingles that are put last: at most so many (8 bytes each, broadcast). A task names
# up to so many of its own, those that the most of its documents hold, and at
# least so many must hold one. Order only; never drops a pair.
FREQUENT, FREQUENT_OF_TASK, FREQUENT_IN_TASK = 1 << 17, 1 << 15, 2
# Nodes up to which their ids are broadcast (8 bytes each) to fetch their texts; beyond, the texts are joined by shuffle.
BROADCAST_NODES = 1_000_000
# Words a task remembers the hash of.
REMEMBERED = 200_000


class Shingler:
    """Turns texts into sorted arrays of distinct shingle hashes."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        found = text.encode("utf-8", "surrogatepass").lower().split()
        if not found:
            return np.empty(0, np.uint64)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        for w in set(found).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        hashes = np.fromiter(map(known.__getitem__, found), dtype=np.uint64, count=len(found))
        n = min(SHINGLE, len(found))
        joined = np.full(len(found) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            joined = mix(joined * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(joined)])
        return np.unique(joined)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def signature(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def linked(shared, a, b):
    """Similarity of at least the threshold, from the sizes, as numbers or columns."""
    return DENOMINATOR * shared >= NUMERATOR * (a + b - shared)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def describe(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, class) of every row, and (token, count) of what is frequent in each task."""
    schema = "doc_id bigint, n_shingles bigint, class binary, token bigint, count bigint"

    def run(batches):
        shingles = Shingler()
        seen: set[bytes] = set()
        tokens, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        for batch in slices(batches):
            sets = [shingles(t) for t in texts_of(batch, "t")]
            keys = [signature(s) if len(s) else None for s in sets]
            none = [None] * len(sets)
            yield _batch([batch.column(0), [len(s) for s in sets], keys, none, none], schema)
            fresh = []
            for key, s in zip(keys, sets):
                if key is not None and key not in seen:
                    seen.add(key)
                    fresh.append(s)
            if fresh:
                tokens, counts = _count(np.concatenate([tokens, *fresh]), counts, len(tokens))
                if len(tokens) > 4 * FREQUENT:
                    # Keep the commonest: a shingle held by a good part of the task survives every cut.
                    keep = np.argpartition(-counts, 2 * FREQUENT)[: 2 * FREQUENT]
                    tokens, counts = tokens[keep], counts[keep]
        often = np.flatnonzero(counts >= FREQUENT_IN_TASK)
        if len(often) > FREQUENT_OF_TASK:
            often = often[np.argpartition(-counts[often], FREQUENT_OF_TASK)[:FREQUENT_OF_TASK]]
        if len(often):
            none = [None] * len(often)
            yield _batch([none, none, none, _signed(tokens[often]), counts[often]], schema)

    return docs.select("doc_id", F.col(text_col).cast("string").alias("t")).mapInArrow(run, schema)


def _count(tokens: np.ndarray, counts: np.ndarray, counted: int) -> tuple[np.ndarray, np.ndarray]:
    """Add one occurrence of every token from ``counted`` on to the counts of those before."""
    weights = np.concatenate([counts, np.ones(len(tokens) - counted, np.int64)])
    unique, where = np.unique(tokens, return_inverse=True)
    return unique, np.bincount(where, weights=weights, minlength=len(unique)).astype(np.int64)


_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _batch(columns: list, schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    made = [c if isinstance(c, pa.Array) else pa.array(c, _TYPES[kind]) for c, (_, kind) in zip(columns, fields)]
    return pa.RecordBatch.from_arrays(made, names=[name for name, _ in fields])


def prefixes(docs: DataFrame, frequent: list[int], text_col: str = "text") -> DataFrame:
    """(token, class, n, place): the longest prefix any document may want, once per class and task."""
    shipped = docs.sparkSession.sparkContext.broadcast(np.sort(np.array(frequent, dtype=np.int64).view(np.uint64)))
    schema = "token bigint, class binary, n int, place int"

    def run(batches):
        shingles, common, seen = Shingler(), shipped.value, set()
        for batch in slices(batches):
            parts = []
            for text in texts_of(batch, "t"):
                own = shingles(text)
                key = signature(own)
                if not len(own) or key in seen:
                    continue
                seen.add(key)
                n = len(own)
                if len(common):
                    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
                    last = common[at] == own
                    own = np.concatenate([own[~last], own[last]])
                parts.append((own[: prefix_length(n, min(MOST_MATCHES, required(n)))], key, n))
            if parts:
                sizes = [len(p) for p, _, _ in parts]
                which = np.repeat(np.arange(len(parts)), sizes)
                keys = pa.array([k for _, k, _ in parts], pa.binary()).take(pa.array(which))
                n = np.array([n for _, _, n in parts], np.int32)[which]
                place = np.concatenate([np.arange(s, dtype=np.int32) for s in sizes])
                yield _batch([_signed(np.concatenate([p for p, _, _ in parts])), keys, n, place], schema)

    return docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(run, schema)


def required(n: int) -> int:
    """Shingles of a set of n that any linked set must share."""
    return -(-NUMERATOR * n // DENOMINATOR)


def prefix_length(n: int, matches: int) -> int:
    return n - required(n) + matches


def _prefix_length(n, matches):
    return n - F.ceil(n * NUMERATOR / DENOMINATOR) + matches


def shared_postings(tokens: DataFrame, classes: DataFrame) -> DataFrame:
    """(token, node, n, place, df): entries of shingles that two classes or more hold.

    Hash partitioning by token serves both the removal of repeats and the count.
    """
    once = tokens.repartition("token").groupBy("token", "class").agg(F.first("n").alias("n"), F.first("place").alias("place"))
    counted = once.withColumn("df", F.count("*").over(Window.partitionBy("token"))).where("df > 1")
    return counted.join(classes.select("class", "node"), "class").select("token", "node", "n", "place", "df")


def adapt(postings: DataFrame) -> DataFrame:
    """Postings of each document's chosen prefix, with its demand ``m`` and its centrality."""
    choices = range(1, MOST_MATCHES + 1)
    met = [F.sum(F.when(F.col("place") < _prefix_length(F.col("n"), m), F.col("df") - 1).otherwise(0)).alias(f"met{m}") for m in choices]
    # Postings met, and the candidates left, each at the price of reading its set.
    cost = lambda m: F.col(f"met{m}") * (1 + F.col("n") / m)
    allowed = lambda m: F.when(F.lit(m) <= F.ceil(F.col("n") * NUMERATOR / DENOMINATOR), F.struct(cost(m).alias("cost"), F.lit(m).alias("m")))
    # Shingles before this one that are in another prefix.
    before = F.row_number().over(Window.partitionBy("node", "n").orderBy("place")) - 1
    postings = postings.withColumn("before", before)
    chosen = postings.groupBy("node", "n").agg(*met).select(
        "node", "n", F.array_min(F.filter(F.array(*map(allowed, choices)), lambda x: x.isNotNull()))["m"].alias("m"), (F.col("met1") / F.col("n")).alias("central")
    )
    return postings.join(chosen, ["node", "n"]).where(F.col("place") < _prefix_length(F.col("n"), F.col("m"))).select("token", "node", "n", "m", "place", "before", "central")


def _may_link(x: dict, y: dict):
    """Whether sizes and places of one shared shingle allow a link.

    Shared shingles before it are at most the fewer with a partner, those after it at most the smaller rest.
    """
    room = F.least(x["before"], y["before"]) + F.least(x["n"] - x["place"], y["n"] - y["place"])
    enough = room * (DENOMINATOR + NUMERATOR) >= (x["n"] + y["n"]) * NUMERATOR
    return (F.least(x["n"], y["n"]) * DENOMINATOR >= F.greatest(x["n"], y["n"]) * NUMERATOR) & enough


def _needed(x: dict, y: dict):
    """Prefix shingles that a linked pair shares at least."""
    shared = F.ceil((x["n"] + y["n"]) * NUMERATOR / (DENOMINATOR + NUMERATOR))
    rest = lambda d: F.ceil(d["n"] * NUMERATOR / DENOMINATOR) - d["m"]
    return F.greatest(F.least(x["m"], y["m"]).cast("bigint"), shared - F.greatest(rest(x), rest(y)))


def _side(prefix: str = "", suffix: str = "") -> dict:
    return {c: F.col(f"{prefix}{c}{suffix}") for c in ("node", "n", "m", "place", "before", "label")}


def star_candidates(entries: DataFrame) -> DataFrame:
    """(a, b): in every list with more than one component, its most central member with each of another component."""
    lists = entries.groupBy("token").agg(
        F.max(F.struct("central", "node", "n", "m", "place", "before", "label")).alias("hub"), F.min("label").alias("low"), F.max("label").alias("high")
    )
    joined = entries.join(lists.where("low <> high").select("token", "hub"), "token")
    own, hub = _side(), _side("hub.")
    joined = joined.where((own["label"] != hub["label"]) & _may_link(own, hub))
    # Only shingles of which the hub is the most central are counted here, so half of those needed will do.
    counted = joined.groupBy(hub["node"].alias("a"), own["node"].alias("b")).agg(F.count("*").alias("shared"), F.min(_needed(own, hub)).alias("needed"))
    return counted.where(F.col("shared") * 2 >= F.col("needed")).select("a", "b")


def mixed_entries(entries: DataFrame) -> DataFrame:
    """Entries in lists with more than one component; ``rest`` counts a document's entries from this one on."""
    lists = entries.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("token")
    rest = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("place")))
    return entries.join(lists, "token", "left_semi").select("token", "node", "n", "m", "place", "before", "label", rest.alias("rest"))


def first_meetings(mixed: DataFrame) -> DataFrame:
    """(a, b, needed) wherever two components meet early enough to share all that they must from there on.

    Of the shingles a linked pair shares, the first is followed by all others in both prefixes. Later
    ones leave no room for as many, so a pair is met about once for every shingle beyond what it must share.
    """
    right = mixed.select("token", *[F.col(c).alias(f"{c}2") for c in mixed.columns[1:]])
    x, y = _side(), _side(suffix="2")
    needed = _needed(x, y)
    met = mixed.join(right, "token").where((x["label"] < y["label"]) & _may_link(x, y) & (F.least("rest", "rest2") >= needed))
    return met.select(x["node"].alias("a"), y["node"].alias("b"), needed.alias("needed"))


def cross_candidates(entries: DataFrame) -> DataFrame:
    """(a, b): every pair from different components that shares as many prefix shingles as it must."""
    mixed = stage(mixed_entries(entries), "mixed")
    prefix = mixed.groupBy("node").agg(F.collect_list("token").alias("tokens"))
    pairs = first_meetings(mixed).groupBy("a", "b").agg(F.first("needed").alias("needed"))
    both = pairs.join(prefix.select(F.col("node").alias("a"), F.col("tokens").alias("x")), "a")
    both = both.join(prefix.select(F.col("node").alias("b"), F.col("tokens").alias("y")), "b")
    return both.where(F.size(F.array_intersect("x", "y")) >= F.col("needed")).select("a", "b")


def sets_of(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, shingles): the sets of the given nodes, made again from their texts."""
    few = nodes.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES
    picked = texts.join(F.broadcast(nodes) if few else nodes, F.col("doc_id") == F.col("node")).select("node", "text")

    def make():
        shingles = Shingler()

        def work(batch: pa.RecordBatch):
            yield [batch.column(0), [_signed(shingles(t)) for t in texts_of(batch, "text")]]

        return work

    return stage(map_batches(picked, make, "node bigint, shingles array<bigint>"), "sets")


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose sets are similar enough."""
    sets = sets_of(stage(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "nodes"), texts)
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return both.where(linked(F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y"))).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): smallest node reachable, for every node of an edge.

    Every round a node takes the smallest label around it, and then its
    label's own label, which halves the paths.
    """
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = stage(lower.join(jump, "label", "left").select("node", "old", F.coalesce("further", "label").alias("label")), "labels")
        labels = moved.select("node", "label")
        if not moved.where("old <> label").limit(1).count():
            return labels


def relabel(entries: DataFrame, edges: DataFrame) -> DataFrame:
    """Entries with the component each node is in so far."""
    fresh = entries.drop("label").join(components(edges), "node", "left")
    return fresh.withColumn("label", F.coalesce("label", "node"))


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scanned = stage(describe(texts), "shingled")
    rows = scanned.where("n_shingles is not null").select("doc_id", "n_shingles", "class")
    totals = scanned.where("token is not null").groupBy("token").agg(F.sum("count").alias("n"))
    frequent = [r["token"] for r in totals.orderBy(F.desc("n"), "token").limit(FREQUENT).select("token").collect()]
    known = rows.where("class is not null and doc_id is not null")
    classes = stage(known.groupBy("class").agg(F.min("doc_id").alias("node")), "classes")

    postings = stage(shared_postings(prefixes(texts, frequent), classes), "postings")
    entries = stage(adapt(postings).withColumn("label", F.col("node")), "entries")
    # A doc_id with several texts ties their classes together.
    mapped = known.join(classes, "class")
    tied = mapped.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("high")).where("a <> high")
    edges = stage(mapped.join(tied.select("doc_id", "a"), "doc_id").select("a", F.col("node").alias("b")).where("a <> b").distinct(), "links")
    parts = [edges]
    # The most central documents first, once: they would be the same in every further round.
    for k, candidates in enumerate((star_candidates, cross_candidates)):
        current = stage(relabel(entries, _all(parts)), "entries") if k or edges.limit(1).count() else entries
        parts.append(stage(verify(stage(candidates(current), "pairs"), texts), "links"))
    labels = components(_all(parts))
    placed = classes.join(labels, "node", "left").select("class", F.coalesce("label", "node").alias("component_id"))
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return rows.join(placed, "class", "left").select("doc_id", "n_shingles", own.alias("component_id"))


def _all(parts: list[DataFrame]) -> DataFrame:
    union = parts[0]
    for p in parts[1:]:
        union = union.union(p)
    return union


def report(docs: DataFrame) -> DataFrame:
    """Set size and component of every document."""
    return join(docs)


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of every component, the one with the smallest doc_id; rows without doc_id stay. Columns as they came."""
    kept = join(docs).where("doc_id = component_id").select("doc_id").distinct()
    first = docs.where(F.col("doc_id").isNotNull()).join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return first.unionByName(docs.where(F.col("doc_id").isNull())).select(*docs.columns)
