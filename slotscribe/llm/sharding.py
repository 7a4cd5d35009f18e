"""Uniform shuffle into shards of exact size, through a hypergeometric communication matrix.

Law ``rows``: shard sizes differ by one row at most. The rows of every input
partition are counted; the number that goes from each partition to each shard is
drawn without replacement from what the shards still lack, which is the law a
uniform permutation of all rows would give. Rows are permuted inside their
partition and cut by those numbers, exchanged, and permuted again inside their
shard. Every step is split: a partition holds what one reader split holds, and
a shard is permuted in blocks dealt by a random key, so neither one shard nor one
group of equal texts ever meets in one task.

Rows are staged once with their partition and place before anything is drawn,
so a task that is repeated after a lost executor sees the same rows.

Defined results: every row is placed, repeated rows each on their own; NULL
texts have size 1; an empty table gives no rows; more shards than rows leaves
shards empty. Existing columns keep their names and values.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, stage

# Rows of a block that is permuted in one task.
BLOCK_ROWS = 1 << 16
SEED = 20_260_101
# Above this population numpy's own hypergeometric law refuses to draw.
NUMPY_LIMIT = 1_000_000_000


def draw_hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` rows drawn without replacement are good.

    Large populations are drawn by inversion over the values within twelve
    standard deviations of the mode.
    """
    if min(good, n) == 0:
        return 0
    if good + bad < NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, n))
    low, high, total = max(0, n - bad), min(n, good), good + bad
    mode = int((n + 1) * (good + 1) / (total + 2))
    spread = int(12 * math.sqrt(max(1.0, n * (good / total) * (bad / total)))) + 12
    k = np.arange(max(low, mode - spread), min(high, mode + spread) + 1, dtype=np.int64)
    # Ratio of neighbouring probabilities, accumulated as logarithms.
    ratio = np.log((good - k[:-1]) * 1.0) + np.log((n - k[:-1]) * 1.0) - np.log(k[1:] * 1.0) - np.log((bad - n + k[1:]) * 1.0)
    weight = np.r_[0.0, np.cumsum(ratio)]
    cumulative = np.cumsum(np.exp(weight - weight.max()))
    return int(k[np.searchsorted(cumulative, rng.random() * cumulative[-1], side="right").clip(0, len(k) - 1)])


def communication_matrix(counts: list[int], sizes: list[int], seed: int = SEED) -> np.ndarray:
    """Rows from each partition (first axis) to each shard (second axis); both sums are exact."""
    rng = np.random.default_rng(seed)
    left = list(sizes)
    matrix = np.zeros((len(counts), len(sizes)), dtype=np.int64)
    for p, n in enumerate(counts):
        rest = sum(left)
        for s, room in enumerate(left):
            rest -= room
            take = draw_hypergeometric(rng, room, rest, n)
            matrix[p, s], left[s], n = take, room - take, n - take
    return matrix


def shuffle(df: DataFrame, shards: int = 8, *, shard_col: str = "shard", slot_col: str = "slot", seed: int = SEED) -> DataFrame:
    """``df`` in random order: its rows with their shard and their gapless place in it.

    The driver holds one row per input partition and the matrix, 8 bytes per
    partition and shard, whatever the number of rows.
    """
    spark = df.sparkSession
    part, place, rank, block = (free_name(df, x) for x in ("part__", "place__", "rank__", "block__"))
    staged = stage(df.withColumn(part, F.spark_partition_id()).withColumn(place, F.monotonically_increasing_id()), "shuffle")
    counts = {r[0]: r[1] for r in staged.groupBy(part).count().collect()}
    parts, total = sorted(counts), sum(counts.values())
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = communication_matrix([counts[p] for p in parts], sizes, seed)
    ends = [(p, [int(x) for x in np.cumsum(row)]) for p, row in zip(parts, matrix)]
    cuts = spark.createDataFrame(ends, f"{part} int, ends__ array<bigint>")

    # Permute locally and cut: the place in a random order decides the shard.
    local = Window.partitionBy(part).orderBy(F.xxhash64(F.lit(seed), place), place)
    ranked = staged.withColumn(rank, F.row_number().over(local)).join(cuts, part)
    dealt = ranked.withColumn(shard_col, F.size(F.filter("ends__", lambda e: e < F.col(rank))).cast("int"))

    # Exchange and permute again, in blocks small enough for a task; the blocks
    # are the high part of the random key, so their order is part of the permutation.
    blocks = max(1, -(-total // (shards * BLOCK_ROWS)))
    key = F.xxhash64(F.lit(seed + 1), place)
    dealt = dealt.withColumn(block, F.pmod(key, F.lit(blocks))).drop(part, rank, "ends__")
    held = dealt.groupBy(shard_col, block).count()
    before = Window.partitionBy(shard_col).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select(shard_col, block, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset__"))
    inside = Window.partitionBy(shard_col, block).orderBy(F.xxhash64(F.lit(seed + 2), place), place)
    placed = dealt.withColumn(slot_col, F.row_number().over(inside).cast("bigint"))
    placed = placed.join(offsets, [shard_col, block])
    return placed.select(*df.columns, shard_col, (F.col(slot_col) - 1 + F.col("offset__")).alias(slot_col))


def report(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Shard and slot of every document, with its size and checksum."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = shuffle(sized, shards)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
