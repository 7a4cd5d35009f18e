"""Periodic runs of words: stretches that repeat one phrase at least three times in a row.

A run with period q is a stretch whose words q apart are the same, at least
``LEAST_WORDS`` words and ``LEAST_TURNS`` periods long, that keeps the period with
no word more on either side; q is its smallest period.

Method. The suffixes of a text's words are sorted and the tree of their common
prefixes (LCP intervals) is walked bottom-up. An interval of depth L holds the
places where some L words stand, in order, each with the class of its left word.
Two places from different children with different left words are a maximal
pair: their L words cannot be extended. If they are q apart and L >= 2q, the
stretch from the first place to the end of the second copy has period q and is
maximal, so a pair within the length limits is a run as it stands. Places in the
smaller child are looked up in the larger. Only neighbours can give a smallest
period: a copy between two places q <= L/2 apart would give the stretch a shorter
one. Pairs at a multiple of the period cover the same stretch; the smallest counts.

A run needs L + q >= 24 with q <= L/2, hence L >= 16. Words of a whole Arrow slice
are hashed at once, 16 at a time, and only texts in which 16 words occur twice
are sorted at all; that rules out no run.

A text is the unit of work: tasks hold a slice of texts, memory grows with the
longest text (some 8 bytes a word, and 4 more for every doubling of its longest
repeat), and nothing is shuffled, so copies and hot sources cost what they weigh.

Defined results: NULL and empty texts have no words and no runs; of two runs with the same
exponent the first, then the shorter period, is the longest; repeated rows are
judged one by one; an empty table gives no rows. Columns whose names the results
would take are refused by the general functions; the report reads doc_id and text only.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, with_columns

LEAST_WORDS, LEAST_TURNS = 24, 3
RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))


def least_depth(least_words: int, turns: int) -> int:
    """Words that a run has in common with itself one period on, at least."""
    return -(-least_words * (turns - 1) // turns)


def words_of(text: str | None) -> list[bytes]:
    """Stretches of anything but the six ASCII white-space characters, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Words of all texts as numbers, equal words alike, and where each text ends."""
    known: dict[bytes, int] = {}
    number = known.setdefault
    flat = np.fromiter((number(w, len(known)) for words in texts for w in words), np.int64, sum(map(len, texts)))
    return flat, np.cumsum([len(words) for words in texts], dtype=np.int64)


MIX = np.uint64(0x9E3779B97F4A7C15)


def repeats_within(flat: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Which texts hold the same ``depth`` words at two places, by 64 bits of hash: never misses one."""
    out = np.zeros(len(ends), bool)
    if len(flat) < depth:
        return out
    own = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    hashes = (flat.astype(np.uint64) + np.uint64(1)) * MIX
    hashes ^= hashes >> np.uint64(29)
    power, done, total = hashes, 0, np.zeros(len(flat) - depth + 1, np.uint64)
    # The hash of ``depth`` words from those of its binary parts.
    for bit in range(depth.bit_length()):
        width = 1 << bit
        if depth & width:
            total = total * (MIX << np.uint64(1) | np.uint64(1)) + power[done : done + len(total)]
            total ^= total >> np.uint64(31)
            done += width
        if done == depth:
            break
        power = power[: len(power) - width] * np.uint64(0xBF58476D1CE4E5B9) + (power[width:] ^ (power[width:] >> np.uint64(27))) * MIX
    inside = own[: len(total)] == own[depth - 1 :]
    keys = total[inside] ^ ((own[: len(total)][inside].astype(np.uint64) + np.uint64(1)) * np.uint64(0x94D049BB133111EB))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    at = own[: len(total)][inside][order]
    out[at[1:][same & (at[1:] == at[:-1])]] = True
    return out


def suffix_order(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and the words each shares with the one before it."""
    n = len(ids)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int32) + 1
    levels, width = [rank], 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - width)] = rank[width:]
        key = rank.astype(np.int64) * (n + 2) + after
        order = np.argsort(key, kind="stable")
        fresh = np.ones(n, np.int32)
        fresh[1:] = key[order][1:] != key[order][:-1]
        rank = np.empty(n, np.int32)
        rank[order] = np.cumsum(fresh, dtype=np.int32)
        if rank[order[-1]] == n or width >= n:
            break
        levels.append(rank)
        width *= 2
    a, b = order[:-1].copy(), order[1:].copy()
    shared = np.zeros(n, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        both = (a < n) & (b < n)
        same = both & (levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)])
        # Ranks of suffixes that end early differ, so equal ranks are whole words.
        step = same * (1 << k)
        a, b = a + step, b + step
        shared[1:] += step
    return order, shared


def find_runs(ids: np.ndarray, least_words: int = LEAST_WORDS, turns: int = LEAST_TURNS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    depth = least_depth(least_words, turns)
    if len(ids) < least_words:
        return []
    order, shared = suffix_order(ids)
    left = [-1, *ids[:-1].tolist()]
    best: dict[tuple[int, int], int] = {}

    def join(one: list[int], other: list[int], common: int) -> list[int]:
        """Both children's places in order; pairs between them that are runs are noted."""
        if len(one) < len(other):
            one, other = other, one
        reach = common // (turns - 1)
        for x in other:
            k = bisect_left(one, x)
            for y in one[max(0, k - 1) : k + 1]:
                period = abs(x - y)
                if period <= reach and period + common >= least_words and left[x] != left[y]:
                    stretch = (min(x, y), period + common)
                    best[stretch] = min(period, best.get(stretch, period))
        for x in other:
            insort(one, x)
        return one

    open_intervals: list[tuple[int, list[int]]] = []
    for place, common in zip(order.tolist(), [*shared[1:].tolist(), 0]):
        node = [place]
        while open_intervals and open_intervals[-1][0] > common:
            d, places = open_intervals.pop()
            node = join(places, node, d)
        if common >= depth:
            if open_intervals and open_intervals[-1][0] == common:
                node = join(open_intervals.pop()[1], node, common)
            open_intervals.append((common, node))
    return sorted((start, length, period) for (start, length), period in best.items())


def runs_of(texts: list[list[bytes]], least_words: int = LEAST_WORDS, turns: int = LEAST_TURNS) -> list[list[tuple[int, int, int]]]:
    """The runs of every text."""
    flat, ends = numbered(texts)
    some = repeats_within(flat, ends, least_depth(least_words, turns))
    return [find_runs(flat[e - len(words) : e], least_words, turns) if s else [] for words, e, s in zip(texts, ends.tolist(), some.tolist())]


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words left when every run keeps its first period."""
    if not runs:
        return words
    cover = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        cover[start + period] += 1
        cover[start + length] -= 1
    return [w for w, c in zip(words, np.cumsum(cover).tolist()) if not c]


def find(docs: DataFrame, *, text: str = "text", least_words: int = LEAST_WORDS, turns: int = LEAST_TURNS, runs: str = "runs") -> DataFrame:
    """``docs`` with all runs of a text column: array<struct<start, length, period>>, by word number."""
    at = docs.columns.index(text)

    def make():
        def work(batch: pa.RecordBatch) -> list:
            found = runs_of([words_of(t) for t in batch.column(at).to_pylist()], least_words, turns)
            return [[[dict(zip(("start", "length", "period"), r)) for r in rs] for rs in found]]

        return work

    return with_columns(docs, [T.StructField(runs, RUNS)], make)


def collapse(docs: DataFrame, *, text: str = "text", least_words: int = LEAST_WORDS, turns: int = LEAST_TURNS) -> DataFrame:
    """``docs`` with every run cut to its first period; texts without runs stay as they are, byte for byte."""
    schema, at = docs.schema, docs.columns.index(text)

    def make():
        def work(batch: pa.RecordBatch):
            given = batch.column(at).to_pylist()
            words = [words_of(t) for t in given]
            found = runs_of(words, least_words, turns)
            new = [b" ".join(kept_words(w, rs)).decode("utf-8", "replace") if rs else t for t, w, rs in zip(given, words, found)]
            yield [pa.array(new, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns)]

        return work

    return map_batches(docs, make, schema)


def rewritten(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The text of one document in ten ends in a repeated phrase, as its doc_id has it; without one nothing changes."""
    if not words or doc_id is None:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    phrase = words[a : a + p]
    return words[:a] + (phrase * (-(-(n - a) // p)))[: n - a]


def longest(runs: list[tuple[int, int, int]]) -> tuple:
    """start, length, period and exponent in thousandths of the run with the greatest exponent."""
    if not runs:
        return None, None, None, None
    top = runs[0]
    for run in runs[1:]:
        if run[1] * top[2] > top[1] * run[2]:
            top = run
    return *top, 1000 * top[1] // top[2]


REPORT = (
    "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
    "runs_sha256 string, collapsed_sha256 string"
)


def report(docs: DataFrame) -> DataFrame:
    """Runs of every document after ``rewritten``, and what is left of it."""

    def make():
        def work(batch: pa.RecordBatch):
            ids = batch.column(0).to_pylist()
            texts = [rewritten(words_of(t), i) for i, t in zip(ids, batch.column(1).to_pylist())]
            rows = []
            for i, words, runs in zip(ids, texts, runs_of(texts)):
                listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
                kept = b" ".join(kept_words(words, runs))
                rows.append((i, len(runs), *longest(runs), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
            yield list(map(list, zip(*rows))) if rows else [[] for _ in range(8)]

        return work

    return map_batches(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), make, REPORT)
