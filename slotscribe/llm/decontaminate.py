"""Benchmark decontamination: one Aho-Corasick automaton over the items, one scan per text.

Items and texts are normalised to words joined by single spaces. Every run of
``WINDOW`` item words becomes a pattern that starts and ends with a space, so a
match covers whole words. A text is scanned once; matches are mapped back to
word numbers and to character offsets of the original text.

The automaton is broadcast. Its size is checked: patterns beyond
``MAX_PATTERN_BYTES`` are dealt by hash into several automata, and the texts are
scanned once for each.

Defined results: a NULL or empty text has no words and no hits; an item without
words has no window; an item of fewer than ``WINDOW`` words is one window;
repeated items and repeated documents are each reported; NULL item ids take no
part in the list of items but their words are hits. Without items nothing is hit.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, map_batches, stage, texts_of, with_columns

WINDOW = 10
# An automaton takes some 50 bytes for each byte of pattern, so this keeps one below 100 MB.
MAX_PATTERN_BYTES = 2_000_000

# Bytes that are not part of words become spaces, A-Z become a-z; bytes from 0x80 on belong to words.
_NORMAL = bytes(
    c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256)
)

# Appended to each document: its number of words, the hit stretches in words
# (last exclusive) and code points of the original text, and the items that occur.
SPAN = T.StructType([T.StructField(n, T.LongType()) for n in ("first_word", "end_word", "start", "end")])
RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(SPAN)),
    T.StructField("items", T.ArrayType(T.StringType())),
])


def words(text: str) -> list[bytes]:
    """Lower-cased words, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_NORMAL).split()


def windows(text: str, width: int = WINDOW) -> set[bytes]:
    """Patterns of an item."""
    found = words(text)
    if not found:
        return set()
    return {b" ".join([b"", *found[i : i + width], b""]) for i in range(max(1, len(found) - width + 1))}


def item_patterns(items: DataFrame, id_col: str, text_col: str, width: int = WINDOW) -> DataFrame:
    """(pattern, item_id) of all items, repeated pairs once."""
    def make():
        def one(batch: pa.RecordBatch):
            ids, texts = batch.column(0).to_pylist(), texts_of(batch, "t")
            pairs = [(p, i) for i, text in zip(ids, texts) for p in windows(text, width)]
            yield [[p for p, _ in pairs], [i for _, i in pairs]]

        return one

    named = items.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t"))
    return map_batches(named, make, "pattern binary, item_id string").distinct()


def build_automaton(pairs: list[tuple[bytes, str | None]]) -> ahocorasick.Automaton:
    """Patterns, as Latin-1 text so that one character is one byte, with their length and items."""
    owners: dict[bytes, list[str]] = {}
    for pattern, item in pairs:
        owners.setdefault(pattern, [])
        if item is not None:
            owners[pattern].append(item)
    automaton = ahocorasick.Automaton()
    for pattern, ids in owners.items():
        automaton.add_word(pattern.decode("latin-1"), (len(pattern), pattern.count(b" ") - 1, tuple(ids)))
    automaton.make_automaton()
    return automaton


def scan_text(automaton: ahocorasick.Automaton, text: str) -> tuple[int, np.ndarray | None, set[str]]:
    """Number of words, first and end word of the merged hit stretches (None without any), and items found."""
    found = words(text)
    if not found or len(automaton) == 0:
        return len(found), None, set()
    hits, items = [], set()
    for end, (length, n, ids) in automaton.iter((b" " + b" ".join(found) + b" ").decode("latin-1")):
        hits.append((end - length + 1, n))
        items.update(ids)
    if not hits:
        return len(found), None, items
    begins = np.cumsum([0, *(len(w) + 1 for w in found[:-1])])
    at = np.unique(np.array(hits, dtype=np.int64), axis=0)
    first = np.searchsorted(begins, at[:, 0])
    return len(found), merge_stretches(first, first + at[:, 1]), items


def merge_stretches(first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Union of half-open stretches, as ordered (first, end) rows; adjoining ones are joined."""
    order = np.argsort(first, kind="stable")
    first, end = first[order], np.maximum.accumulate(end[order])
    starts = np.flatnonzero(np.r_[True, first[1:] > end[:-1]])
    return np.stack([first[starts], end[np.r_[starts[1:] - 1, len(end) - 1]]], axis=1)


def character_offsets(text: str, stretches: np.ndarray) -> np.ndarray:
    """Code point offsets (start, end) of word stretches in the original text."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    in_word = np.frombuffer(raw.tobytes().translate(_NORMAL), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.r_[0, in_word.view(np.int8), 0]))
    begins, ends = edges[::2], edges[1::2]
    character = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
    return np.stack([character[begins[stretches[:, 0]]], character[ends[stretches[:, 1] - 1]]], axis=1)


def _scan(docs: DataFrame, text_col: str, patterns: list, out: str, before: str | None) -> DataFrame:
    """One scan with one automaton; ``before`` holds what earlier scans found."""
    shipped = docs.sparkSession.sparkContext.broadcast(patterns)

    def make():
        automaton = build_automaton(shipped.value)

        def work(batch: pa.RecordBatch) -> list:
            rows = []
            earlier = batch.column(batch.schema.get_field_index(before)).to_pylist() if before else [None] * batch.num_rows
            for text, old in zip(texts_of(batch, text_col), earlier):
                n, stretches, items = scan_text(automaton, text)
                if old and old["spans"]:
                    items |= set(old["items"])
                    was = np.array([[s["first_word"], s["end_word"]] for s in old["spans"]])
                    stretches = was if stretches is None else np.concatenate([was, stretches])
                    stretches = merge_stretches(stretches[:, 0], stretches[:, 1])
                spans = []
                if stretches is not None:
                    for (a, b), (start, end) in zip(stretches.tolist(), character_offsets(text, stretches).tolist()):
                        spans.append({"first_word": a, "end_word": b, "start": start, "end": end})
                rows.append({"n_words": n, "spans": spans, "items": sorted(items)})
            return [rows]

        return work

    return with_columns(docs, [T.StructField(out, RESULT)], make)


def scan(
    docs: DataFrame, items: DataFrame, out: str, *, text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text", width: int = WINDOW, max_bytes: int = MAX_PATTERN_BYTES,
) -> DataFrame:
    """``docs`` with a column ``out`` of type ``RESULT``."""
    patterns = item_patterns(items, item_id, item_text, width)
    total = patterns.agg(F.sum(F.length("pattern") + F.coalesce(F.length("item_id"), F.lit(0)))).first()[0] or 0
    rounds = max(1, -(-total // max_bytes))
    if rounds > 1:
        patterns = stage(patterns.withColumn("round", F.pmod(F.xxhash64("pattern"), F.lit(rounds))), "patterns")
    result, before = docs, None
    for k in range(rounds):
        part = patterns.where(F.col("round") == k) if rounds > 1 else patterns
        name = out if k == rounds - 1 else free_name(result, f"{out}_{k}")
        scanned = _scan(result, text_col, [tuple(r) for r in part.select("pattern", "item_id").collect()], name, before)
        result = scanned.drop(before) if before else scanned
        if k < rounds - 1:
            result = stage(result, "scanned")
        before = name
    return result


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per document: how many words and which items are contaminated."""
    found = scan(docs.select("doc_id", "text"), items, "found")
    n_hit = F.aggregate("found.spans", F.lit(0).cast("bigint"), lambda t, s: t + s["end_word"] - s["first_word"])
    return found.select(
        "doc_id", F.col("found.n_words").alias("n_words"), n_hit.alias("n_hit"),
        F.size("found.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("found.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("found.spans") > 0).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, items: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The documents without any contaminated word, with the columns they came with."""
    out = free_name(docs, "contamination")
    return scan(docs, items, out, text_col=text_col).where(F.size(F.col(out)["spans"]) == 0).drop(out)
