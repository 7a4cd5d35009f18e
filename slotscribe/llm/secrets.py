"""Secret scan: patterns, and a battery of randomness tests with false-discovery control.

Three patterns give the base spans (``assign``, ``access``, ``hex``). Beyond
them every long run of key characters is tested: its encoding is inferred from
its characters; against uniform draws from that alphabet the chi-squared test,
the runs test and the lag-1 serial correlation give p-values, joined by Fisher's
method into one figure, high for strings that look random.

How high is high enough comes from the corpus: runs of letters in one case are
ordinary words, and their figures under the widest alphabet of an encoding's
family, in the same class of lengths, are the null distribution. Long words are
rare, so each class also has ``MODEL_WORDS`` words of its shortest length, whose
letters are drawn as often as the corpus has them: a model of its words that has a
bar for every length, however few long ones were seen. Each candidate's
p-value is its upper tail there, and within each family and class the
Benjamini-Hochberg rule at rate ``FALSE_DISCOVERY`` sets the bar. Both
distributions and the letters are counted over all documents, in a fixed number of bins.

Defined results: NULL and empty texts have no spans; without any letter in the
corpus all letters are drawn alike; an added span that overlaps a base one is left
out; repeated documents are scanned each on their own.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, map_batches, texts_of, with_columns

KINDS = ("assign", "access", "hex", "random")
FALSE_DISCOVERY = 0.01
# Shortest run that is tested, and the upper ends of the classes of lengths.
SHORTEST = 16
LENGTH_CLASSES = (24, 32, 48, 96)
BINS = 400
# Smallest figure told apart, as a logarithm.
FLOOR = -40.0
# Words of the letter model in each class.
MODEL_WORDS = 4_000

ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
ASSIGN_MIN, ACCESS_MIN = 8, 16
CHUNK = re.compile(r"(?<!\S)\S{%d,}" % SHORTEST)
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % SHORTEST)
# Encodings from the narrowest, with their family; the first that has all characters of a run is inferred.
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = tuple(
    (family, {c: i for i, c in enumerate(symbols)})
    for family, symbols in (
        (0, DIGITS + "abcdef"), (1, DIGITS + "ABCDEF"), (1, UPPER + "234567"), (0, DIGITS + LOWER), (1, DIGITS + UPPER),
        (2, DIGITS + UPPER + LOWER), (2, UPPER + LOWER + DIGITS + "+/"), (2, UPPER + LOWER + DIGITS + "-_"), (2, UPPER + LOWER + DIGITS + "+/-_="),
    )
)
# The widest alphabet of each family: lower case, upper case, both.
WIDEST = tuple([a for f, a in ENCODINGS if f == family][-1] for family in range(3))
CLASSES = len(WIDEST) * (len(LENGTH_CLASSES) + 1)
# Not a class of runs: its bins count the letters of the corpus.
LETTERS = CLASSES
WORD = re.compile(r"[A-Za-z]?[a-z]+|[A-Z]+")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the pattern matches, in code points, by start and then kind."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= ASSIGN_MIN]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_MIN]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def class_of(family: int, n: int) -> int:
    """Class of a family and a length."""
    return family * (len(LENGTH_CLASSES) + 1) + sum(n >= end for end in LENGTH_CLASSES)


def infer(token: str) -> tuple[int, dict[str, int]]:
    """Family and alphabet of the narrowest encoding."""
    symbols = set(token.rstrip("=") or token)
    return next(((f, a) for f, a in ENCODINGS if all(c in a for c in symbols)), ENCODINGS[-1])


def normal_tail(z: float) -> float:
    """P(|Z| >= |z|)."""
    return math.erfc(abs(z) / math.sqrt(2))


def randomness(token: str, alphabet: dict[str, int] | None = None) -> float:
    """Fisher's joint p-value of the battery, as a logarithm: 0 is the most random."""
    core = token.rstrip("=") or token
    alphabet = alphabet or infer(token)[1]
    x = np.fromiter(map(alphabet.__getitem__, core), dtype=np.float64, count=len(core))
    n, size = len(x), len(alphabet)
    # Chi-squared of the symbols' counts, by the Wilson-Hilferty cube root.
    counts = np.bincount(x.astype(np.int64), minlength=size)
    chi2, freedom = float(((counts - n / size) ** 2).sum() * size / n), size - 1
    spread = 2 / (9 * freedom)
    uniform = 0.5 * math.erfc(((chi2 / freedom) ** (1 / 3) - 1 + spread) / math.sqrt(2 * spread))
    # Runs above and below the middle of the alphabet.
    high = x >= size / 2
    a, b = int(high.sum()), int(n - high.sum())
    runs = 1 + int((high[1:] != high[:-1]).sum())
    mean = 1 + 2 * a * b / n
    variance = (mean - 1) * (mean - 2) / (n - 1)
    alternating = normal_tail((runs - mean) / math.sqrt(variance)) if variance > 0 else 0.0
    # Lag-1 correlation.
    centred = x - x.mean()
    power = float((centred**2).sum())
    serial = normal_tail(float((centred[1:] * centred[:-1]).sum()) / power * math.sqrt(n)) if power > 0 else 0.0
    half = -sum(math.log(max(p, 1e-17)) for p in (uniform, alternating, serial))
    # Upper tail of chi-squared with six degrees of freedom.
    return max(FLOOR, -half + math.log(1 + half + half * half / 2))


def long_runs(text: str):
    """(start, end, token) of all runs that are tested or count as words."""
    for chunk in CHUNK.finditer(text):
        for run in RUN.finditer(chunk[0]):
            yield chunk.start() + run.start(), chunk.start() + run.end(), run[0]


def is_word(token: str) -> bool:
    """Letters of one case, joined by signs: an ordinary word, not a candidate."""
    return all(WORD.fullmatch(part) for part in re.split(r"[+/_=-]+", token) if part)


def bin_of(figure: float) -> int:
    return int(round((figure - FLOOR) / -FLOOR * (BINS - 1)))


def null_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(class, bin, words, candidates) over all documents, and under class ``LETTERS`` how often each letter occurs."""
    def make():
        def work(batch: pa.RecordBatch):
            words, candidates = (np.zeros((CLASSES + 1, BINS), np.int64) for _ in range(2))
            for text in texts_of(batch, "t"):
                raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
                words[LETTERS, : len(LOWER)] += np.bincount(raw, minlength=256)[ord("a") : ord("z") + 1]
                for start, end, token in long_runs(text):
                    if not is_word(token):
                        family, alphabet = infer(token)
                        candidates[class_of(family, end - start), bin_of(randomness(token, alphabet))] += 1
                        continue
                    for family, alphabet in enumerate(WIDEST):
                        if all(c in alphabet for c in set(token)):
                            words[class_of(family, end - start), bin_of(randomness(token, alphabet))] += 1
            c, b = np.nonzero(words + candidates)
            yield [c.astype(np.int32), b.astype(np.int32), words[c, b], candidates[c, b]]

        return work

    counted = map_batches(docs.select(F.col(text_col).cast("string").alias("t")), make, "class int, bin int, words bigint, candidates bigint")
    return counted.groupBy("class", "bin").agg(F.sum("words").alias("words"), F.sum("candidates").alias("candidates"))


def model_counts(letters: dict[int, int]) -> list[tuple[int, int, int, int]]:
    """(class, bin, words, 0) of the letter model, from the number of times each letter occurs; the same on every call."""
    often = np.array([letters.get(k, 0) for k in range(len(LOWER))], np.float64)
    shares = often / often.sum() if often.sum() else np.full(len(LOWER), 1 / len(LOWER))
    draw = np.random.default_rng(7)
    out = []
    for n in (SHORTEST, *LENGTH_CLASSES):
        drawn = ["".join(LOWER[k] for k in row) for row in draw.choice(len(LOWER), (MODEL_WORDS, n), p=shares).tolist()]
        for family, alphabet in enumerate(WIDEST):
            bins = [bin_of(randomness(w if w[0] in alphabet else w.upper(), alphabet)) for w in drawn]
            found, times = np.unique(bins, return_counts=True)
            out += [(class_of(family, n), b, w, 0) for b, w in zip(found.tolist(), times.tolist())]
    return out


def fitted_bars(counts: list[tuple[int, int, int, int]], rate: float = FALSE_DISCOVERY) -> list[int]:
    """Bars of the counts of a corpus, joined by the words of its letter model."""
    total: dict[tuple[int, int], tuple[int, int]] = {}
    seen = [r for r in counts if r[0] != LETTERS]
    for c, b, w, k in [*seen, *model_counts({b: w for c, b, w, _ in counts if c == LETTERS})] if any(r[3] for r in seen) else seen:
        words, candidates = total.get((c, b), (0, 0))
        total[c, b] = (words + w, candidates + k)
    return bars([(c, b, w, k) for (c, b), (w, k) in total.items()], rate)


def bars(counts: list[tuple[int, int, int, int]], rate: float = FALSE_DISCOVERY) -> list[int]:
    """Per class, the lowest bin whose candidates are discoveries (``BINS`` for none)."""
    words, candidates = (np.zeros((CLASSES, BINS), np.int64) for _ in range(2))
    for c, b, w, k in counts:
        words[c, b], candidates[c, b] = w, k
    found = []
    for w, k in zip(words, candidates):
        above = np.cumsum(k[::-1])[::-1]
        p = (1 + np.cumsum(w[::-1])[::-1]) / (1 + w.sum())
        good = np.flatnonzero((above > 0) & (p <= rate * above / max(1, k.sum())))
        found.append(int(good[0]) if len(good) else BINS)
    return found


def all_spans(text: str, bar: list[int]) -> list[tuple[int, int, str]]:
    """Base spans and the discoveries that overlap none of them."""
    base = base_spans(text)
    spans = list(base)
    for start, end, token in long_runs(text):
        if is_word(token) or any(s < end and start < e for s, e, _ in base):
            continue
        family, alphabet = infer(token)
        if bin_of(randomness(token, alphabet)) >= bar[class_of(family, end - start)]:
            spans.append((start, end, "random"))
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def find(docs: DataFrame, out: str, *, text_col: str = "text", rate: float = FALSE_DISCOVERY) -> DataFrame:
    """``docs`` with a column ``out`` of all spans."""
    bar = fitted_bars([tuple(r) for r in null_counts(docs, text_col).select("class", "bin", "words", "candidates").collect()], rate)

    def make():
        def work(batch: pa.RecordBatch) -> list:
            return [[[{"kind": k, "start": s, "end": e} for s, e, k in all_spans(t, bar)] for t in texts_of(batch, text_col)]]

        return work

    return with_columns(docs, [T.StructField(out, SPANS)], make)


def report(docs: DataFrame) -> DataFrame:
    """Per document: base matches by kind, their digest, and all spans."""
    spans = find(docs.select("doc_id", "text"), "spans")
    text = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return spans.select("doc_id", *map(count, KINDS[:3]), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, *, text_col: str = "text", chars_col: str = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns, with every secret replaced by ``mark`` and the character count brought up to date."""
    out, spans_col = docs.columns, free_name(docs, "secrets")
    found = find(docs, spans_col, text_col=text_col)

    def make():
        def work(batch: pa.RecordBatch) -> list:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            return [[cut(t, s, mark) if s else t for t, s in zip(texts, batch.column(batch.schema.get_field_index(spans_col)).to_pylist())]]

        return work

    clean_col = free_name(found, "redacted")
    clean = with_columns(found, [T.StructField(clean_col, T.StringType())], make).withColumn(text_col, F.col(clean_col))
    if chars_col in out:
        touched = F.size(spans_col) > 0
        clean = clean.withColumn(chars_col, F.when(touched, F.length(text_col)).otherwise(F.col(chars_col)).cast(docs.schema[chars_col].dataType))
    return clean.select(*out)


def cut(text: str, spans: list[dict], mark: str) -> str:
    """The text with each stretch that spans cover replaced once."""
    parts, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= at:
            parts += [text[at : s["start"]], mark]
        at = max(at, s["end"])
    return "".join([*parts, text[at:]])
