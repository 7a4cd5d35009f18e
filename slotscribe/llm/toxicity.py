"""Toxicity by maximum-scoring segments.

Every word has a log-odds score. Counts of toxic and clean training texts are
smoothed by Dirichlet priors in a chain: a word's prior is its six-letter
prefix, whose prior is the five-letter one, then four letters, then even odds;
the weight of a prior grows with how common the feature is in the whole corpus.
So an inflected form of a toxic stem scores high before it has been seen.

A linear-time scan finds all maximal segments of positive total score in a text.
Under clean text the best segment of n words follows an extreme-value law,
P(S > x) = 1 - exp(-K n exp(-lambda x)); lambda and K are fitted on clean
training texts. A segment is significant when fewer than ``SIGNIFICANT`` as good
are expected by chance, and a text's evidence is the sum of its significant
segments' log improbabilities. A logistic curve turns evidence into a score.

The classifier is fitted on at most ``SAMPLE`` labelled rows (a documented
bound), those with the smallest hash of doc_id, and on every word and segment of
their whole texts. Of them the rows with crc32(doc_id) mod 4 in (0, 1) give the
counts, those with 3 the calibration, and 2 is held out. How common features are
is counted over all documents.

Defined results: NULL and empty texts have no words and no evidence and get the
curve's lowest score; NULL labels teach nothing; without labels of both kinds
every score is 0; repeated rows are scored each on their own; a NULL doc_id is
not held out.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, map_batches, settings, small_batches, stage, texts_of, with_columns

SAMPLE = 20_000
THRESHOLD = 0.3
PREFIXES = (4, 5, 6)
# Weight of a prior, and what the commonest features add to it.
PRIOR, PRIOR_CORPUS = 1.0, 1_000.0
# Subtracted from each word's log-odds, so that clean text drifts down.
DRIFT = 1.5
# Features seen less often in toxic texts keep the score of their prefix.
LEAST_TOXIC = 2
SIGNIFICANT = 0.05
# Words a task remembers.
REMEMBERED = 200_000

WORDS = re.compile(r"\w+")


def words(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def features(word: str) -> list[str]:
    """Prefixes from the shortest, marked by a star, and then the word."""
    return [word[:n] + "*" for n in PREFIXES if len(word) > n] + [word]


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring subsequences, (first, end, total), in linear time.

    Only positive entries are visited; the totals between them come from one
    cumulative sum. Each candidate keeps the total to its left and right end;
    it is joined to the nearest one whose left total is lower as long as that
    raises the right total.
    """
    total = np.r_[0.0, np.cumsum(scores)]
    stack: list[tuple[int, int, float, float]] = []
    for i in np.flatnonzero(scores > 0).tolist():
        first, end, left, right = i, i + 1, float(total[i]), float(total[i + 1])
        while True:
            # Candidates whose left total is not lower can never be joined to this one or a later one.
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j -= 1
            if j < 0 or stack[j][3] >= right:
                stack.append((first, end, left, right))
                break
            first, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(first, end, right - left) for first, end, left, right in stack]


@dataclass
class Model:
    """Scores of features, the extreme-value law and the curve; bounded by the training sample."""

    odds: dict[str, float] = field(default_factory=dict)
    decay: float = 1.0
    scale: float = 1.0
    slope: float = 0.0
    offset: float = -1e9
    known: dict[str, float] = field(default_factory=dict, repr=False)

    def word_score(self, word: str) -> float:
        """Score of the longest known feature, less the drift."""
        for f in reversed(features(word)):
            if f in self.odds:
                return self.odds[f] - DRIFT
        return -DRIFT

    def scores(self, found: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for w in set(found).difference(known):
            known[w] = self.word_score(w)
        return np.fromiter(map(known.__getitem__, found), dtype=np.float64, count=len(found))

    def passages(self, found: list[str]) -> list[tuple[int, int, float]]:
        """(first word, end word, log improbability) of the significant segments."""
        chance = math.log(max(self.scale * len(found), 1e-300)) if found else 0.0
        bound = -math.log(SIGNIFICANT)
        rated = [(a, b, self.decay * s - chance) for a, b, s in maximal_segments(self.scores(found))]
        return [r for r in rated if r[2] > bound]

    def evidence(self, found: list[str]) -> float:
        return float(sum(e for _, _, e in self.passages(found)))

    def probability(self, evidence: float) -> float:
        z = self.offset + self.slope * evidence
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def fold(id_col: str) -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(4))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int, id_col: str, text_col: str) -> DataFrame:
    """(text, toxic, fold) of the sample, which is small enough to be broadcast to the documents."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).withColumn("fold", fold("doc_id")).where("fold <> 2")
    picked = usable.select("doc_id", "toxic", "fold").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    return texts.join(F.broadcast(picked), "doc_id").select("t", "toxic", "fold")


def class_counts(rows: DataFrame) -> DataFrame:
    """(feature, toxic, clean): occurrences in the texts of each class."""
    def make():
        def work(batch: pa.RecordBatch):
            counts: dict[str, list[int]] = {}
            for text, toxic in zip(texts_of(batch, "t"), batch.column(1).to_pylist()):
                for w in words(text):
                    for f in features(w):
                        counts.setdefault(f, [0, 0])[toxic] += 1
            yield [list(counts), [c[1] for c in counts.values()], [c[0] for c in counts.values()]]

        return work

    counted = map_batches(rows.select("t", "toxic"), make, "feature string, toxic bigint, clean bigint")
    return counted.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def corpus_counts(docs: DataFrame, wanted: list[str], text_col: str) -> DataFrame:
    """(feature, n) over all documents; the NULL feature counts all words."""
    shipped = docs.sparkSession.sparkContext.broadcast(wanted)

    def make():
        own = set(shipped.value)
        of: dict[str, list[str]] = {}

        def work(batch: pa.RecordBatch):
            seen: dict[str, int] = {}
            total = 0
            if len(of) > REMEMBERED:
                of.clear()
            for text in texts_of(batch, "t"):
                found = words(text)
                total += len(found)
                for w in found:
                    seen[w] = seen.get(w, 0) + 1
            counts: dict[str, int] = {}
            for w, n in seen.items():
                if w not in of:
                    of[w] = [f for f in features(w) if f in own]
                for f in of[w]:
                    counts[f] = counts.get(f, 0) + n
            yield [[None, *counts], [total, *counts.values()]]

        return work

    counted = map_batches(docs.select(F.col(text_col).cast("string").alias("t")), make, "feature string, n bigint")
    return counted.groupBy("feature").agg(F.sum("n").alias("n"))


def fit_odds(classes: dict[str, tuple[int, int]], totals: tuple[int, int], corpus: dict[str | None, int]) -> dict[str, float]:
    """Log-odds of all features, shortest first so that each finds its prior."""
    scale = totals[0] / max(1, totals[1])
    everything = max(1, corpus.get(None, 0))
    odds: dict[str, float] = {}

    def prior(f: str) -> float:
        stem = f.rstrip("*")
        for n in sorted(PREFIXES, reverse=True):
            shorter = stem[:n] + "*"
            if n < len(stem) and shorter != f and shorter in odds:
                return odds[shorter]
        return 0.0

    for f in sorted(classes, key=lambda f: (not f.endswith("*"), len(f))):
        toxic, clean = classes[f]
        even = 1 / (1 + math.exp(-prior(f)))
        weight = PRIOR + PRIOR_CORPUS * corpus.get(f, 0) / everything
        odds[f] = math.log((toxic + 2 * weight * even) / (clean * scale + 2 * weight * (1 - even)))
    return odds


def fit_tail(best: list[tuple[int, float]], scores: np.ndarray, counts: np.ndarray | None = None) -> tuple[float, float]:
    """lambda and K of the law of the best segment, from clean texts.

    lambda solves E[exp(lambda x)] = 1 over the words' scores, of which each
    occurs ``counts`` times; K then makes the expected number of chance segments
    match the observed best ones.
    """
    low, high = 1e-3, 20.0
    mean = lambda v: float(np.average(np.exp(np.minimum(v * scores, 600.0)), weights=counts))
    if not (scores > 0).any() or mean(high) < 1:
        decay = 1.0
    else:
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (middle, high) if mean(middle) < 1 else (low, middle)
        decay = (low + high) / 2
    # With E = K n exp(-lambda S) standard exponential, K is the inverse mean of n exp(-lambda S).
    weights = [n * math.exp(-decay * s) for n, s in best if n]
    return decay, len(weights) / max(sum(weights), 1e-12) if weights else 1.0


def fit_curve(evidence: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton steps with a small ridge."""
    x = np.log1p(evidence)
    design, beta = np.stack([x, np.ones_like(x)], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (toxic - p) - 1e-2 * beta
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        beta = beta + np.linalg.solve(hessian, gradient)
    return float(beta[0]), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Train on the labelled sample; corpus counts are over all of ``docs``."""
    rows = stage(training_rows(docs, labels, sample, id_col, text_col), "labelled")
    # With the sample, the features of its toxic half are bounded too.
    counted = class_counts(rows.where("fold <> 3")).persist()
    totals = counted.where(~F.col("feature").endswith("*")).agg(F.sum("toxic"), F.sum("clean")).first()
    kept = counted.where(F.col("toxic") >= LEAST_TOXIC).collect()
    counted.unpersist()
    classes = {r["feature"]: (r["toxic"], r["clean"]) for r in kept}
    if not classes or not totals[1]:
        return Model()
    with settings(docs.sparkSession, small_batches(docs.sparkSession)):
        corpus = {r["feature"]: r["n"] for r in corpus_counts(docs, list(classes), text_col).collect()}
    model = Model(odds=fit_odds(classes, (totals[0], totals[1]), corpus))
    calibration = rows.where("fold = 3")
    # As many rows as features have different scores, which the sample bounds.
    scores = word_scores(calibration.where("toxic = 0"), model).orderBy("score").collect()
    best = best_segments(calibration, model).collect()
    clean = [(r["n"], r["best"]) for r in best if r["toxic"] == 0]
    if not clean or len(clean) == len(best):
        return Model()
    if scores:
        model.decay, model.scale = fit_tail(clean, np.array([r["score"] for r in scores]), np.array([float(r["n"]) for r in scores]))
    rated = evidence_of(calibration, model).collect()
    model.slope, model.offset = fit_curve(np.array([r["evidence"] for r in rated]), np.array([float(r["toxic"]) for r in rated]))
    return model


def word_scores(rows: DataFrame, model: Model) -> DataFrame:
    """(score, n): how many words of the whole texts have each score."""
    shipped = rows.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shipped.value

        def work(batch: pa.RecordBatch):
            held: dict[float, int] = {}
            for text in texts_of(batch, "t"):
                for value, n in zip(*np.unique(own.scores(words(text)), return_counts=True)):
                    held[float(value)] = held.get(float(value), 0) + int(n)
            yield [list(held), list(held.values())]

        return work

    return map_batches(rows.select("t"), make, "score double, n bigint").groupBy("score").agg(F.sum("n").alias("n"))


def best_segments(rows: DataFrame, model: Model) -> DataFrame:
    """(toxic, n, best): words and best segment of every text."""
    shipped = rows.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shipped.value

        def work(batch: pa.RecordBatch):
            found = [words(text) for text in texts_of(batch, "t")]
            best = [max((s for _, _, s in maximal_segments(own.scores(f))), default=0.0) for f in found]
            yield [batch.column(1), [len(f) for f in found], best]

        return work

    return map_batches(rows.select("t", F.col("toxic").cast("int")), make, "toxic int, n bigint, best double")


def evidence_of(rows: DataFrame, model: Model) -> DataFrame:
    """(toxic, evidence): the sum over all significant segments of every text."""
    shipped = rows.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shipped.value

        def work(batch: pa.RecordBatch):
            yield [batch.column(1), [own.evidence(words(text)) for text in texts_of(batch, "t")]]

        return work

    return map_batches(rows.select("t", F.col("toxic").cast("int")), make, "toxic int, evidence double")


PASSAGE = T.StructType([T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType()), T.StructField("evidence", T.DoubleType())])
RESULT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("passages", T.ArrayType(PASSAGE))])


def score(docs: DataFrame, model: Model, out: str, *, text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``out``: the score and the significant passages of each text."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shipped.value

        def work(batch: pa.RecordBatch) -> list:
            rows = []
            for text in texts_of(batch, text_col):
                passages = own.passages(words(text))
                p = own.probability(math.log1p(sum(e for _, _, e in passages)))
                rows.append({"score": p, "passages": [{"first_word": a, "end_word": b, "evidence": e} for a, b, e in passages]})
            return [rows]

        return work

    return with_columns(docs, [T.StructField(out, RESULT)], make)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score and decision for every document."""
    model = fit(docs, labels)
    rated = score(docs.select("doc_id", "text"), model, "rated")
    return rated.select(
        "doc_id", (fold("doc_id") == 2).alias("held_out"), F.col("rated.score").alias("score"),
        (F.col("rated.score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_civil(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """The documents below the threshold, with the columns they came with."""
    out = free_name(docs, "toxicity")
    return score(docs, fit(docs, labels), out).where(F.col(out)["score"] < threshold).drop(out)
