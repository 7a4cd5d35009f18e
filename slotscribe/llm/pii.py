"""Personal data by weak supervision, with column functions only.

Candidates are the matches of four base patterns and of three wider ones. Four
labelers vote on each (1 for, -1 against, 0 silent): the structure (checksum,
number ranges), a gazetteer (top-level domains, calling codes, issuer numbers),
cue words before the candidate, and its neighbouring characters. The votes of
all documents are counted by pattern; expectation-maximisation estimates for
each labeler how often it is right, without any labelled data, and the
probability of each vote pattern. Those probabilities train the span classifier,
a naive Bayes model over surface features, which decides on the candidates that
are not base spans already. Base spans always stay.

Positions come from splitting at the same pattern: the lengths of the pieces
and matches before a match, summed by a window.

The driver sees counts by vote pattern and by feature value only: a fixed number
of rows, whatever the number of documents.

Defined results: NULL and empty texts have no spans; added spans that overlap a
base span are dropped; of added spans that overlap one another all stay; repeated
documents are judged each on their own.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

KINDS = ("email", "ip", "card", "phone")
# Base patterns. Repeats are possessive, and a local part or number starts at its
# run's first character or where the last match ended: the same matches, in linear time.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Wider patterns: spelled-out addresses, numbers without a plus, addresses of the newer protocol.
WIDE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[a-z0-9-]{1,63}(?:\x20?(?:\(dot\)|\[dot\]|\x20dot\x20|\.)\x20?[a-z0-9-]{2,63}){1,4}",
    "phone": r"(?<![0-9+(.-])(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])",
    "ip": r"(?i)(?<![0-9a-f:])(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}(?![0-9a-f:])",
}
# What a text must contain for a pattern to be tried at all.
NEEDS = {("email", True): "@", ("phone", True): "+", ("ip", False): ":"}

# Gazetteers and cue words.
DOMAINS = "com org net edu gov mil int info biz io de fr es it uk nl be ch at pl se no dk fi pt cz ru cn jp kr in br mx ar au ca us eu".split()
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
ISSUERS = "4 51 52 53 54 55 22 23 24 25 26 27 34 37 36 38 6011 65 35 62".split()
CUES = {
    "email": r"(?i)(?:e-?mail|contact|write|reach|kontakt|correo|courriel|adresse)",
    "ip": r"(?i)(?:\bip\b|address|server|host|client|from|ping)",
    "card": r"(?i)(?:card|visa|mastercard|credit|karte|tarjeta|carte|payment)",
    "phone": r"(?i)(?:phone|call|tel|mobile|fax|whatsapp|anruf|llam|appel)",
}
AGAINST = r"(?i)(?:version|isbn|issn|order|invoice|serial|build|release|section|page|doi|\bv\.?|\bid)[\x20:#]{0,3}$"
TAIL, HEAD = 32, 8
EM_ROUNDS = 50
LABELERS = ("structure", "gazetteer", "cue", "edges")
FEATURES = ("length", "digits", "marks", "before", "after")


def _candidates(text: Column, kind: str, base: bool) -> Column:
    """Array of (kind, base, idx, value, gap, tail, head): matches with what precedes them.

    Entry i holds match i and piece i; the last has the text after the last match.
    """
    pattern = (BASE if base else WIDE)[kind]
    zipped = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("piece"))
    rows = F.transform(zipped, lambda z, i: F.struct(
        F.lit(kind).alias("kind"), F.lit(base).alias("base"), i.alias("idx"), z["found"].alias("value"),
        F.char_length(z["piece"]).cast("bigint").alias("gap"), F.right(z["piece"], F.lit(TAIL)).alias("tail"), F.left(z["piece"], F.lit(HEAD)).alias("head"),
    ))
    rows = F.filter(rows, lambda r: r["value"].isNotNull() | (r["idx"] > 0))
    needed = NEEDS.get((kind, base))
    return F.when(F.contains(text, F.lit(needed)), rows) if needed else rows


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Checksum of digit strings of card length."""
    places = F.split(F.reverse(digits), "")
    doubled = F.transform(places, lambda d, i: d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1))
    return F.aggregate(doubled, F.lit(0), lambda t, d: t + d - F.when(d > 9, 9).otherwise(0)) % 10 == 0


def valid(kind: Column, value: Column) -> Column:
    """Whether a base match meets the conditions of its kind."""
    digits = _digits(value)
    n = F.char_length(digits)
    parts = F.split(value, r"\.")
    in_range = F.forall(parts, lambda p: (F.char_length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    return (
        F.when(kind == "email", True).when(kind == "ip", in_range)
        .when(kind == "card", F.when(n.between(16, 19), _luhn(digits)).otherwise(False))
        .otherwise(n.between(8, 15))
    )


def candidates(docs: DataFrame) -> DataFrame:
    """One row per candidate of (rid, kept, text) with its place, and one without a candidate for every document."""
    text = F.coalesce("text", F.lit(""))
    none = F.array().cast("array<struct<kind:string,base:boolean,idx:int,value:string,gap:bigint,tail:string,head:string>>")
    lists = [F.coalesce(_candidates(text, kind, base), none) for base in (True, False) for kind in (BASE if base else WIDE)]
    rows = docs.select("rid", "kept", F.explode_outer(F.concat(*lists)).alias("found")).select("rid", "kept", "found.*")
    order = Window.partitionBy("rid", "kind", "base").orderBy("idx")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    start = F.sum("gap").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.sum(F.char_length("value")).over(before), F.lit(0))
    placed = rows.withColumn("start", start).withColumn("next", F.lead("head").over(order))
    placed = placed.where(F.col("value").isNotNull() | F.col("kind").isNull())
    return placed.select("rid", "kept", "kind", "base", "value", "tail", "next", "start", (F.col("start") + F.char_length("value")).alias("end"))


def votes() -> list[Column]:
    """The labelers, in the order of ``LABELERS``."""
    kind, value, tail, after = (F.col(c) for c in ("kind", "value", "tail", "next"))
    digits = _digits(value)
    structure = F.when(F.col("base"), F.when(valid(kind, value), 1).otherwise(-1)).when(
        (kind == "phone") & F.char_length(digits).between(9, 11), 1
    ).otherwise(0)
    top = F.lower(F.regexp_extract(value, r"([A-Za-z0-9-]+)$", 1))
    listed = lambda options: F.exists(F.array(*[F.lit(o) for o in options]), lambda o: F.startswith(digits, o))
    gazetteer = (
        F.when(kind == "email", F.when(top.isin(DOMAINS), 1).otherwise(-1))
        .when((kind == "card") & F.char_length(digits).between(12, 19), F.when(listed(ISSUERS), 1).otherwise(-1))
        .when((kind == "phone") & F.startswith(value, F.lit("+")), F.when(listed(CALLING_CODES), 1).otherwise(-1))
        .otherwise(0)
    )
    cue = F.when(F.regexp_like(tail, F.lit(AGAINST)), -1)
    for k in KINDS:
        cue = cue.when((kind == k) & F.regexp_like(tail, F.lit(CUES[k])), 1)
    joined = F.regexp_like(F.right(tail, F.lit(1)), F.lit(r"[\p{L}\p{N}_/]")) | F.regexp_like(F.left(F.coalesce(after, F.lit("")), F.lit(1)), F.lit(r"[\p{L}\p{N}_/]"))
    edges = F.when(joined, -1).when(F.regexp_like(tail, F.lit(r"(?:^|\s)$")), 1).otherwise(0)
    return [structure.alias("structure"), gazetteer.alias("gazetteer"), cue.otherwise(0).alias("cue"), edges.alias("edges")]


def surface() -> list[Column]:
    """Features of the final classifier: small sets of values that do not repeat the votes."""
    value, tail, after = (F.col(c) for c in ("value", "tail", "next"))
    kind_of = lambda c: F.when(c == "", "none").when(F.regexp_like(c, F.lit(r"\s")), "space").when(F.regexp_like(c, F.lit(r"[\p{L}\p{N}]")), "letter").otherwise("mark")
    bucket = lambda c: F.least(F.floor(F.log2(c + 1.0) * 2), F.lit(14)).cast("string")
    return [
        bucket(F.char_length(value)).alias("length"), bucket(F.char_length(_digits(value))).alias("digits"),
        F.least(F.char_length(F.regexp_replace(value, r"[\p{L}\p{N}]", "")), F.lit(9)).cast("string").alias("marks"),
        kind_of(F.right(tail, F.lit(1))).alias("before"), kind_of(F.left(F.coalesce(after, F.lit("")), F.lit(1))).alias("after"),
    ]


def estimate(patterns: list[tuple[tuple[int, ...], int]]) -> dict[tuple[int, ...], float]:
    """Probability of each vote pattern being right, by expectation-maximisation over their counts."""
    share, right = 0.5, [{True: {1: 0.7, 0: 0.2, -1: 0.1}, False: {1: 0.2, 0: 0.3, -1: 0.5}} for _ in LABELERS]
    posterior: dict[tuple[int, ...], float] = {}
    for _ in range(EM_ROUNDS):
        for votes_, _n in patterns:
            good = math.log(share) + sum(math.log(r[True][v]) for r, v in zip(right, votes_))
            bad = math.log(1 - share) + sum(math.log(r[False][v]) for r, v in zip(right, votes_))
            posterior[votes_] = 1 / (1 + math.exp(min(bad - good, 500)))
        total = sum(n for _, n in patterns)
        share = min(0.99, max(0.01, (sum(posterior[v] * n for v, n in patterns) + 1) / (total + 2)))
        for k, r in enumerate(right):
            for truth in (True, False):
                weights = {v: 1.0 for v in (1, 0, -1)}
                for votes_, n in patterns:
                    weights[votes_[k]] += n * (posterior[votes_] if truth else 1 - posterior[votes_])
                r[truth] = {v: w / sum(weights.values()) for v, w in weights.items()}
    return posterior


def find(docs: DataFrame, out: str, *, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with a column ``out``: all spans (kind, base, start, end)."""
    kept = F.struct(*[c for c in docs.columns if c != text_col], F.lit(True).alias("row__"))
    found = candidates(docs.select(F.monotonically_increasing_id().alias("rid"), kept.alias("kept"), F.col(text_col).cast("string").alias("text")))
    there = F.col("kind").isNotNull()
    known = stage(found.select("rid", "kept", "kind", "base", "start", "end", F.when(there & F.col("base"), valid(F.col("kind"), F.col("value"))).otherwise(False).alias("sure"), *votes(), *surface()), "personal")

    counted = known.where("kind is not null").groupBy("kind", *LABELERS).count().collect()
    posterior = {}
    for kind in KINDS:
        patterns = [(tuple(r[x] for x in LABELERS), r["count"]) for r in counted if r["kind"] == kind]
        posterior |= {(kind, *v): p for v, p in estimate(patterns).items()} if patterns else {}
    chance = F.lit(0.0)
    for (kind, *v), p in posterior.items():
        same = reduce(Column.__and__, [F.col(x) == y for x, y in zip(LABELERS, v)], F.col("kind") == kind)
        chance = F.when(same, F.lit(p)).otherwise(chance)

    # Naive Bayes from soft labels: one row per kind, feature and value.
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("level")) for f in FEATURES])).alias("cell")
    soft = known.where("kind is not null").withColumn("p", chance).select("kind", "p", cells).groupBy("kind", "cell.feature", "cell.level")
    weights: dict[tuple[str, str, str], tuple[float, float]] = {}
    for r in soft.agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect():
        weights[r["kind"], r["feature"], r["level"]] = (r["yes"], r["no"])
    logit = F.lit(0.0)
    for kind in {k for k, _, _ in weights}:
        totals = [sum(w[i] for (k, f, _), w in weights.items() if k == kind and f == FEATURES[0]) for i in (0, 1)]
        own = F.lit(math.log((totals[0] + 1) / (totals[1] + 1)))
        for f in FEATURES:
            level = F.lit(0.0)
            for (k, g, x), (yes, no) in weights.items():
                if (k, g) == (kind, f):
                    level = F.when(F.col(f) == x, F.lit(math.log((yes + 1) / (totals[0] + 2) * (totals[1] + 2) / (no + 1)))).otherwise(level)
            own = own + level
        logit = F.when(F.col("kind") == kind, own).otherwise(logit)

    chosen = known.withColumn("added", ~F.col("base") & (logit > 0))
    span = lambda c: F.collect_list(F.when(c, F.struct(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int").alias("k"), "start", "end", "kind", "base")))
    grouped = chosen.groupBy("rid").agg(F.first("kept").alias("kept"), span(F.col("sure")).alias("sure"), span(F.col("added")).alias("added"))
    extra = F.filter("added", lambda a: ~F.exists("sure", lambda s: (s["start"] < a["end"]) & (a["start"] < s["end"])))
    spans = F.transform(F.array_sort(F.concat("sure", extra)), lambda s: F.struct(s["kind"].alias("kind"), s["base"].alias("base"), s["start"].alias("start"), s["end"].alias("end")))
    return grouped.select("kept.*", spans.alias(out)).drop("row__")


def report(docs: DataFrame) -> DataFrame:
    """Per document: base spans by kind, their digest, and all spans."""
    found = find(docs.select("doc_id", "text"), "spans")
    text = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: (s["kind"] == k) & s["base"])).cast("bigint").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["base"])
    return found.select("doc_id", *map(count, KINDS), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
