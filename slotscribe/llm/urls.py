"""URL filter: host and path rules first, then a character language-model ratio.

Column functions, joins and aggregates only. URLs that a rule allows or blocks
train two smoothed variable-order Markov models over characters: the probability
of a character after its last ``ORDER`` characters is that context's counts plus
``SMOOTHING`` times the probability after one character less, down to a uniform
law. A URL's score is the mean log ratio per character of both models. Half of
the rule-judged URLs (by hash) give the counts, the other half calibrates the
bar, halfway between the mean scores of both kinds in units of their spread.

The counts are kept as a table of character groups and joined, never collected:
they grow with the pages. Groups that make up more than one ``COMMON``-th of all
characters, of which there can be no more than ``COMMON``, are broadcast; the
others are joined by sorting, and none of them is a hot key. Distinct URLs are
scored once, so a URL that many pages share is one row.

Defined results: a NULL URL, or one without ``://``, has empty host and path, no
rule, and score 0; a URL with nothing after ``://`` too. While the rules judge
no URL of one kind, everything else is allowed. Longest rule wins; of equally
long ones the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

# (verdict, host and path): fixed values of the query.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
# Rules are one CASE expression; longer lists need a join.
MAX_RULES = 1_000
ORDER = 4
SMOOTHING = 4.0
ALPHABET = 256.0
# A group with more than this part of all characters is common.
COMMON = 50_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
AFTER = r"(?s)^.*?://(.*)$"
# Stands before the first character.
START = "\u0002"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rule_of(host_col: Column, path_col: Column, rules=RULES) -> Column:
    """Index of the longest rule that fits, NULL without one."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules fit in one expression")
    found = F.lit(None).cast("int")
    for i in sorted(range(len(rules)), key=lambda i: (len(rules[i][1]), -i)):
        name, slash, rest = rules[i][1].partition("/")
        fits = ((host_col == name) | F.endswith(host_col, F.lit("." + name))) & F.startswith(path_col, F.lit(slash + rest))
        found = F.when(fits, F.lit(i)).otherwise(found)
    return found


def groups(text: Column) -> Column:
    """Every character with the ``ORDER`` characters before it, as an array in linear time."""
    padded = F.split(F.concat(F.lit(START * ORDER), text), "")
    runs = F.arrays_zip(*[F.slice(padded, k + 1, F.greatest(F.char_length(text), F.lit(0))).alias(str(k)) for k in range(ORDER + 1)])
    return F.transform(runs, lambda z: F.concat(*[z[str(k)] for k in range(ORDER + 1)]))


def ratios(counts: DataFrame) -> DataFrame:
    """(gram, ratio): log ratio of both models for every group of ``ORDER`` + 1 characters.

    ``counts`` has (gram, allow, block). Each order's table is built from the
    one below by joins on the last characters and on the context.
    """
    below = None
    for k in range(ORDER + 1):
        own = counts.groupBy(F.right("gram", F.lit(k + 1)).alias("gram")).agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
        context = F.left("gram", F.lit(k))
        totals = own.groupBy(context.alias("context")).agg(F.sum("allow").alias("all_allow"), F.sum("block").alias("all_block"))
        joined = own.withColumn("context", context).join(totals.hint("merge"), "context")
        if below is None:
            prior = {x: F.lit(1.0 / ALPHABET) for x in ("allow", "block")}
        else:
            joined = joined.withColumn("shorter", F.right("gram", F.lit(k))).join(below.hint("merge"), "shorter")
            prior = {x: F.col(f"p_{x}") for x in ("allow", "block")}
        p = {x: (F.col(x) + SMOOTHING * prior[x]) / (F.col(f"all_{x}") + SMOOTHING) for x in ("allow", "block")}
        below = joined.select(F.col("gram").alias("shorter"), p["allow"].alias("p_allow"), p["block"].alias("p_block"))
    return below.select(F.col("shorter").alias("gram"), (F.ln("p_allow") - F.ln("p_block")).alias("ratio"))


def scores(grams: DataFrame, counts: DataFrame) -> DataFrame:
    """(url, score): the mean ratio over the groups of every URL that has any.

    ``counts`` has (gram, allow, block, n), n over all URLs. The size of a file
    says little about its rows, so no side is left to the planner to broadcast.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    model = stage(counts.select("gram", "n").join(ratios(counts).hint("merge"), "gram"), "ratios")
    common = model.where(F.col("n") * COMMON > total).select("gram", "ratio")
    rare = model.where(F.col("n") * COMMON <= total).select("gram", "ratio")
    sums = [F.sum("ratio").alias("ratio"), F.count("*").alias("n")]
    parts = [
        grams.select("url", "gram").join(F.broadcast(common), "gram").groupBy("url").agg(*sums),
        grams.select("url", "gram").join(F.broadcast(common), "gram", "left_anti").join(rare.hint("merge"), "gram").groupBy("url").agg(*sums),
    ]
    return parts[0].unionByName(parts[1]).groupBy("url").agg((F.sum("ratio") / F.sum("n")).alias("score"))


def judge(pages: DataFrame, rules=RULES, *, url_col: str = "url") -> DataFrame:
    """(url, host, path, rule, verdict, score) of every distinct URL, NULL included."""
    urls = pages.select(F.col(url_col).cast("string").alias("url")).distinct()
    parts = urls.select("url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    names = F.array(*[F.lit(r) for _, r in rules]) if rules else F.array(F.lit(None).cast("string"))
    verdicts = F.array(*[F.lit(v) for v, _ in rules]) if rules else F.array(F.lit(None).cast("string"))
    index = rule_of(F.col("host"), F.col("path"), rules)
    ruled = parts.withColumn("i", index).select("url", "host", "path", F.get(names, "i").alias("rule"), F.get(verdicts, "i").alias("ruled"))
    half = F.pmod(F.crc32(F.col("url").cast("binary")), F.lit(2))
    known = stage(ruled.withColumn("half", F.when(F.col("ruled").isNotNull(), half)), "urls")

    after = F.regexp_extract(F.coalesce("url", F.lit("")), AFTER, 1)
    grams = known.select("url", "ruled", "half", F.explode(groups(after)).alias("gram"))
    train = lambda v: F.sum(F.when((F.col("ruled") == v) & (F.col("half") == 0), 1.0).otherwise(0.0)).alias(v)
    counts = stage(grams.groupBy("gram").agg(train("allow"), train("block"), F.count("*").alias("n")), "grams")
    rated = stage(known.join(scores(grams, counts).hint("merge"), "url", "left").withColumn("score", F.coalesce("score", F.lit(0.0))), "scores")

    kinds = {r["ruled"]: r for r in rated.where("half = 1").groupBy("ruled").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("spread")).collect()}
    bar = float("-inf")
    if len(kinds) == 2:
        a, b = kinds["allow"], kinds["block"]
        widths = a["spread"] + b["spread"]
        bar = (a["mean"] * b["spread"] + b["mean"] * a["spread"]) / widths if widths > 0 else (a["mean"] + b["mean"]) / 2
    model_verdict = F.when(F.col("score") >= F.lit(bar), "allow").otherwise("block")
    return rated.select("url", "host", "path", "rule", F.coalesce("ruled", model_verdict).alias("verdict"), "score")


def report(pages: DataFrame) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    judged = judge(pages)
    ids = pages.select("page_id", F.col("url").cast("string").alias("page_url"))
    joined = ids.join(judged.hint("merge"), F.col("page_url").eqNullSafe(F.col("url")))
    return joined.select("page_id", "host", "path", "rule", "verdict")
