import math
import re
import zlib
from collections import defaultdict

import pytest
from helpers import rows

from slotscribe.llm import urls as op


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def ruled(url):
    host, path = parts(url)
    fits = []
    for verdict, rule in op.RULES:
        name, _, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else (None, None)


def grams(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    padded = op.START * op.ORDER + rest
    return [padded[k : k + op.ORDER + 1] for k in range(len(rest))]


def brute(urls):
    urls = set(urls)
    counts = {v: defaultdict(float) for v in ("allow", "block")}
    for u in urls:
        verdict = ruled(u)[1]
        if verdict and zlib.crc32(u.encode()) % 2 == 0:
            for g in grams(u):
                for k in range(op.ORDER + 1):
                    own = g[op.ORDER - k :]
                    counts[verdict]["gram", own] += 1
                    counts[verdict]["context", k, own[:-1]] += 1

    def p(verdict, g):
        value = 1 / op.ALPHABET
        for k in range(op.ORDER + 1):
            own = g[op.ORDER - k :]
            value = (counts[verdict]["gram", own] + op.SMOOTHING * value) / (counts[verdict]["context", k, own[:-1]] + op.SMOOTHING)
        return value

    score = {u: sum(math.log(p("allow", g) / p("block", g)) for g in grams(u)) / len(grams(u)) if grams(u) else 0.0 for u in urls}
    held = {v: [score[u] for u in urls if ruled(u)[1] == v and zlib.crc32(u.encode()) % 2 == 1] for v in ("allow", "block")}
    bar = -math.inf
    if all(held.values()):
        mean = {v: sum(x) / len(x) for v, x in held.items()}
        sd = {v: math.sqrt(sum((y - mean[v]) ** 2 for y in x) / len(x)) for v, x in held.items()}
        total = sd["allow"] + sd["block"]
        bar = (mean["allow"] * sd["block"] + mean["block"] * sd["allow"]) / total if total else (mean["allow"] + mean["block"]) / 2
    return {u: (*parts(u), ruled(u)[0], ruled(u)[1] or ("allow" if score[u] >= bar else "block")) for u in urls}, score


AWKWARD = [
    None, "", "no scheme", "http://", "http:///x", "http://net", "http://net/", "HTTP://A.Net/x?y#z", "http://notnet/en/", "x://y://example.net/en/",
    "http://EXAMPLE.com/de/x", "http://www.example.com/DE/x", "http://a.org?x=/fr/", "http://a.org/fr/#q", "http://user@a.org:80/fr/", "http://é漢\U0001f600.org/fr/ü",
    "http://example.net/en/", "https://example.net/en", "ftp://x.example.net/en/\nline", "http://" + "a" * 50_000 + ".org/fr/", "http://ÀA.net/",
]


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "<html>") for i, u in enumerate(urls)], "page_id bigint, url string, html string")


def test_equals_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    urls = [r["url"] for r in table.collect()] + AWKWARD * 2
    want, score = brute(urls)
    judged = op.judge(pages(spark, urls))
    for r in judged.collect():
        assert r["score"] == pytest.approx(score[r["url"]], abs=1e-9)
    assert rows(op.report(pages(spark, urls)), "page_id", "host", "path", "rule", "verdict") == sorted(
        ((i, *want[u]) for i, u in enumerate(urls)), key=lambda r: tuple((x is None, str(x)) for x in r)
    )


def test_without_labels_everything_is_allowed(spark):
    out = op.report(pages(spark, ["http://a.io/x", "http://b.io/y", None]))
    assert {r["verdict"] for r in out.collect()} == {"allow"}


def test_columns_repeats_and_empty_table(spark):
    docs = pages(spark, ["http://a.org/fr/x"] * 40 + [None] * 20).selectExpr("*", "1 as host", "2 as score", "3 as half", "4 as gram")
    assert op.report(docs).count() == 60
    assert op.report(docs.where("false")).count() == 0


def test_plan_has_no_python(spark):
    plan = op.report(pages(spark, AWKWARD))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_too_many_rules_are_refused(spark):
    with pytest.raises(ValueError):
        op.judge(pages(spark, AWKWARD), rules=[("block", f"h{i}/") for i in range(1_001)])
