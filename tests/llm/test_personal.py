import re

from helpers import awkward, documents, rows, sha
import pytest

from slotscribe.llm import pii as op

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(len(p.lstrip("0")) > 3 or int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def shown(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


TEXTS = [
    "mail a.b+c@x-y.co.uk, or x@y or @z.com or a@b.c_d@e.f%g@h.i and ab@-.-.com.", "1.2.3.4.5.6.7.8 256.1.1.1 0001.002.3.255 1.2.3 99999999999.1.1.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 4146510152328576x 49927398716 4111111111111111 111", "+1 (414) 555-7134 +49.30.1234567- +1 23 +12345678901234567 ++1 555 123 4567",
    "é\U0001f600 漢 a@b.de +49 170 1234567 10.0.0.1", "x" * 300 + "@" + "y" * 300, "1" * 5_000 + "." + "2" * 40, "+" * 3_000 + "1 2", "a@b." * 2_000, "a.b@c.d@e.f@g.h",
    "call me at (212) 555-0187 or write john dot doe at mail dot com", "555-867-5309 is a phone number; version 10.2.3.4", "2001:0db8:85a3:0000:0000:8a2e:0370:7334",
]


@pytest.fixture(scope="module")
def texts():
    long_words = [t for t in awkward() if t is None or len(t) < 70_000]
    return [*TEXTS, *long_words, *(f"phone: +1 ({200 + k}) 555-{1000 + k} mail me.{k}@mail{k % 9}.example.com now" for k in range(60))]


def test_base_equals_brute_force(spark, texts):
    seen = 0
    for r in op.report(documents(spark, texts)).collect():
        want = base(texts[r["doc_id"]])
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(sum(k == x for k, *_ in want) for x in PATTERNS), texts[r["doc_id"]]
        assert r["base_sha256"] == sha(shown(want))
        assert {s for s in shown(want).split(",") if s} <= set(r["spans"].split(","))
        seen += 1
    assert seen == len(texts)


def test_weak_supervision_adds_and_leaves_out(spark, texts):
    extra = [f"call ({300 + k}) 555-{2000 + k} today" for k in range(30)] + [f"order 10{k}-555-{3000 + k}x in serial 20{k}.555.{4000 + k}y" for k in range(10, 40)]
    docs = documents(spark, [*texts, *extra])
    spans = {r["doc_id"]: r["spans"] for r in op.report(docs).collect()}
    n = len(texts)
    assert all(spans[n + k] == f"phone:5:{5 + len(f'({300 + k}) 555-{2000 + k}')}" for k in range(30))
    assert not any(spans[n + k] for k in range(30, 60))


def test_estimated_reliabilities():
    patterns = [((1, 1, 1, 1), 400), ((1, 0, 1, 1), 100), ((-1, -1, -1, -1), 400), ((-1, 0, 0, -1), 100), ((1, -1, -1, -1), 20)]
    p = op.estimate(patterns)
    assert p[1, 1, 1, 1] > 0.9 and p[1, 0, 1, 1] > 0.9 and p[-1, -1, -1, -1] < 0.1 and p[1, -1, -1, -1] < 0.5


def test_plan_has_no_python(spark):
    plan = op.report(documents(spark, TEXTS))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_repeated_rows_clashing_columns_and_empty_table(spark):
    docs = documents(spark, [(7, "a@b.com"), (7, "a@b.com"), (None, "c@d.org")])
    assert sorted((r["doc_id"] or 0, r["spans"]) for r in op.report(docs).collect()) == [(0, "email:0:7"), (7, "email:0:7"), (7, "email:0:7")]
    clashing = docs.selectExpr("*", "1 as rid__", "2 as c__")
    assert op.find(clashing, "found").columns == [c for c in clashing.columns if c != "text"] + ["found"]
    assert rows(op.report(docs.where("false"))) == []
