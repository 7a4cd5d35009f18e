import pytest
from helpers import awkward, documents, rows, sha, words_of

from slotscribe.llm import decontaminate as op

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def brute(docs, items):
    windows = []
    for item, text in items:
        w = words_of(text, WORD)
        if w:
            n = min(10, len(w))
            windows += [(item, w[i : i + n]) for i in range(len(w) - n + 1)]
    out = []
    for i, text in docs:
        w = words_of(text, WORD)
        hit, found = set(), set()
        for item, win in windows:
            for k in range(len(w) - len(win) + 1):
                if w[k : k + len(win)] == win:
                    hit |= set(range(k, k + len(win)))
                    found |= {str(item)} if item is not None else set()
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


ITEMS = [
    (1, "A b c d e f g h i j k l"), (10, "a B c d e f g h i j"), (2, None), (3, ""), (4, "--- !"), (5, "été, Été"), (6, "plain words"),
    (7, "said twice"), (1, "A b c d e f g h i j k l"), (None, "漢字かな交じり文"), (8, "word word word word word word word word word word word"),
]


@pytest.fixture()
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id bigint, text string")


def test_equals_brute_force(spark, items):
    texts = [*awkward()[:8], *awkward()[9:], "x a-b-c-d-e-f-g-h-i-j-k-l y", "a b c d e f g h i", "une été Été ÉTÉ", "été ÉtÉ", "word " * 12, "été été"]
    docs = list(enumerate(texts)) + [(0, "a second row of one id"), (None, "plain words")]
    assert rows(op.report(documents(spark, docs), items)) == brute(docs, ITEMS)


@pytest.mark.parametrize("limit", [40, 100, 300])
def test_several_automata_find_the_same(spark, items, limit):
    docs = documents(spark, awkward())
    one, many = (op.scan(docs.select("doc_id", "text"), items, "found", max_bytes=m) for m in (op.MAX_PATTERN_BYTES, limit))
    assert rows(one, "doc_id", "found.n_words", "found.spans", "found.items") == rows(many, "doc_id", "found.n_words", "found.spans", "found.items")


def test_offsets_point_into_the_original(spark, items):
    text = "Öh! -- PLAIN, words (é) été: Été"
    span = op.scan(documents(spark, [text]), items, "found").first()["found"]["spans"]
    assert [text[s["start"] : s["end"]] for s in span] == ["été: Été"]


def test_empty_tables_and_clashing_columns(spark, items):
    none = documents(spark, []).where("false")
    assert op.report(none, items).count() == 0
    docs = documents(spark, awkward()).selectExpr("*", "1 as contamination", "2 as found", "3 as words")
    clean = op.keep_clean(docs, items)
    assert clean.columns == docs.columns
    assert op.keep_clean(docs, items.where("false")).count() == docs.count()
    assert {r["doc_id"] for r in clean.collect()} == {i for i, *_, bad in brute(list(enumerate(awkward())), ITEMS) if not bad}
