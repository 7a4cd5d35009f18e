import ast
from pathlib import Path

import pyarrow as pa
import pytest
from test_bpe import PATH

import corpus_pipeline
import __spark_entry__ as entry
from slotscribe.llm import bpe, decontaminate, jaccard, queries, secrets, toxicity

SAMPLE = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]


def test_stages_are_the_operators_in_order(spark):
    docs = spark.read.parquet(f"{SAMPLE}/documents.parquet")
    bench, labels = (spark.read.parquet(f"{SAMPLE}/{t}.parquet") for t in ("benchmark", "labels"))
    now = docs
    for (name, function), rule in zip(corpus_pipeline.STAGES, ["toxicity", "jaccard", "benchmark", "secrets", "bpe"], strict=True):
        out = function(spark, now, SAMPLE).cache()
        if rule == "toxicity":
            want = toxicity.report(now, labels).where("predicted = 0")
        elif rule == "jaccard":
            want = jaccard.report(now).where("doc_id = component_id")
        elif rule == "benchmark":
            want = decontaminate.report(now, bench).where("not contaminated")
        else:
            want = now
        assert sorted(r[0] for r in out.select("doc_id").collect()) == sorted(r[0] for r in want.select("doc_id").collect()), name
        if rule == "secrets":
            assert secrets.report(out).where("n_assign + n_access + n_hex > 0").count() == 0
        if rule == "bpe":
            spans = {r["doc_id"]: r for r in bpe.report(now, PATH, corpus_pipeline.public_tokenizers.PATTERN).collect()}
            for r in out.collect():
                assert r["ids_sha256"] == spans[r["doc_id"]]["ids_sha256"] and len(r["ids"]) == r["n_tokens"]
        else:
            assert out.columns == docs.columns
        now = out
    run = corpus_pipeline.run(spark, SAMPLE)
    assert sorted(tuple(r) for r in run.select("doc_id", "ids_sha256").collect()) == sorted(tuple(r) for r in now.select("doc_id", "ids_sha256").collect())


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert set(queries.ORACLE) <= set(queries.queries())


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    from compare import differences, duck

    assert differences(spark, duck(SAMPLE), SAMPLE, name) is None


def test_nothing_else_imports_the_subpackage():
    for path in ROOT.rglob("*.py"):
        inside = "llm" in path.relative_to(ROOT).parts or path.name in ("corpus_pipeline.py", "__spark_entry__.py")
        if not inside:
            for node in ast.walk(ast.parse(path.read_text())):
                names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
                assert not any("llm" in n.split(".") or n == "corpus_pipeline" for n in names), path


def test_staged_steps_take_small_batches_and_leave_the_settings(spark):
    from slotscribe.llm import common

    def count(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    rows = spark.range(0, 4_500, 1, 1)
    for own, most in ((None, common.SLICE_ROWS), ("300", 300)):
        with common.settings(spark, {common.ARROW_ROWS: own} if own else {}):
            before = {k: spark.conf.get(k, None) for k in (common.ARROW_ROWS, common.SHUFFLE_CLEANUP)}
            sizes = [r["n"] for r in common.stage(rows.mapInArrow(count, "n bigint"), "sizes").collect()]
            assert sum(sizes) == 4_500 and max(sizes) <= most
            assert {k: spark.conf.get(k, None) for k in before} == before
