"""Every named query against its SQL on the smallest sample."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import differences, duck
from slotscribe.plans import catalog, oracle
from slotscribe.plans.sample_chain import little_endian_hex

SAMPLE = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SAMPLE).exists(), reason="sample tables not present")


@pytest.fixture(scope="module")
def con():
    return duck(SAMPLE)


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(oracle.ORACLE)
    assert set(catalog.queries()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query_equals_sql(spark, con, name):
    assert differences(spark, con, SAMPLE, name) is None


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["ix_name", "period", "calls"]


@pytest.mark.parametrize("pipeline", ["kept", "deleted"])
def test_entry_loads_without_the_optional_subpackage(tmp_path, pipeline):
    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", *(["corpus_pipeline.py"] if pipeline == "deleted" else [])))
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), set(e.oracle_sql()) == set(q), any(n.startswith('op') or n == 'pipeline' for n in q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert done.stdout.split() == [str(len(catalog.queries())), "True", "False"]


def test_little_endian_hex_takes_no_text_per_byte(spark):
    import struct

    values = [0, 1, -1, 255, 2**63 - 1, -(2**63), 0x0102030405060708, -7, None]
    rows = spark.createDataFrame([(v,) for v in values], "v bigint")
    for width in (1, 4, 7, 8):
        found = rows.select("v", little_endian_hex(F.col("v"), width).alias("h"))
        assert [r["h"] for r in found.collect()] == [None if v is None else struct.pack("<q", v)[:width].hex().upper() for v in values]
        assert found._jdf.queryExecution().optimizedPlan().toString().count("substring") == 1
