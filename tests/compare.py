"""Run every named query and its SQL side by side: python tests/compare.py [folder] [name ...]"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

import __spark_entry__ as entry
from slotscribe.session import build_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def canonical(value):
    if isinstance(value, float):
        return format(value, ".9g")
    return str(value)


def differences(spark, con, sf_dir, name):
    """None if equal, else what differs."""
    got = entry.queries()[name](spark, sf_dir)
    columns = sorted(got.columns)
    rows = sorted(tuple(canonical(r[c]) for c in columns) for r in got.collect())
    cursor = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    if sorted(names) != columns:
        return f"columns {columns} != {sorted(names)}"
    order = [names.index(c) for c in columns]
    want = sorted(tuple(canonical(r[i]) for i in order) for r in cursor.fetchall())
    if len(rows) != len(want):
        return f"rows {len(rows)} != {len(want)}"
    bad = [(a, b) for a, b in zip(rows, want) if a != b]
    return f"{len(bad)} rows differ, columns {columns}, first {bad[0]}" if bad else None


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("compare", master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    names = sys.argv[2:] or list(entry.queries())
    failed = 0
    for name in names:
        start = time.time()
        try:
            problem = differences(spark, con, sf_dir, name)
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.2f}s {problem or ''}", flush=True)
    print("failed:", failed, "missing oracle:", sorted(set(entry.queries()) - set(entry.oracle_sql())))


if __name__ == "__main__":
    main()
