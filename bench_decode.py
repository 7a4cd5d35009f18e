"""Rows per second of the two decode engines by number of 64-bit fields: python bench_decode.py [folder]"""

from __future__ import annotations

import sys
import time

from pyspark.sql import functions as F

from slotscribe.functions.idl_types import parse_type
from slotscribe.operators.decode import decode_payload
from slotscribe.plans import sample_chain as sample
from slotscribe.session import build_session, scratch_path


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session("decode-rates", master="local[*]", **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    words = [sample.little_endian_hex(F.col("l_partkey") * (i + 1), 8) for i in range(16)]
    rows = sample.table(spark, sf_dir, "lineitem").select(sample.payload("instruction", F.lit("line"), *words).alias("data"))
    path = scratch_path(spark, "payloads")
    rows.repartition(32).write.parquet(path)
    payloads = spark.read.parquet(path)
    count = payloads.count()
    for kind in ("u64", "i64", "u8"):
        for fields in (1, 2, 4, 8, 16):
            layout = [(f"f{i}", parse_type(kind)) for i in range(fields)]
            rates = []
            for engine in ("native", "arrow"):
                decoded = decode_payload(payloads, layout, engine=engine).drop("decode_issues")
                best = None
                for _ in range(3):
                    start = time.perf_counter()
                    decoded.write.format("noop").mode("overwrite").save()
                    best = min(best or 1e9, time.perf_counter() - start)
                rates.append(f"{engine} {count / best:,.0f} rows/s")
            print(kind, fields, "  ".join(rates), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
