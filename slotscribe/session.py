"""Session helpers: the settings the jobs rely on, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# Runtime settings every job here assumes. All are session-level, so they can
# also be applied to a session somebody else created.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Pages up to this many rows use a bounded top-k heap, deeper offsets a
    # spilling sort.
    "spark.sql.execution.topKSortFallbackThreshold": "100000",
    # Bucketed tables (the keys of an index) are read by bucket also where no
    # join asks for it, so that a lookup opens one bucket.
    "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false",
}


def build_session(app_name: str = "slotscribe", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or reuse) a session with the settings above; ``conf`` wins over them."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_runtime_conf(spark: SparkSession) -> SparkSession:
    """Apply ``RUNTIME_CONF`` to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: the cluster's ``spark.checkpoint.dir``.

    Only where a local session names none (tests, a laptop) is a temporary
    folder created and registered for it; executors of a cluster share no such
    folder, so there the setting is required.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="slotscribe-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, never reused path below the shared folder."""
    return f"{shared_dir(spark)}/slotscribe/{label}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder this package wrote, on whatever file system it lives."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def list_folders(spark: SparkSession, path: str) -> list[str]:
    """The folders directly below a path, none if it does not exist."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return [str(s.getPath()) for s in system.listStatus(target) if s.isDirectory()] if system.exists(target) else []


class Staging:
    """Intermediate results of one job, written below ``base`` or the shared folder and removed when the job ends."""

    def __init__(self, spark: SparkSession, label: str, base: str | None = None):
        self.spark = spark
        self.root = scratch_path(spark, label) if base is None else f"{base}/_staging/{label}-{uuid.uuid4().hex}"

    def __enter__(self) -> "Staging":
        return self

    def __exit__(self, *error) -> None:
        remove_folder(self.spark, self.root)

    def put(self, df: DataFrame, name: str, partition: str | None = None) -> DataFrame:
        """Write and read back: computed once, lineage cut, safe against lost executors.

        With ``partition`` every value gets its own folder. Rows are not moved
        for it: a task writes a file per value it holds, and the job that reads
        a value splits and packs its files.
        """
        path, schema = f"{self.root}/{name}", df.schema
        if partition is None:
            df.write.option("compression", "zstd").parquet(path)
        else:
            df.write.partitionBy(partition).option("compression", "zstd").parquet(path)
            schema = StructType([*[f for f in schema.fields if f.name != partition], schema[partition]])
        return self.spark.read.schema(schema).parquet(path)
