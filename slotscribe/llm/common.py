"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the sample tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    A local session without that setting, as in tests, gets a temporary folder;
    a cluster without it is refused, because its executors share no local disk.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corpus-"))
        configured = spark.sparkContext.getCheckpointDir()
    return configured.rstrip("/")


# Spark's setting that deletes the shuffle files of a query once it has ended.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


# Spark's setting for the rows of a batch that goes to Python.
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session with other settings; its own are put back."""
    usual = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in usual.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def small_batches(spark: SparkSession) -> dict[str, str]:
    """Batches of one slice, unless the session asks for smaller ones.

    A batch is held whole outside the heap of the executor, and again by its Python worker.
    """
    own = int(spark.conf.get(ARROW_ROWS))
    return {ARROW_ROWS: str(own if 0 < own < SLICE_ROWS else SLICE_ROWS)}


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: computed once, and safe when executors are lost.

    The shuffle files behind it go as soon as it is written, not when the driver
    happens to collect its garbage; the session's own settings are put back.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpus/{label}-{uuid.uuid4().hex}"
    with settings(spark, {SHUFFLE_CLEANUP: "true", **small_batches(spark)}):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Rows a task turns into Python objects at a time.
SLICE_ROWS = 1_000


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut into pieces whose Python objects are small."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(start, SLICE_ROWS)


def map_batches(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch | list]]], schema: T.StructType | str
) -> DataFrame:
    """Run ``make()`` once per task and its result on every slice of an Arrow batch.

    The function yields either record batches or lists of columns in schema order.
    """
    target = to_arrow_schema(T._parse_datatype_string(schema) if isinstance(schema, str) else schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in slices(batches):
            for out in work(batch):
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    columns = [c if isinstance(c, pa.Array) and c.type == f.type else pa.array(c, f.type) for c, f in zip(out, target)]
                    yield pa.RecordBatch.from_arrays(columns, schema=target)

    return df.mapInArrow(run, schema)


def with_columns(df: DataFrame, fields: list[T.StructField], make: Callable[[], Callable[[pa.RecordBatch], list]]) -> DataFrame:
    """Append columns computed from whole Arrow batches; the others pass through."""
    names = {f.name.lower() for f in df.schema.fields}
    clash = [f.name for f in fields if f.name.lower() in names]
    if clash:
        raise ValueError(f"the input already has {clash}; choose other output names")
    schema = T.StructType([*df.schema.fields, *fields])

    def build() -> Callable[[pa.RecordBatch], Iterator[list]]:
        work = make()

        def one(batch: pa.RecordBatch) -> Iterator[list]:
            yield [*batch.columns, *work(batch)]

        return one

    return map_batches(df, build, schema)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until the frame has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a batch, NULL as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def sha256_hex(column) -> F.Column:
    """Lower-case hex of a text or binary column's SHA-256."""
    return F.sha2(column.cast("binary"), 256)
