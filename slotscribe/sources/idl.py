"""Read interface descriptions as a table of (program_id, idl)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON files, one document each; the program is the document's own address,
    or the file name without its extension where the document names none."""
    files = spark.read.text(path, wholetext=True)
    address = F.coalesce(F.get_json_object("value", "$.address"), F.get_json_object("value", "$.metadata.address"))
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1)
    return files.select(F.coalesce(address, stem).alias("program_id"), F.col("value").alias("idl"))


def read_document_for(spark: SparkSession, path: str, program_id: str) -> DataFrame:
    """One file bound to a given program; the registry then checks the address it names."""
    return spark.read.text(path, wholetext=True).select(F.lit(program_id).alias("program_id"), F.col("value").alias("idl"))
