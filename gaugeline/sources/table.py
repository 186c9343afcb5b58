"""The persisted telemetry table (the query side)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from gaugeline.functions.labels import labels_from_json, typed_labels
from gaugeline.schema import TELEMETRY_COLUMNS


def read_table(spark: SparkSession, path: str, typed: bool = False) -> DataFrame:
    """Scan with the label column decoded to a map (bad JSON -> empty map), or with ``typed`` to a VARIANT whose values
    keep their JSON types (bad JSON -> empty object).  A table that holds VARIANT labels is read as it is.

    Partition discovery exposes ``date`` and ``partition_id``; filters on them prune
    directories, filters on ``uuid``/``timestamp`` reach the Parquet reader.
    """
    df = spark.read.parquet(path)
    if isinstance(df.schema["labels"].dataType, T.StringType):
        df = df.withColumn("labels", (typed_labels if typed else labels_from_json)(F.col("labels")))
    elif typed and isinstance(df.schema["labels"].dataType, T.MapType):
        df = df.withColumn("labels", typed_labels(F.to_json("labels")))
    extra = [c for c in df.columns if c not in TELEMETRY_COLUMNS]
    return df.select(*TELEMETRY_COLUMNS, *extra)
