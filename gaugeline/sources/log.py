"""The offset-numbered, hash-partitioned record log.

Layout: ``<path>/partition_id=<k>/part-*.parquet`` with columns
record + ``offset`` (dense, from 0, per partition).  Files are written sorted by
offset, so Parquet min/max statistics turn an offset range into a row-group skip
(the role of the original byte index), and the partition directory turns a
partition choice into directory pruning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugeline.schema import LOG_SCHEMA, OMIT_EMPTY


def read_log(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    if fmt == "parquet":
        return spark.read.schema(LOG_SCHEMA).parquet(path)
    if fmt == "json":  # NDJSON form: one record object per line, with its offset
        df = spark.read.schema(LOG_SCHEMA).json(path)
        return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c in OMIT_EMPTY and c != "labels"
                           else F.col(c) for c in LOG_SCHEMA.fieldNames()])
    raise ValueError(f"unknown log format {fmt!r}")
