"""Hash partition assignment and partition balance."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gaugeline.functions.partition import partition_id
from gaugeline.schema import DEFAULT_PARTITIONS


def with_partition(df: DataFrame, n: int = DEFAULT_PARTITIONS, uuid_col: str = "uuid") -> DataFrame:
    """P8: add ``partition_id`` (int in [0, n)), a pure per-row expression (no shuffle)."""
    return df.withColumn("partition_id", partition_id(uuid_col, n))


def partition_balance(df: DataFrame, n: int = DEFAULT_PARTITIONS) -> DataFrame:
    """A5: records and distinct devices per partition.

    Devices are first reduced to one row per (partition, uuid) by a partial
    aggregate, so the distinct count never holds all records of a hot device.
    """
    p = df if "partition_id" in df.columns else with_partition(df, n)
    per_dev = p.groupBy("partition_id", "uuid").agg(F.count(F.lit(1)).alias("_n"))
    return per_dev.groupBy("partition_id").agg(
        F.sum("_n").cast("long").alias("records"),
        F.count(F.lit(1)).cast("long").alias("devices"),
    )
