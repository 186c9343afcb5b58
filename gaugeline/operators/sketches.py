"""Skew monitoring by mergeable sketches, kept per partition and day.

A batch adds one row per (partition, day): its record count, a HyperLogLog sketch of its devices and a frequent-items sketch of
its records by device.  Sketches merge, so any range of days is answered from a few rows a day, without the records.
Counts are exact.  Device counts have a relative standard error of ``1.04 / sqrt(2^lg_k)``; a device's records are off by
at most ``3.5 / tracked`` of the partition's records in the range.  ``partitioning.partition_balance`` stays the exact form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gaugeline.functions.timeparse import utc_wall_clock
from gaugeline.operators.partitioning import with_partition
from gaugeline.schema import DATE_COLUMN, DEFAULT_PARTITIONS

#: log2 of the buckets of a device sketch (1.6 % standard error in 4 KB).
LG_K = 12
#: Devices that a frequent-items sketch tracks.
TRACKED = 4096


def device_error(lg_k: int = LG_K) -> float:
    """Relative standard error of a device count."""
    return 1.04 / 2 ** (lg_k / 2)


def hot_error(tracked: int = TRACKED) -> float:
    """Largest error of a device's records, as a share of all records looked at."""
    return 3.5 / tracked


def day_sketches(records: DataFrame, n_partitions: int = DEFAULT_PARTITIONS, lg_k: int = LG_K, tracked: int = TRACKED) -> DataFrame:
    """``partition_id, date, records, devices, top``: one row per partition and UTC day.

    Sketches are built in each task and merged after the shuffle, so a partition or device with a third of all records is
    one sketch per task.  Records without a device count as records only; records without a time have no day (NULL).
    """
    p = records if "partition_id" in records.columns else with_partition(records, n_partitions)
    day = utc_wall_clock(F.col("timestamp"), p.schema["timestamp"].dataType).cast("date")
    return p.groupBy("partition_id", day.alias(DATE_COLUMN)).agg(
        F.count(F.lit(1)).alias("records"), F.hll_sketch_agg("uuid", lg_k).alias("devices"),
        F.expr(f"approx_top_k_accumulate(uuid, {tracked})").alias("top"))


def add_sketches(records: DataFrame, path: str, batch: int, stream: str = "batch", n_partitions: int = DEFAULT_PARTITIONS,
                 lg_k: int = LG_K, tracked: int = TRACKED) -> None:
    """Add the sketches of one batch; the same batch again replaces what it added."""
    rows = day_sketches(records, n_partitions, lg_k, tracked).withColumns({"stream": F.lit(stream), "batch": F.lit(batch).cast("long")})
    (rows.repartition("partition_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("partition_id", "stream", "batch").parquet(path))


def read_sketches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _days(first, last) -> Column:
    cond = F.lit(True)
    if first is not None:
        cond = cond & (F.col(DATE_COLUMN) >= F.lit(first).cast("date"))
    if last is not None:
        cond = cond & (F.col(DATE_COLUMN) <= F.lit(last).cast("date"))
    return cond


def partition_skew(sketches: DataFrame, first=None, last=None, top: int = 10) -> DataFrame:
    """``partition_id, records, devices, hot`` over the days ``first`` to ``last`` (both included, None: open).

    ``hot`` lists the ``top`` devices with most records as ``(uuid, records)``, both estimates as the module states.  Only
    devices that stand out of the sketch's own error are known to be among them: where records are spread evenly over more
    devices than the sketch tracks, ``hot`` is shorter or empty, and a device that it could list and doesn't has at most
    ``hot_error`` of the partition's records.  Partitions without records in the range have no row.
    """
    merged = sketches.where(_days(first, last)).groupBy("partition_id").agg(
        F.sum("records").cast("long").alias("records"), F.hll_sketch_estimate(F.hll_union_agg("devices")).cast("long").alias("devices"),
        F.expr("approx_top_k_combine(top)").alias("_top"))
    # one more than asked for, as records without a device are an item too
    hot = F.expr(f"slice(filter(transform(approx_top_k_estimate(_top, {top + 1}), x -> named_struct('uuid', x.item, 'records', x.count)), "
                 f"x -> x.uuid is not null), 1, {top})")
    return merged.select("partition_id", "records", "devices", hot.alias("hot"))


def exact_skew(records: DataFrame, first=None, last=None, n_partitions: int = DEFAULT_PARTITIONS) -> DataFrame:
    """``partition_id, records, devices, hot_records`` of the same days by the records: devices are rows before they are counted."""
    p = records if "partition_id" in records.columns else with_partition(records, n_partitions)
    day = utc_wall_clock(F.col("timestamp"), p.schema["timestamp"].dataType).cast("date")
    per = p.withColumn(DATE_COLUMN, day).where(_days(first, last)).groupBy("partition_id", "uuid").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("partition_id").agg(F.sum("n").cast("long").alias("records"), F.count("uuid").alias("devices"),
                                           F.max(F.when(F.col("uuid").isNotNull(), F.col("n"))).alias("hot_records"))
