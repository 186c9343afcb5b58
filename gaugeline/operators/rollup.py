"""Record counts per device and day, kept beside the table: counts and deep pages without reading what lies between.

A batch adds its counts to the rollup in a directory of its own (stream, batch); a replayed batch writes the same directory
again.  Counts of a range are the rollup's whole days plus the records of the two days at its ends.  A page at any depth
is found by the running sum over the device's days: all days before the page are skipped, and only the rest of the
offset is counted in records.
"""

from __future__ import annotations

from datetime import timezone

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import Window as W

from gaugeline.functions.timeparse import utc_wall_clock
from gaugeline.operators.partitioning import with_partition
from gaugeline.operators.query import TimeRange, _total_pages, device_filter, normalize_page, normalize_page_size, ordered_page, select_records
from gaugeline.schema import DATE_COLUMN, DEFAULT_PAGE_SIZE, DEFAULT_PARTITIONS

ROLLUP_SCHEMA = "uuid string, date date, n long, partition_id int, stream string, batch long"


def day_counts(records: DataFrame, n_partitions: int = DEFAULT_PARTITIONS) -> DataFrame:
    """``uuid, date, n, partition_id``: records per device and UTC day (combined before the shuffle)."""
    p = records if "partition_id" in records.columns else with_partition(records, n_partitions)
    day = utc_wall_clock(F.col("timestamp"), p.schema["timestamp"].dataType).cast("date")
    return p.groupBy("partition_id", "uuid", day.alias(DATE_COLUMN)).agg(F.count(F.lit(1)).alias("n")).select("uuid", DATE_COLUMN, "n", "partition_id")


def add_to_rollup(records: DataFrame, path: str, batch: int, stream: str = "batch", n_partitions: int = DEFAULT_PARTITIONS) -> None:
    """Add the counts of one batch; the same batch again replaces what it added."""
    counts = day_counts(records, n_partitions).withColumns({"stream": F.lit(stream), "batch": F.lit(batch).cast("long")})
    (counts.repartition("partition_id").sortWithinPartitions("partition_id", "uuid", DATE_COLUMN)
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("partition_id", "stream", "batch").parquet(path))


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ROLLUP_SCHEMA).parquet(path)


def _device_days(rollup: DataFrame, uuid: str, n_partitions: int | None) -> DataFrame:
    """``date, n`` of one device: a row per day."""
    return rollup.where(device_filter(rollup, uuid, n_partitions)).groupBy(DATE_COLUMN).agg(F.sum("n").alias("n"))


def _edges(rng: TimeRange) -> list:
    """The UTC days that the range covers in part only (or may)."""
    days = [t.astimezone(timezone.utc).date() for t in (rng.start, rng.end) if t is not None]
    return sorted(set(days))


def _inner(days: DataFrame, rng: TimeRange) -> DataFrame:
    """The days that the range covers whole."""
    if rng.start is not None:
        days = days.where(F.col(DATE_COLUMN) > F.lit(rng.start.astimezone(timezone.utc).date()))
    if rng.end is not None:
        days = days.where(F.col(DATE_COLUMN) < F.lit(rng.end.astimezone(timezone.utc).date()))
    return days


def _range_days(table: DataFrame, rollup: DataFrame, uuid: str, rng: TimeRange, n_partitions: int | None) -> DataFrame:
    """``date, n`` of the device's records in the range: whole days by the rollup, days at its ends by their records."""
    days = _inner(_device_days(rollup, uuid, n_partitions), rng)
    edges = _edges(rng)
    if not edges:
        return days
    sel = select_records(table, uuid, rng, None, n_partitions).where(F.col(DATE_COLUMN).isin(edges))
    return days.unionByName(sel.groupBy(DATE_COLUMN).agg(F.count(F.lit(1)).alias("n")))


def count_by_rollup(table: DataFrame, rollup: DataFrame, uuid: str, start=None, end=None, n_partitions: int | None = None) -> DataFrame:
    """``total`` records of the device in the range, as ``count_records``; reads the records of two days at most."""
    days = _range_days(table, rollup, uuid, TimeRange.parse(start, end), n_partitions)
    return days.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total"))


def page_by_rollup(table: DataFrame, rollup: DataFrame, uuid: str, page=1, page_size=DEFAULT_PAGE_SIZE, start=None, end=None,
                   n_partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(rows, meta)`` of a page of any number, as ``records_page`` and ``page_meta``.

    The day in which the page starts comes from a running sum over the device's days (one row per day; one row reaches the
    driver).  The scan then reads from that day to the one in which the page ends.
    """
    p, s = normalize_page(page), normalize_page_size(page_size)
    skip, rng = (p - 1) * s, TimeRange.parse(start, end)
    days = _range_days(table, rollup, uuid, rng, n_partitions)
    upto = F.sum("n").over(W.orderBy(DATE_COLUMN))  # one device's days
    placed = days.select(DATE_COLUMN, "n", (upto - F.col("n")).alias("before"), upto.alias("upto"))
    least = F.lit(min(skip, 2**63 - 1))
    at = placed.agg(F.coalesce(F.max("upto"), F.lit(0)).alias("total"),
                    F.min(F.when(F.col("upto") > least, F.struct(DATE_COLUMN, "before"))).alias("first"),
                    F.max(F.when(F.col("before") < F.lit(min(skip + s, 2**63 - 1)), F.col(DATE_COLUMN))).alias("last")).first()
    sel = select_records(table, uuid, rng, None, n_partitions)
    if at.first is None:
        rows = sel.limit(0)
    else:
        sel = sel.where((F.col(DATE_COLUMN) >= F.lit(at.first[DATE_COLUMN])) & (F.col(DATE_COLUMN) <= F.lit(at["last"])))
        rows = ordered_page(sel, skip - at.first.before, s)
    spark = table.sparkSession
    meta = spark.createDataFrame([(p, s, at.total)], "page long, page_size int, total long")
    return rows, meta.select("page", "page_size", "total", _total_pages(F.col("total"), s).alias("total_pages"), (F.col("total") > least).alias("found"))


def latest_per_key(records: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Compaction: the last record of every (uuid, metric_name, timestamp), by log offset or id.

    A partial arg-max aggregate: each task keeps one row per key before the shuffle, so a hot device needs no window and
    a key with many versions is one row a task.
    """
    keys = keys or ["uuid", "metric_name", "timestamp"]
    order = ["offset"] if "offset" in records.columns else ["id"]
    rest = [c for c in records.columns if c not in keys]
    # a key's records share their device, so they share its partition and its offsets are unique
    last = F.max_by(F.struct(*rest), F.struct(*order))
    return records.groupBy(*keys).agg(last.alias("_last")).select(*[F.col(c) if c in keys else F.col(f"_last.{c}").alias(c) for c in records.columns])

