"""Skew by sketches: merged over batches and days, within the stated error; the log's device filters skip row groups."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gaugeline.catalog import QUERIES
from gaugeline.operators import sketches
from gaugeline.operators.log import DEVICE_INDEX, append_log, device_log
from gaugeline.sources.log import read_log


def _records(spark, rows=60_000, devices=9_000):
    """One device with a third of all records, the others evenly; four days."""
    n = F.col("id")
    return spark.range(rows).select(
        F.when(n % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("d"), F.pmod(F.xxhash64("id"), F.lit(devices)).cast("string"))).alias("uuid"),
        F.timestamp_add("HOUR", (n % 96).cast("int"), F.lit(dt.datetime(2024, 3, 1)).cast("timestamp_ntz")).alias("timestamp"))


@pytest.mark.parametrize("first,last", [(None, None), ("2024-03-02", "2024-03-03"), ("2024-03-04", None), (None, "2024-03-01")])
def test_ranges_of_days_are_within_the_error(spark, tmp_dir, first, last):
    df = _records(spark)
    for batch in (0, 1, 2, 1):   # batch 1 is redelivered
        sketches.add_sketches(df.where(F.pmod(F.xxhash64("uuid", "timestamp"), F.lit(3)) == batch), tmp_dir, batch)
    got = {r.partition_id: r for r in sketches.partition_skew(sketches.read_sketches(spark, tmp_dir), first, last, 2).collect()}
    want = {r.partition_id: r for r in sketches.exact_skew(df, first, last).collect()}
    assert set(got) == set(want)
    for k, w in want.items():
        assert got[k].records == w.records
        assert abs(got[k].devices - w.devices) <= 4 * sketches.device_error() * w.devices
        assert abs(got[k].hot[0].records - w.hot_records) <= sketches.hot_error() * w.records
    assert max((h.records, h.uuid) for r in got.values() for h in r.hot)[1] == "hot"


def test_null_devices_and_empty_input(spark, tmp_dir):
    rows = [(None, dt.datetime(2024, 3, 1), 0), ("a", dt.datetime(2024, 3, 1), 0), ("a", None, 0)]
    df = spark.createDataFrame(rows, "uuid string, timestamp timestamp_ntz, partition_id int")
    sketches.add_sketches(df, tmp_dir, 0)
    stored = sketches.read_sketches(spark, tmp_dir)
    assert [(r.records, r.devices, [tuple(h) for h in r.hot]) for r in sketches.partition_skew(stored).collect()] == [(3, 1, [("a", 2)])]
    assert [(r.records, r.devices) for r in sketches.partition_skew(stored, "2024-03-01").collect()] == [(2, 1)]
    assert sketches.day_sketches(df.limit(0)).count() == 0 and sketches.partition_skew(stored, "2025-01-01").count() == 0


def _rows_read(df):
    """Rows that the scan handed on: those of row groups that were not skipped."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName().startswith("AdaptiveSparkPlan") else plan
    leaves = plan.collectLeaves()
    return sum(leaves.apply(k).metrics().get("numOutputRows").get().value() for k in range(leaves.size()))


def test_a_device_read_skips_row_groups(spark, tmp_dir):
    """Distinct devices in small row groups without a dictionary: only filters can tell where a device is."""
    n = 40_000
    df = spark.range(n).select(F.sha2(F.col("id").cast("string"), 256).alias("uuid"), F.lit("m").alias("metric_name"), F.col("id").cast("double").alias("value"),
                               *[F.lit("").alias(c) for c in ("gpu_id", "device", "model_name", "hostname", "container", "pod", "namespace")],
                               F.lit(dt.datetime(2024, 3, 1)).cast("timestamp_ntz").alias("timestamp"), F.lit(None).cast("map<string,string>").alias("labels"), "id")
    assert DEVICE_INDEX["parquet.bloom.filter.enabled#uuid"] == "true"
    conf = {"parquet.block.size": str(128 << 10), "parquet.enable.dictionary": "false", "parquet.page.size.row.check.max": "500"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        append_log(df, tmp_dir, 1, order_cols=["id"], num_ranges=1)
    finally:
        for k in conf:
            spark.conf.unset(k)
    log = read_log(spark, tmp_dir)
    one = log.where("value = 12345").first()
    read = device_log(log, one.uuid, 1)
    assert [r.offset for r in read.collect()] == [one.offset]
    filtered = _rows_read(device_log(log, one.uuid, 1))
    spark.conf.set("parquet.filter.bloom.enabled", "false")
    spark.conf.set("parquet.filter.columnindex.enabled", "false")
    try:
        plain = _rows_read(device_log(log, one.uuid, 1))
    finally:
        spark.conf.unset("parquet.filter.bloom.enabled")
        spark.conf.unset("parquet.filter.columnindex.enabled")
    assert filtered * 4 < plain <= n
    assert device_log(log, "nowhere", 1).count() == 0


def test_no_device_stands_out(spark, tmp_dir):
    """More devices than a sketch tracks, with equal records: no hot device, which says that none is above the error."""
    n = F.col("id")
    rows = spark.range(60_000, numPartitions=4)
    df = rows.select(F.concat(F.lit("d"), n % 30_000).alias("uuid"), F.lit(dt.datetime(2024, 3, 1)).cast("timestamp_ntz").alias("timestamp"),
                     F.lit(0).alias("partition_id"))
    sketches.add_sketches(df, f"{tmp_dir}/sketches", 0)
    got = sketches.partition_skew(sketches.read_sketches(spark, f"{tmp_dir}/sketches"), top=3).first()
    assert (got.records, got.hot) == (60_000, [])
    assert sketches.exact_skew(df).first().hot_records <= sketches.hot_error() * got.records
    # the query on as many devices in each partition
    day = F.lit(dt.datetime(2024, 1, 10)).cast("timestamp_ntz")
    spark.range(180_000, numPartitions=4).select(n.alias("event_id"), day.alias("ts"), (n % 90_000).alias("user_id"),
                                                     F.lit("error").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k":1}').alias("props")).write.parquet(f"{tmp_dir}/t/events.parquet")
    rows = QUERIES["skew_sketches"](spark, f"{tmp_dir}/t").collect()
    assert sum(r.records for r in rows) == 180_000 and all(r.records_equal and r.devices_within and r.hot_within for r in rows)
