"""Table writes: layout, NOT NULL, insert-if-absent (also with a hot key)."""

import os

from pyspark.sql import functions as F

from gaugeline.operators.table import (insert_if_absent, not_null_violations, persist, table_layout)
from gaugeline.sources.adapters import events_as_telemetry
from gaugeline.sources.table import read_table
from tests.conftest import SF001


def test_persist_layout_and_roundtrip(spark, tmp_dir):
    t = events_as_telemetry(spark, SF001)
    persist(t, tmp_dir, 3, mode="overwrite")
    days = [d for d in os.listdir(tmp_dir) if d.startswith("date=")]
    assert len(days) == t.select(F.col("timestamp").cast("date")).distinct().count()
    assert {x for d in days for x in os.listdir(f"{tmp_dir}/{d}")} <= {f"partition_id={k}" for k in range(3)}
    back = read_table(spark, tmp_dir)
    assert back.count() == t.count()
    assert back.where(F.col("labels")["k"].isNull()).count() == 0
    assert back.where(F.col("date") != F.col("timestamp").cast("date")).count() == 0
    # each device lives in exactly one hash partition
    assert back.groupBy("uuid").agg(F.countDistinct("partition_id").alias("n")).where("n > 1").count() == 0


def test_layout_is_range_clustered(spark):
    t = events_as_telemetry(spark, SF001)
    lay = table_layout(t, 3, num_files=4)
    key = F.struct("date", "partition_id", "uuid", "timestamp", "id")
    spans = lay.withColumn("task", F.spark_partition_id()).groupBy("task").agg(
        F.min(key).alias("lo"), F.max(key).alias("hi")).orderBy("task").collect()
    for a, b in zip(spans, spans[1:]):
        assert a.hi < b.lo                                    # disjoint, ordered key ranges


def test_a_hot_device_spans_several_files(spark, tmp_dir):
    """All rows of one device with one timestamp, as a micro-batch stamped with the processing time has them."""
    t = events_as_telemetry(spark, SF001).withColumns({"uuid": F.lit("hot"), "timestamp": F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")})
    persist(t, tmp_dir, 3, num_files=4)
    per_file = read_table(spark, tmp_dir).groupBy(F.input_file_name()).count().collect()
    assert len(per_file) == 4 and max(r["count"] for r in per_file) < t.count() / 2


def test_null_violations_fail_the_whole_write(spark, tmp_dir):
    import pytest
    t = events_as_telemetry(spark, SF001)
    broken = t.withColumn("value", F.when(F.col("id") == 7, None).otherwise(F.col("value")))
    persist(t, f"{tmp_dir}/t", 3)
    with pytest.raises(Exception, match="NULL in NOT NULL column value"):
        persist(broken, f"{tmp_dir}/t", 3)
    assert read_table(spark, f"{tmp_dir}/t").count() == t.count()      # nothing of the broken write
    persist(broken, f"{tmp_dir}/t", 3, rejects_path=f"{tmp_dir}/bad")
    assert read_table(spark, f"{tmp_dir}/t").count() == 2 * t.count() - 1
    assert [(r.id, r.violation) for r in spark.read.parquet(f"{tmp_dir}/bad").collect()] == [(7, "null_value")]


def test_not_null_violations(spark):
    df = spark.createDataFrame(
        [(None, "m", "u", 1.0), ("2024-01-01 00:00:00", None, "u", 1.0), ("2024-01-01 00:00:00", "m", "u", None),
         ("2024-01-01 00:00:00", "m", "u", 2.0)], "ts string, metric_name string, uuid string, value double")
    df = df.select(F.col("ts").cast("timestamp").alias("timestamp"), "metric_name", "uuid", "value")
    got = sorted(r.violation for r in not_null_violations(df).collect())
    assert got == ["null_metric_name", "null_timestamp", "null_value"]


def test_insert_if_absent_hot_duplicates(spark):
    new = spark.range(9000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"),
                                   F.col("id").alias("v"))
    existing = spark.range(0, 4000, 2).select(F.col("id").alias("k"), F.lit(0).alias("v"))
    out = insert_if_absent(new, existing, ["k"])
    keys = [r.k for r in out.collect()]
    assert len(keys) == len(set(keys))
    expected = {-1} | {i for i in range(9000) if i % 3 != 0 and not (i < 4000 and i % 2 == 0)}
    assert set(keys) == expected
