"""Driver tables seen as telemetry.

``events`` (event_id, ts, user_id, event_type, value, props) maps onto the
record: each user is a device ``GPU-<user_id>``, the event type is the metric,
``props`` JSON becomes the label map, and ``event_id`` is the table's
surrogate key ``id`` (a unique tie-break for ordering).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugeline.functions.labels import labels_from_json


def read_driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def device_uuid(user_id_col="user_id"):
    return F.concat(F.lit("GPU-"), F.col(user_id_col).cast("string"))


def events_as_telemetry(spark: SparkSession, sf_dir: str, with_labels: bool = True) -> DataFrame:
    ev = read_driver_table(spark, sf_dir, "events")
    cols = [
        F.col("event_id").alias("id"),
        F.col("ts").alias("timestamp"),
        F.col("event_type").alias("metric_name"),
        F.col("user_id").cast("string").alias("gpu_id"),
        F.lit("").alias("device"),
        device_uuid().alias("uuid"),
        F.lit("").alias("model_name"),
        F.lit("").alias("hostname"),
        F.lit("").alias("container"),
        F.lit("").alias("pod"),
        F.lit("").alias("namespace"),
        F.col("value"),
    ]
    if with_labels:
        cols.append(labels_from_json(F.col("props")).alias("labels"))
    return ev.select(*cols)
