"""Device metadata over time: which model and host a device had when, and the records' join with it.

The side table holds validity intervals ``uuid, model_name, hostname, valid_from, valid_to``.  A device's history is cut into
days: inside a (device, day) only the rows at which the metadata change are kept, by a window over that day's rows of
that device; what is left, a few rows per day, is compared across days.  So a device with a third of all records is spread
over as many tasks as it has days, in building as in joining.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from gaugeline.functions.timeparse import utc_wall_clock

VALUES = ["model_name", "hostname"]


def _changes(rows: DataFrame, group: list[str]) -> DataFrame:
    """The rows whose values differ from those of the row before them in the group (the first row included)."""
    w = W.partitionBy(*group).orderBy("valid_from")
    value = F.struct(*VALUES)
    return rows.withColumn("_before", F.lag(value).over(w)).where(~F.col("_before").eqNullSafe(value)).drop("_before")


def observations(records: DataFrame) -> DataFrame:
    """One row per (device, time): its metadata; of several rows at one time the greatest values count."""
    return (records.groupBy("uuid", F.col("timestamp").alias("valid_from")).agg(F.max(F.struct(*VALUES)).alias("v"))
            .select("uuid", "valid_from", *[F.col(f"v.{c}").alias(c) for c in VALUES]))


def changes(observed: DataFrame) -> DataFrame:
    """``uuid, valid_from, model_name, hostname``: the moments at which a device's metadata change."""
    day = utc_wall_clock(F.col("valid_from"), observed.schema["valid_from"].dataType).cast("date")
    daily = _changes(observed.withColumn("_day", day), ["uuid", "_day"])
    return _changes(daily.drop("_day"), ["uuid"])


def merge_changes(known: DataFrame, records: DataFrame) -> DataFrame:
    """The changes after a further batch of records, early or late: only changes are kept of what is known."""
    new = changes(observations(records))
    return changes(observations(known.unionByName(new).withColumnRenamed("valid_from", "timestamp")))


def validity(changed: DataFrame) -> DataFrame:
    """Intervals ``[valid_from, valid_to)``; the newest one has no end (NULL)."""
    return changed.withColumn("valid_to", F.lead("valid_from").over(W.partitionBy("uuid").orderBy("valid_from")))


def with_metadata(records: DataFrame, intervals: DataFrame) -> DataFrame:
    """Every record with the model and host that were valid at its time (``valid_model``, ``valid_host``; NULL before the
    device's first).

    An equi-join on (device, day): an interval has a row for each day that it touches, the newest one up to the last day of
    the records (one date reaches the driver).
    """
    kind = records.schema["timestamp"].dataType
    day = lambda c: utc_wall_clock(F.col(c), kind).cast("date")
    newest = records.agg(F.max(day("timestamp"))).first()[0]
    begun = intervals.where(day("valid_from") <= F.lit(newest).cast("date"))
    until = F.least(F.coalesce(day("valid_to"), F.lit(newest).cast("date")), F.lit(newest).cast("date"))
    spans = begun.select(F.col("uuid").alias("_u"), F.explode(F.sequence(day("valid_from"), until)).alias("_day"), "valid_from", "valid_to",
                         F.col("model_name").alias("valid_model"), F.col("hostname").alias("valid_host"))
    held = (F.col("timestamp") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("timestamp") < F.col("valid_to")))
    return (records.withColumn("_d", day("timestamp")).join(spans, (F.col("uuid") == F.col("_u")) & (F.col("_d") == F.col("_day")) & held, "left")
            .drop("_u", "_day", "_d", "valid_from", "valid_to"))
