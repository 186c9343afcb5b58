"""Streams with event-time state: the recent-records window, insert-if-absent, the parse-error alert.

State is Spark's own, kept in the query's checkpoint and bounded by a watermark; a restarted query goes on where it was.  What
a micro-batch hands over goes into directories named by stream and batch, overwritten as a whole, so a batch that is
replayed after a failure is written once.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from gaugeline.operators.commits import file_system, remove
from gaugeline.operators.query import recent_records
from gaugeline.schema import LOG_KEY
from gaugeline.streaming.ingest import _trigger, query_id

#: Directories into which the recent window is divided by event time.
SLOTS = 8


def first_within(stream: DataFrame, keys: list[str], duration: str, time_col: str = "timestamp") -> DataFrame:
    """The first row of each key; rows older than ``duration`` before the newest event time seen are late and dropped.

    A key is remembered until the watermark passes its time plus ``duration``, so the state holds the keys of the last
    two durations at most.  Event times must be TIMESTAMP (Spark's watermark has no other type).
    """
    return stream.withWatermark(time_col, duration).dropDuplicatesWithinWatermark(keys)


def _write_batch(rows: DataFrame, path: str, stream: str, batch_id: int, by: list[str]) -> None:
    (rows.withColumns({"stream": F.lit(stream), "batch": F.lit(batch_id).cast("long")}).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(*by, "stream", "batch").parquet(path))


# ------------------------------------------------------------ insert if absent
def insert_stream(records: DataFrame, keys: list[str], table_path: str, checkpoint: str, horizon: str, trigger: str = "availableNow",
                  time_col: str = "timestamp") -> StreamingQuery:
    """K4 as a stream: each key is written once, however often and in whichever micro-batch it is delivered.

    Redelivery is recognised within ``horizon`` of event time, across restarts too; rows that are later than that are
    dropped (read the number in the query progress: numRowsDroppedByWatermark).
    """
    def one(batch: DataFrame, batch_id: int) -> None:
        _write_batch(batch, table_path, query_id(batch.sparkSession), batch_id, [])

    w = first_within(records, keys, horizon, time_col).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return _trigger(w, trigger).start()


# ------------------------------------------------------------ recent records
def _seconds(spark: SparkSession, duration: str) -> int:
    return spark.sql(f"SELECT unix_seconds(timestamp_seconds(0) + INTERVAL {duration}) AS s").first().s


def recent_stream(records: DataFrame, path: str, checkpoint: str, duration: str, keys: list[str] | None = None,
                  trigger: str = "1 second") -> StreamingQuery:
    """ST9 as a stream: the records of the last ``duration`` of event time, kept under ``path``.

    A record enters when it arrives, unless it is older than ``duration`` before the newest event time of its own or
    earlier micro-batches: such a late record is outside the window already.  A record that is delivered twice
    enters once (``keys``, by default its log key).  Records are kept in SLOTS directories by event time, and
    directories that the window has left are removed, so state and folder hold about two durations of records
    however long the stream runs.
    """
    seconds = _seconds(records.sparkSession, duration)
    width = max(seconds // SLOTS, 1)

    def one(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = batch.agg(F.unix_seconds(F.max("timestamp")).alias("t")).first().t
        if newest is None:
            return
        age = F.unix_seconds("timestamp")
        rows = batch.where(age >= newest - seconds).withColumn("slot", F.floor(age / width) * width)
        _write_batch(rows, path, query_id(spark), batch_id, ["slot"])
        slots = _slots(spark, path)
        for s in slots:
            if s + width <= slots[-1] - seconds:
                remove(spark, f"{path}/slot={s}")

    w = first_within(records, keys or LOG_KEY, duration).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return _trigger(w, trigger).start()


def _slots(spark: SparkSession, path: str) -> list[int]:
    fs, pattern = file_system(spark, f"{path}/slot=*")
    return sorted(int(s.getPath().getName().split("=")[1]) for s in fs.globStatus(pattern) or [])


def read_recent(spark: SparkSession, path: str, duration: str, as_of: str | datetime | None = None) -> DataFrame:
    """The recent window as a batch sees it: records within ``duration`` before ``as_of`` (default: the newest record)."""
    rows = spark.read.parquet(path)
    if as_of is None:
        newest = rows.where(F.col("slot") == F.lit(max(_slots(spark, path)))).agg(F.max("timestamp").alias("t"))
        rows = rows.join(F.broadcast(newest), (F.col("timestamp") >= F.col("t") - F.expr(f"INTERVAL {duration}")) & (F.col("timestamp") <= F.col("t"))).drop("t")
    else:
        rows = recent_records(rows, as_of, duration)
    return rows.drop("slot", "stream", "batch")


# ------------------------------------------------------------ alerts
def reject_alerts(outcomes: DataFrame, window: str, threshold: float, min_rows: int = 1, lateness: str = "0 seconds",
                  time_col: str = "arrived") -> DataFrame:
    """Tumbling windows in which at least ``threshold`` of the rows (of ``min_rows`` or more) were rejected.

    ``outcomes`` holds a row per record with its arrival time and ``reject_reason`` (NULL: accepted), as a stream or a
    batch.  As a stream a window is reported once, when the newest arrival is ``lateness`` past its end.
    """
    if outcomes.isStreaming:
        outcomes = outcomes.withWatermark(time_col, lateness)
    counts = (outcomes.groupBy(F.window(time_col, window).alias("w"))
              .agg(F.count(F.lit(1)).alias("rows"), F.count("reject_reason").alias("rejected")))
    return (counts.where((F.col("rows") >= min_rows) & (F.col("rejected") >= threshold * F.col("rows")))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "rows", "rejected",
                    (F.col("rejected") / F.col("rows")).alias("reject_rate")))


def alert_stream(spark: SparkSession, outcomes_path: str, alerts_path: str, checkpoint: str, window: str, threshold: float,
                 min_rows: int = 1, lateness: str = "0 seconds", trigger: str = "1 second") -> StreamingQuery:
    """Watch what ``ingest_stream(outcomes_path=...)`` writes; alerts are appended to a Parquet folder, each once."""
    outcomes = spark.readStream.schema("arrived timestamp, reject_reason string").option("basePath", outcomes_path).parquet(f"{outcomes_path}/*/*")
    w = (reject_alerts(outcomes, window, threshold, min_rows, lateness).writeStream.format("parquet").outputMode("append")
         .option("path", alerts_path).option("checkpointLocation", checkpoint))
    return _trigger(w, trigger).start()
