"""S2 + ST7 + ST10 + K1: CSV files arriving in a folder -> parsed -> appended to the log.

Every micro-batch is parsed once and staged in the shared folder; good rows are
appended to the log in arrival order, with offsets continuing the partitions'
end offsets, bad rows go to a dead-letter folder keyed by stream and batch.  A
stream is known by the id that Spark keeps in its checkpoint: several streams
may fill one log, each with its own batch ids, and a renewed checkpoint is a
new stream.  A micro-batch replayed after a failure is recognised by (stream,
batch) and not appended twice.

Arrival order: file modification time, file, block, place in the block.

Line breaks inside quoted cells: the stream reads lines, split across tasks, each file once.  Every line is parsed as it is
read; inside the micro-batch the lines that are records by themselves keep that, and only records that go over several
lines are put together from the staged lines (``sources.csv_records``) and parsed again.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from gaugeline.operators.commits import remove
from gaugeline.operators.log import append_log
from gaugeline.operators.parse import parse_records, rejects
from gaugeline.schema import DEFAULT_PARTITIONS
from gaugeline.session import scratch_path
from gaugeline.sources.csv import ARRIVAL, DEFAULT_FILES_PER_TRIGGER, csv_lines, stream_csv
from gaugeline.sources.csv_records import BLANK, split_records, stream_lines

_PLACE = "_place"


def _trigger(writer, trigger):
    if trigger == "availableNow":
        return writer.trigger(availableNow=True)
    if trigger == "once":
        return writer.trigger(once=True)
    return writer.trigger(processingTime=trigger)


def query_id(spark: SparkSession) -> str:
    """Id of the streaming query that runs the current micro-batch (kept in its checkpoint)."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId") or ""


def _append(staged: DataFrame, batch_id: int, log_path: str, n_partitions: int, rejects_path: str | None, stream: str,
            on_metrics: Callable[[int, int, int], None] | None, outcomes_path: str | None) -> None:
    """Append the good rows of a staged micro-batch, set the others aside, and note each record's arrival and outcome."""
    arrival = [c for c in ARRIVAL if c in staged.columns] + [_PLACE]
    append_log(staged.where(F.col("reject_reason").isNull()), log_path, n_partitions, arrival, batch=batch_id, stream=stream)
    if rejects_path:
        (rejects(staged).drop(_PLACE).withColumn("batch", F.lit(batch_id))
         .write.mode("overwrite").parquet(f"{rejects_path}/stream={stream or 'none'}/batch={batch_id}"))
    if outcomes_path:
        (staged.select(F.col("source_time").alias("arrived"), "reject_reason").write.mode("overwrite")
         .parquet(f"{outcomes_path}/stream={stream or 'none'}/batch={batch_id}"))
    if on_metrics:
        counts = staged.agg(F.count(F.lit(1)).alias("rows"), F.count("reject_reason").alias("rejected")).first()
        on_metrics(batch_id, counts.rows, counts.rejected)


def ingest_batch(batch: DataFrame, batch_id: int, log_path: str, n_partitions: int, rejects_path: str | None, stream: str = "",
                 on_metrics: Callable[[int, int, int], None] | None = None, outcomes_path: str | None = None) -> None:
    """Append one micro-batch of parsed records."""
    spark = batch.sparkSession
    path = scratch_path(spark, "ingest")
    try:
        # the place of a row inside its task grows along each block that the task reads
        batch.withColumn(_PLACE, F.monotonically_increasing_id()).write.parquet(path)
        _append(spark.read.parquet(path), batch_id, log_path, n_partitions, rejects_path, stream, on_metrics, outcomes_path)
    finally:
        remove(spark, path)   # a micro-batch leaves nothing behind in the scratch space


def ingest_lines(batch: DataFrame, batch_id: int, log_path: str, n_partitions: int, rejects_path: str | None, stream: str = "",
                 event_time: str = "ingest", on_metrics: Callable[[int, int, int], None] | None = None,
                 outcomes_path: str | None = None) -> None:
    """Append one micro-batch of lines that were parsed one by one (``parsed_lines``): records that go over several lines
    are put together first."""
    spark = batch.sparkSession
    path = scratch_path(spark, "ingest")
    try:
        batch.withColumn("place", F.monotonically_increasing_id()).write.parquet(f"{path}/lines")
        whole, joined = split_records(spark.read.parquet(f"{path}/lines"), f"{path}/blocks")
        rows = whole.drop("line", "code", "cr").withColumnRenamed("place", _PLACE)
        if joined is not None:
            again = parse_records(csv_lines(joined, keep=[*ARRIVAL, "place"]), event_time=event_time, keep=["place"])
            rows.unionByName(again.withColumnRenamed("place", _PLACE)).write.parquet(f"{path}/records")
            rows = spark.read.parquet(f"{path}/records")
        _append(rows, batch_id, log_path, n_partitions, rejects_path, stream, on_metrics, outcomes_path)
    finally:
        remove(spark, path)


def parsed_lines(lines: DataFrame, event_time: str) -> DataFrame:
    """Every line parsed as if it were a record, beside its text, file, block and code."""
    kept = ["line", "code", "cr"]
    return parse_records(csv_lines(lines, keep=[*kept, *ARRIVAL]), event_time=event_time, keep=kept)


def _files_begun() -> Column:
    """Files whose first line is among the rows: as many header lines, which are no records."""
    return F.size(F.collect_set(F.when(F.col("source_block") == 0, F.col("source_file"))))


def ingest_stream(spark: SparkSession, csv_dir, log_path: str, checkpoint: str,
                  n_partitions: int = DEFAULT_PARTITIONS, event_time: str = "ingest",
                  trigger: str = "1 second", rejects_path: str | None = None,
                  max_files_per_trigger: int | None = DEFAULT_FILES_PER_TRIGGER, multi_line: bool | str = "auto",
                  on_metrics: Callable[[int, int, int], None] | None = None, outcomes_path: str | None = None) -> StreamingQuery:
    """Start the ingest query (poll interval = ``trigger``; 'availableNow' drains and stops).

    ``csv_dir`` is one folder or a list of folders (several producers, one writer).  ``multi_line="auto"`` splits files
    across tasks and honours line breaks inside quoted cells; ``True`` reads every file whole; ``False`` takes every
    line for a record.

    Parse-error counters: the query progress holds observedMetrics["ingest"] (rows, rejected).  With ``"auto"`` that
    counts lines, before records are put together; ``on_metrics(batch id, rows, rejected)`` is called after each
    micro-batch with the counts of its records, which are those of the log and the dead-letter folder.  With
    ``outcomes_path`` every record's arrival (its file's time) and reject reason are written there (``windows.alert_stream``).
    """
    if multi_line == "auto":
        folders = [csv_dir] if isinstance(csv_dir, str) else list(csv_dir)
        lines = reduce(DataFrame.unionAll, [stream_lines(spark, f, max_files_per_trigger) for f in folders])
        line = F.when(F.col("code") != BLANK, F.lit(1))
        failed = F.count(F.when(F.col("code") != BLANK, F.col("reject_reason")))
        parsed = parsed_lines(lines, event_time).observe("ingest", (F.count(line) - _files_begun()).alias("rows"),
                                                         F.greatest(failed - _files_begun(), F.lit(0)).alias("rejected"))
        one = lambda df, bid: ingest_lines(df, bid, log_path, n_partitions, rejects_path, query_id(df.sparkSession), event_time, on_metrics, outcomes_path)
    else:
        raw = stream_csv(spark, csv_dir, multi_line=multi_line is True, max_files_per_trigger=max_files_per_trigger)
        parsed = parse_records(raw, event_time=event_time).observe(
            "ingest", F.count(F.lit(1)).alias("rows"), F.count("reject_reason").alias("rejected"))
        one = lambda df, bid: ingest_batch(df, bid, log_path, n_partitions, rejects_path, query_id(df.sparkSession), on_metrics, outcomes_path)
    w = parsed.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return _trigger(w, trigger).start()
