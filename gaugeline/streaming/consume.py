"""ST3-ST5 + ST7 + ST8 + K3/K4: one streaming query per consumer group reads the
log incrementally and persists it to the table.

The group's position is the query's checkpoint: a group resumes where it left off after a restart (ST8), and groups never
affect each other (ST5).  The checkpoint is committed after the batch is persisted (at-least-once).  The table keeps a
commit per stream (``operators.commits``): the micro-batch begun and the one done.  A batch that is done is skipped; one
that was begun and not done is inserted row by row only where its log key (partition_id, offset) is absent; any other
is appended without a look at the table, so a micro-batch costs the same however large the table is.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from gaugeline.operators.commits import exists, read_commit, write_commit
from gaugeline.operators.table import insert_if_absent, key_range_filter, persist
from gaugeline.schema import DEFAULT_PARTITIONS, LOG_KEY, LOG_SCHEMA
from gaugeline.streaming.ingest import _trigger, query_id

# Rows that a writing task sorts: what it holds doesn't grow with the micro-batch, and a large one is written by many tasks.
# Tasks write contiguous key ranges, so a task more is about a file more; a small micro-batch is one task instead of
# one per shuffle partition (no small-file build-up from frequent triggers).
ROWS_PER_TASK = 500_000


def _absent(batch: DataFrame, table_path: str) -> DataFrame:
    spark = batch.sparkSession
    keys = spark.read.schema("offset long, partition_id int").parquet(table_path)
    return insert_if_absent(batch, key_range_filter(keys, batch), LOG_KEY)


def persist_batch(batch: DataFrame, table_path: str, n_partitions: int, stream: str = "", batch_id: int | None = None) -> None:
    """Persist one batch of log rows once: by (stream, batch id), or by log key alone without a batch id."""
    spark, table_path = batch.sparkSession, table_path.rstrip("/")
    rows = batch.count()
    if rows == 0:
        return
    files = math.ceil(rows / ROWS_PER_TASK)
    if batch_id is None:
        batch = _absent(batch, table_path) if exists(spark, table_path) else batch
        persist(batch.drop("batch"), table_path, n_partitions, num_files=files)
        return
    number, doc = read_commit(spark, table_path)
    streams = (doc or {}).get("streams", {})
    own = streams.get(stream, {"begun": -1, "done": -1})
    if batch_id <= own["done"]:
        return
    if batch_id == own["begun"]:
        batch = _absent(batch, table_path)
    else:
        number += 1
        write_commit(spark, table_path, number, {"streams": {**streams, stream: {"begun": batch_id, "done": own["done"]}}})
    persist(batch.drop("batch"), table_path, n_partitions, num_files=files)
    write_commit(spark, table_path, number + 1, {"streams": {**streams, stream: {"begun": batch_id, "done": batch_id}}})


def consume_stream(spark: SparkSession, log_path: str, group: str, table_path: str,
                   checkpoint_root: str, n_partitions: int = DEFAULT_PARTITIONS,
                   trigger: str = "1 second", max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Start consumer group ``group``: log -> table, position kept in its checkpoint."""
    r = spark.readStream.schema(LOG_SCHEMA).option("basePath", log_path)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    stream = r.parquet(log_path)
    w = (stream.writeStream
         .foreachBatch(lambda df, bid: persist_batch(df, table_path, n_partitions, query_id(df.sparkSession), bid))
         .option("checkpointLocation", f"{checkpoint_root.rstrip('/')}/{group}"))
    return _trigger(w, trigger).start()
