"""The collector loop: poll a group, persist what came, commit the position, until nothing is left.

Positions are committed after the rows are persisted.  A poll is known by its start positions, so one repeated after a crash in
between is recognised by the table and adds nothing.
"""

from __future__ import annotations

from pyspark.sql import SparkSession, functions as F

from gaugeline.operators.log import load_positions, log_state, merge_positions, poll, save_positions
from gaugeline.schema import DEFAULT_MAX_RECORDS, DEFAULT_PARTITIONS
from gaugeline.sources.log import read_log
from gaugeline.streaming.consume import persist_batch


def collect_loop(spark: SparkSession, log_path: str, table_path: str, positions_path: str, group: str,
                 max_records: int = DEFAULT_MAX_RECORDS, n_partitions: int = DEFAULT_PARTITIONS, max_polls: int | None = None) -> int:
    """Run the loop until ``has_more`` is false (or ``max_polls`` polls are done); returns the number of polls."""
    polls = 0
    while max_polls is None or polls < max_polls:
        ends, _, _ = log_state(spark, log_path, n_partitions)
        known = spark.createDataFrame(list(ends.items()), "partition_id int, next_offset long")
        positions = load_positions(spark, positions_path)
        records, status = poll(read_log(spark, log_path), positions, group, max_records, n_partitions, known)
        at, got, more = status.agg(F.sum("start_offset"), F.sum("records"), F.max("has_more")).first()
        if got:
            persist_batch(records.drop("group"), table_path, n_partitions, group, int(at))
            save_positions(merge_positions(positions, status), positions_path)
        polls += 1
        if not more:
            break
    return polls
