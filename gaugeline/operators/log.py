"""The partitioned record log as data: append with offsets, consume by position.

Offsets are dense per partition (0, 1, 2, ...), so "at most m records from
offset o" is the range predicate o <= offset < o + m: no sort-and-limit, and
the predicate reaches the Parquet scan (directory pruning on partition_id,
row-group skipping on offset because files are written sorted by offset).

Consumer-group positions are small control data (groups x partitions rows): a group read scans once under literal
offset intervals and joins the groups' ranges by band.

An append is committed by a small numbered document (``commits``): the end offsets and the last micro-batch of each
stream.  Rows beyond the committed ends are leftovers of an append that never finished; the next append removes their
files first, so a replayed micro-batch is whole, however much of it had landed.
"""

from __future__ import annotations

import threading
from collections import defaultdict
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gaugeline.functions.timeparse import utc_instant
from gaugeline.operators.commits import exists, file_system, read_commit, remove, write_commit
from gaugeline.operators.numbering import number_rows
from gaugeline.operators.partitioning import with_partition
from gaugeline.operators.query import device_filter, order_key
from gaugeline.schema import DEFAULT_MAX_RECORDS, DEFAULT_PARTITIONS, LOG_SCHEMA
from gaugeline.session import scratch_path
from gaugeline.sources.log import read_log

POSITIONS_SCHEMA = "group string, partition_id int, next_offset long"

# Output batching: no log or table file holds more rows than this.
MAX_RECORDS_PER_FILE = 4_000_000

# Log files are sorted by offset, so min/max statistics say nothing about devices: a Bloom filter per row group does, sized by
# the devices it holds (written where the devices outgrow the column's dictionary, which readers look into as well).
DEVICE_INDEX = {"parquet.bloom.filter.enabled#uuid": "true", "parquet.bloom.filter.adaptive.enabled": "true"}


# --------------------------------------------------------------------- append
def end_offsets(log: DataFrame, n_partitions: int = DEFAULT_PARTITIONS) -> DataFrame:
    """A6: next write offset of every partition (max offset + 1, 0 when empty).

    Reads only (partition_id, offset); one partial max per task.
    """
    spark = log.sparkSession
    parts = spark.range(n_partitions).select(F.col("id").cast("int").alias("partition_id"))
    ends = log.groupBy("partition_id").agg((F.max("offset") + 1).alias("next_offset"))
    return (parts.join(F.broadcast(ends), "partition_id", "left")   # <= n_partitions rows
            .select("partition_id", F.coalesce("next_offset", F.lit(0)).cast("long").alias("next_offset")))


def assign_offsets(df: DataFrame, n_partitions: int = DEFAULT_PARTITIONS, order_cols=None,
                   base: DataFrame | None = None, num_ranges: int | None = None, scratch: str | None = None) -> DataFrame:
    """ST1: ``partition_id`` + consecutive ``offset`` per partition in arrival order.

    ``order_cols`` is the arrival order (must be total); ``base`` holds the
    partitions' current end offsets (``end_offsets``) so numbering continues
    the log.  Each partition may hold a third of the rows: the numbering is
    the skew-safe one, spread over ``num_ranges`` tasks.
    """
    p = df if "partition_id" in df.columns else with_partition(df, n_partitions)
    order = list(order_cols or order_key(p))
    if base is not None:
        # base has one row per log partition: a bounded broadcast
        p = p.join(F.broadcast(base.withColumnRenamed("next_offset", "_base")), "partition_id", "left")
        start = F.coalesce(F.col("_base"), F.lit(0))
    else:
        p = p.withColumn("_base", F.lit(0).cast("long"))
        start = F.col("_base")
    out = number_rows(p, ["partition_id"], order, out_col="offset", num_ranges=num_ranges, start=start,
                      scratch=scratch)
    return out.drop("_base")


def to_log_rows(df: DataFrame, batch: int | None = None) -> DataFrame:
    """Project onto the log layout (record + partition_id + offset + batch)."""
    cols = []
    for f in LOG_SCHEMA.fields:
        if f.name == "batch":
            c = F.lit(batch).cast("long") if batch is not None or "batch" not in df.columns else F.col("batch")
        elif f.name == "timestamp":
            c = utc_instant(F.col("timestamp"), df.schema["timestamp"].dataType)
        else:
            c = F.col(f.name).cast(f.dataType)
        cols.append(c.alias(f.name))
    return df.select(*cols)


# The commit this process wrote last, per log: while it still is the newest one, no look at the data is needed.
_WRITTEN: dict[tuple[str, str], int] = {}
# One append at a time per log and process; of several processes, all but one fail at the commit.
_LOCKS: dict[str, threading.Lock] = defaultdict(threading.Lock)


def _beyond(ends: dict, n_partitions: int) -> Column:
    known = F.col("partition_id").isin(*range(n_partitions))
    return reduce(lambda a, b: a | b, [(F.col("partition_id") == F.lit(p)) & (F.col("offset") >= F.lit(ends.get(p, 0)))
                                       for p in range(n_partitions)], ~known)


def log_state(spark: SparkSession, path: str, n_partitions: int = DEFAULT_PARTITIONS) -> tuple[dict, dict, int]:
    """(end offsets by partition, last micro-batch by stream, commit number) of the newest commit, a few bytes.

    A log without any commit (written by other means) is taken as it is, at the cost of one aggregate over
    partition_id and offset.
    """
    path = path.rstrip("/")
    if not exists(spark, path):
        return {p: 0 for p in range(n_partitions)}, {}, -1
    number, doc = read_commit(spark, path)
    if doc is None:
        ends = {r.partition_id: r.next_offset for r in end_offsets(read_log(spark, path), n_partitions).collect()}
        return ends, {}, number
    return {p: int(doc["ends"].get(str(p), 0)) for p in range(n_partitions)}, doc.get("streams", {}), number


def _remove_leftovers(spark: SparkSession, path: str, ends: dict, n_partitions: int) -> None:
    """Delete the files of an append that was never committed (the writer calls this, readers never).

    One pruned probe finds them: files are sorted by offset, so row-group statistics skip everything below the ends.
    """
    left = read_log(spark, path).where(_beyond(ends, n_partitions)).select(F.input_file_name()).distinct().collect()
    for r in left:   # the files of one append; their names come URI-encoded
        remove(spark, unquote(r[0]))


def append_log(df: DataFrame, path: str, n_partitions: int = DEFAULT_PARTITIONS, order_cols=None,
               batch: int | None = None, num_ranges: int | None = None, stream: str = "") -> DataFrame:
    """K1: append records to the log at ``path``; returns the K2 report.

    Jobs: the range write of the numbering, the records per partition, the log write; before the first and after the last
    a commit.  With a ``batch`` id the append is idempotent per ``stream``: a micro-batch that is committed is
    skipped (each stream counts its own), one that landed in part is replaced.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    app = (spark.sparkContext.applicationId, path)
    with _LOCKS[path]:
        ends, streams, number = log_state(spark, path, n_partitions)
        last = streams.get(stream)
        if batch is not None and last is not None and batch <= last["batch"]:
            return _report_rows(spark, last["report"] if batch == last["batch"] else [])
        if number >= 0 and _WRITTEN.get(app) != number:   # another process wrote the commit, or an append failed here
            _remove_leftovers(spark, path, ends, n_partitions)
        if number < 0:   # from here on, rows without a commit of their own are leftovers
            number += 1
            write_commit(spark, path, number, {"ends": {str(k): v for k, v in ends.items()}, "streams": streams})
        p = df if "partition_id" in df.columns else with_partition(df, n_partitions)
        base = spark.createDataFrame([(k, int(v)) for k, v in ends.items()], "partition_id int, next_offset long")
        scratch = scratch_path(spark, "append")
        try:
            logged = assign_offsets(p, n_partitions, order_cols, base, num_ranges, scratch)
            counts = {r.partition_id: r.n for r in
                      logged.groupBy("partition_id").agg(F.count(F.lit(1)).alias("n")).collect()}  # <= n rows
            report = [[k, int(v), int(ends.get(k, 0) + v)] for k, v in sorted(counts.items())]
            if not counts:
                return _report_rows(spark, report)
            _WRITTEN.pop(app, None)   # a failure in between is caught by the probe
            (to_log_rows(logged, batch).sortWithinPartitions("partition_id", "offset")
             .write.mode("append").option("maxRecordsPerFile", str(MAX_RECORDS_PER_FILE)).options(**DEVICE_INDEX)
             .partitionBy("partition_id").parquet(path))
        finally:
            remove(spark, scratch)
        ends = {**ends, **{k: after for k, _, after in report}}
        if batch is not None:
            streams = {**streams, stream: {"batch": batch, "report": report}}
        write_commit(spark, path, number + 1, {"ends": {str(k): int(v) for k, v in ends.items()}, "streams": streams})
        _WRITTEN[app] = number + 1
        return _report_rows(spark, report)


def _report_rows(spark: SparkSession, report: list) -> DataFrame:
    """K2: per partition, records appended and the next offset after them."""
    return spark.createDataFrame([tuple(r) for r in report], "partition_id int, records long, next_offset long")


def produce_responses(batch: DataFrame, report: DataFrame,
                      n_partitions: int = DEFAULT_PARTITIONS) -> DataFrame:
    """K2 per record: each appended record answered with success and the next
    offset of its partition after the append (the report has <= n_partitions
    rows: a bounded broadcast)."""
    p = batch if "partition_id" in batch.columns else with_partition(batch, n_partitions)
    r = report.select("partition_id", F.col("next_offset").alias("offset"))
    return p.join(F.broadcast(r), "partition_id", "left").withColumn(
        "success", F.col("offset").isNotNull())


# -------------------------------------------------------------------- consume
def consume(log: DataFrame, partition_id: int, offset: int = 0,
            max_records: int = DEFAULT_MAX_RECORDS) -> DataFrame:
    """ST2 + L4: up to ``max_records`` records of one partition from ``offset``, in order.

    An offset at or past the end gives no rows.
    """
    return (log.where((F.col("partition_id") == F.lit(partition_id))
                      & (F.col("offset") >= F.lit(offset))
                      & (F.col("offset") < F.lit(offset + max_records)))
            .orderBy("offset"))


def device_log(log: DataFrame, uuid: str, n_partitions: int = DEFAULT_PARTITIONS) -> DataFrame:
    """F3 on the log: all records of one device, straight from the log (none for a device it doesn't hold).

    Reads the directory of the device's partition, and there only row groups whose Bloom filter or dictionary may hold it.
    """
    return log.where(device_filter(log, uuid, n_partitions))


def positions_frame(spark: SparkSession, positions) -> DataFrame:
    """(group, partition_id, next_offset) from a DataFrame, a dict or tuples."""
    if isinstance(positions, DataFrame):
        return positions
    rows = []
    if isinstance(positions, dict):
        for g, parts in positions.items():
            for pid, off in (parts or {}).items():
                rows.append((g, int(pid), int(off)))
    else:
        rows = [tuple(r) for r in positions]
    return spark.createDataFrame(rows, POSITIONS_SCHEMA)


def group_starts(spark: SparkSession, positions, groups: list[str] | None,
                 n_partitions: int) -> DataFrame:
    """ST3: start offset of every (group, partition): stored position, else 0."""
    pos = positions_frame(spark, positions)
    if groups is None:
        g = pos.select("group").distinct()
    else:
        g = spark.createDataFrame([(x,) for x in groups], "group string")
    # every group gets every partition id (groups x partitions control rows)
    grid = g.select("group", F.explode(F.sequence(F.lit(0), F.lit(n_partitions - 1)).cast("array<int>"))
                    .alias("partition_id"))
    return (grid.join(pos, ["group", "partition_id"], "left")
            .select("group", "partition_id", F.coalesce("next_offset", F.lit(0)).cast("long")
                    .alias("start_offset")))


def consume_groups(log: DataFrame, positions, groups: list[str] | None = None,
                   max_records: int = DEFAULT_MAX_RECORDS,
                   n_partitions: int = DEFAULT_PARTITIONS) -> DataFrame:
    """ST3 + U1: for each group and partition, up to ``max_records`` records from
    the group's position (0 when it has none); output carries a ``group`` column.

    One scan: the groups' ranges, merged to INTERVALS intervals per log partition at most, become a literal predicate that
    reaches Parquet, so an idle group does not make the others read everything between.  A row meets only the
    groups whose range touches its band of ``max_records`` offsets (an equi-join), never all of them.
    """
    spark = log.sparkSession
    starts = group_starts(spark, positions, groups, n_partitions)
    rows = starts.select("partition_id", "start_offset").distinct().collect()   # control data
    if not rows:
        return log.limit(0).withColumn("group", F.lit(None).cast("string"))
    bound = reduce(lambda a, b: a | b, [
        (F.col("partition_id") == F.lit(p)) & (F.col("offset") >= F.lit(lo)) & (F.col("offset") < F.lit(hi))
        for p in sorted({r.partition_id for r in rows})
        for lo, hi in merged_intervals([r.start_offset for r in rows if r.partition_id == p], max_records)])
    band = lambda c: F.expr(f"{c} div {max_records}")
    ranges = starts.select("group", F.col("partition_id").alias("_pid"), "start_offset",
                           F.explode(F.sequence(band("start_offset"), band(f"(start_offset + {max_records - 1})"))).alias("_band"))
    scoped = log.where(bound).withColumn("_own", band("offset"))
    cond = ((F.col("partition_id") == F.col("_pid")) & (F.col("_own") == F.col("_band"))
            & (F.col("offset") >= F.col("start_offset")) & (F.col("offset") < F.col("start_offset") + F.lit(max_records)))
    return scoped.join(ranges, cond, "inner").drop("_pid", "_own", "_band", "start_offset")


# Literal offset intervals per log partition in one scan predicate.
INTERVALS = 16


def merged_intervals(starts: list[int], size: int, most: int = INTERVALS) -> list[tuple[int, int]]:
    """The ranges [start, start + size) as at most ``most`` intervals, closing the smallest gaps."""
    out: list[list[int]] = []
    for s in sorted(set(starts)):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s + size)
        else:
            out.append([s, s + size])
    while len(out) > most:
        k = min(range(len(out) - 1), key=lambda i: out[i + 1][0] - out[i][1])
        out[k:k + 2] = [[out[k][0], out[k + 1][1]]]
    return [(a, b) for a, b in out]


def consume_status(ends: DataFrame, positions, groups: list[str] | None = None,
                   max_records: int = DEFAULT_MAX_RECORDS,
                   n_partitions: int = DEFAULT_PARTITIONS) -> DataFrame:
    """ST4 + ST6: per (group, partition): records returned, next position, more left?

    Computed from the end offsets (A6) alone; ``next_offset`` is the group's new
    position (the requested one when nothing was read, also past the end).
    """
    spark = ends.sparkSession
    starts = group_starts(spark, positions, groups, n_partitions)
    j = starts.join(F.broadcast(ends), "partition_id", "left")   # ends: n_partitions rows
    end = F.coalesce(F.col("next_offset"), F.lit(0))
    start = F.col("start_offset")
    got = F.greatest(F.least(start + F.lit(max_records), end) - start, F.lit(0))
    return j.select("group", "partition_id", "start_offset",
                    got.cast("long").alias("records"),
                    (start + got).cast("long").alias("next_offset"),
                    ((start + got) < end).alias("has_more"))


def advance_positions(status: DataFrame) -> DataFrame:
    """ST4: the groups' new stored positions."""
    return status.select("group", "partition_id", "next_offset")


def export_log_json(log: DataFrame, path: str) -> None:
    """S3 interchange form: NDJSON, one record object (+ offset) per line, by partition."""
    from gaugeline.functions.records import record_to_json
    # the record object with one more member: {...,"offset":N}
    body = F.concat(F.substr(F.col("_j"), F.lit(1), F.length("_j") - 1),
                    F.lit(',"offset":'), F.col("offset").cast("string"), F.lit("}"))
    from pyspark.sql import types as T
    ntz = isinstance(log.schema["timestamp"].dataType, T.TimestampNTZType)
    # contiguous offset ranges per task: as many tasks as the log needs, not one per log partition
    n = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (log.select("partition_id", "offset", record_to_json(ntz=ntz).alias("_j"))
     .select("partition_id", "offset", body.alias("value"))
     .repartitionByRange(n, "partition_id", "offset").sortWithinPartitions("partition_id", "offset")
     .select("partition_id", "value")
     .write.mode("overwrite").option("maxRecordsPerFile", str(MAX_RECORDS_PER_FILE)).partitionBy("partition_id").text(path))


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions of the stored positions, oldest first."""
    fs, hpath = file_system(spark, f"{path.rstrip('/')}/v=*/_SUCCESS")
    return sorted(int(s.getPath().getParent().getName()[2:]) for s in fs.globStatus(hpath) or [])


def save_positions(positions: DataFrame, path: str) -> None:
    """Store the positions as a new version; the one before stays until the next is complete, so a crash loses nothing."""
    spark, path = positions.sparkSession, path.rstrip("/")
    old = _versions(spark, path)
    number = old[-1] + 1 if old else 0
    positions.coalesce(1).write.mode("overwrite").parquet(f"{path}/v={number}")   # groups x partitions rows
    for v in old[:-1]:
        remove(spark, f"{path}/v={v}")


def load_positions(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete version (none: no positions)."""
    found = _versions(spark, path)
    if not found:
        return spark.createDataFrame([], POSITIONS_SCHEMA)
    return spark.read.schema(POSITIONS_SCHEMA).parquet(f"{path.rstrip('/')}/v={found[-1]}")


def poll(log: DataFrame, positions, group: str, max_records: int = DEFAULT_MAX_RECORDS,
         n_partitions: int = DEFAULT_PARTITIONS, ends: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """One consumer-group read (offset -1 = "from my stored position").

    Returns (records, status); commit ``advance_positions(status)`` with
    ``merge_positions`` once the records are processed (at-least-once).
    """
    pos = positions_frame(log.sparkSession, positions)
    mine = pos.where(F.col("group") == F.lit(group))
    records = consume_groups(log, mine, [group], max_records, n_partitions)
    ends = end_offsets(log, n_partitions) if ends is None else ends
    status = consume_status(ends, mine, [group], max_records, n_partitions)
    return records, status


def merge_positions(positions, status: DataFrame) -> DataFrame:
    """Stored positions with the groups in ``status`` replaced by their new ones.

    A full outer join on (group, partition_id); the new position wins.
    """
    spark = status.sparkSession
    old = positions_frame(spark, positions).alias("o")
    new = advance_positions(status).alias("n")
    j = old.join(new, ["group", "partition_id"], "full")
    return j.select("group", "partition_id",
                    F.coalesce(F.col("n.next_offset"), F.col("o.next_offset")).cast("long").alias("next_offset"))
