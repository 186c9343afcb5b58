"""The telemetry table: layout, NOT NULL expectations, persist, insert-if-absent.

Layout: ``date=<UTC day>/partition_id=<k>/`` directories (a time window prunes to its days, a device query to its hash
partition), files range-clustered on (uuid, timestamp) so a device/time predicate skips row groups by their min/max
statistics — the role of the original (uuid, timestamp) index.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from gaugeline.functions.timeparse import utc_wall_clock
from gaugeline.operators.partitioning import with_partition
from gaugeline.schema import DATE_COLUMN, DEFAULT_PARTITIONS, TELEMETRY_COLUMNS

# Fixed value: columns declared NOT NULL by the table definition.
NOT_NULL = ["timestamp", "metric_name", "uuid", "value"]


def not_null_violations(df: DataFrame) -> DataFrame:
    """S5: rows breaking the NOT NULL constraint, with the offending column."""
    reason = None
    for c in NOT_NULL:
        cond = F.col(c).isNull()
        reason = F.when(cond, F.lit(f"null_{c}")) if reason is None else reason.when(cond, F.lit(f"null_{c}"))
    return df.withColumn("violation", reason).where(F.col("violation").isNotNull())


def require_not_null(df: DataFrame) -> DataFrame:
    """Rows as they are; a NULL in a NOT NULL column fails the job that reads them."""
    return df.withColumns({c: F.coalesce(F.col(c), F.raise_error(F.lit(f"NULL in NOT NULL column {c}")).cast(df.schema[c].dataType))
                           for c in NOT_NULL if c in df.columns})


def table_layout(df: DataFrame, n_partitions: int = DEFAULT_PARTITIONS,
                 num_files: int | None = None) -> DataFrame:
    """Range-cluster rows on (date, partition_id, uuid, timestamp, row key) for the write.

    One range shuffle: every task writes one contiguous key range, i.e. a few files with tight uuid/timestamp statistics.  The
    row key (log offset or id) comes last, so a hot device spans several tasks even where all its rows carry one timestamp.
    """
    p = df if "partition_id" in df.columns else with_partition(df, n_partitions)
    if DATE_COLUMN not in p.columns:
        p = p.withColumn(DATE_COLUMN, utc_wall_clock(F.col("timestamp"), p.schema["timestamp"].dataType).cast("date"))
    n = num_files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [DATE_COLUMN, "partition_id", "uuid", "timestamp"] + [c for c in ("offset", "id") if c in p.columns]
    return p.repartitionByRange(n, *keys).sortWithinPartitions(*keys)


def table_rows(df: DataFrame) -> DataFrame:
    """The 12 record columns plus any key columns present.

    The timestamp keeps its type: ingested records carry TIMESTAMP instants,
    tables derived from TIMESTAMP_NTZ sources keep their UTC wall clock (no
    conversion through the session time zone).
    """
    extra = [c for c in ("id", "partition_id", "offset") if c in df.columns]
    return df.select(*TELEMETRY_COLUMNS, *extra)


def persist(df: DataFrame, path: str, n_partitions: int = DEFAULT_PARTITIONS, mode: str = "append",
            num_files: int | None = None, rejects_path: str | None = None) -> None:
    """K3: write records to the table, all or nothing.

    A row that breaks NOT NULL fails the whole write, and nothing is committed; with ``rejects_path`` such rows are written there,
    with the violation, and the others to the table.
    """
    from gaugeline.operators.log import MAX_RECORDS_PER_FILE
    rows = table_rows(df)
    if rejects_path:
        not_null_violations(rows).write.mode("append").parquet(rejects_path)
        rows = rows.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in NOT_NULL]))
    (table_layout(require_not_null(rows), n_partitions, num_files)
     .write.mode(mode).option("maxRecordsPerFile", str(MAX_RECORDS_PER_FILE))
     .partitionBy(DATE_COLUMN, "partition_id").parquet(path))


def insert_if_absent(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """K4: rows of ``new`` whose key is absent from ``existing``; one row per key.

    The new side is reduced to one row per key; the existing side only lends its keys to an anti join.
    """
    return new.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def key_range_filter(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Restrict ``existing`` to the log-key ranges of ``new`` (per-partition min/max
    offset, one row per log partition) so an idempotent re-insert
    scans only the matching row groups."""
    rows = new.groupBy("partition_id").agg(F.min("offset").alias("lo"), F.max("offset").alias("hi")).collect()
    if not rows:
        return existing.limit(0)
    cond = reduce(lambda a, b: a | b, [
        (F.col("partition_id") == r.partition_id) & (F.col("offset") >= r.lo) & (F.col("offset") <= r.hi)
        for r in rows])
    return existing.where(cond)
