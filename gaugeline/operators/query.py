"""Query side: device list, one device's records by time and page, counts, pages.

All functions take the telemetry table as a DataFrame (``sources.read_table``
or an adapter) and return DataFrames; nothing is collected.  Predicates are on
bare columns with literal bounds so they reach the Parquet scan
(PushedFilters), and when the table carries ``partition_id`` the device's
partition is added as a literal so the scan prunes directories.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, functions as F

from gaugeline.functions.partition import partition_id_of
from gaugeline.functions.timeparse import parse_rfc3339, ts_literal, utc_wall_clock
from gaugeline.operators.numbering import number_rows
from gaugeline.schema import DATE_COLUMN, DEFAULT_PAGE_SIZE, MAX_PAGE_SIZE, TELEMETRY_COLUMNS

#: Pages that end within so many rows are sorted with a limit: each task then holds so many rows at most.
SORTED_ROWS = 100_000
_ROW = "_page_row"

# Fixed value: accepted text of a page argument (within 64 bits).
_INTEGER = re.compile(r"[+-]?[0-9]+")


def _integer(arg) -> int | None:
    if isinstance(arg, bool) or not isinstance(arg, (int, str)):
        return None
    if isinstance(arg, str) and not _INTEGER.fullmatch(arg):
        return None
    n = int(arg)
    return n if -2**63 <= n < 2**63 else None


def normalize_page(page) -> int:
    """Page number argument: anything not an integer >= 1 means page 1."""
    p = _integer(page)
    return p if p is not None and p >= 1 else 1


def normalize_page_size(size) -> int:
    """Page size argument: anything not an integer in [1, 1000] means 100."""
    s = _integer(size)
    return s if s is not None and 1 <= s <= MAX_PAGE_SIZE else DEFAULT_PAGE_SIZE


@dataclass(frozen=True)
class TimeRange:
    start: datetime | None = None
    end: datetime | None = None

    @classmethod
    def parse(cls, start=None, end=None) -> "TimeRange":
        s, e = parse_rfc3339(start), parse_rfc3339(end)
        if s is not None and e is not None and s > e:
            raise ValueError("start_time must be before or equal to end_time")
        return cls(s, e)


def order_key(df: DataFrame) -> list[str]:
    """Time order with a unique tie-break (the source order is undefined on ties)."""
    if "id" in df.columns:
        return ["timestamp", "id"]
    if "offset" in df.columns and "partition_id" in df.columns:
        return ["timestamp", "partition_id", "offset"]
    raise ValueError("no total order: the records need an 'id' or a log key (partition_id, offset)")


def time_filter(df: DataFrame, rng: TimeRange) -> Column:
    dt = df.schema["timestamp"].dataType
    cond = F.lit(True)
    if rng.start is not None:
        cond = cond & (F.col("timestamp") >= ts_literal(rng.start, dt))
    if rng.end is not None:
        cond = cond & (F.col("timestamp") <= ts_literal(rng.end, dt))
    return cond & _dates(df, rng.start, rng.end)


def _dates(df: DataFrame, start: datetime | None, end: datetime | None) -> Column:
    """The same bounds on the table's UTC date directories, if it has them."""
    cond = F.lit(True)
    if DATE_COLUMN in df.columns:
        if start is not None:
            cond = cond & (F.col(DATE_COLUMN) >= F.lit(start.astimezone(timezone.utc).date()))
        if end is not None:
            cond = cond & (F.col(DATE_COLUMN) <= F.lit(end.astimezone(timezone.utc).date()))
    return cond


def device_filter(df: DataFrame, uuid: str, n_partitions: int | None = None) -> Column:
    if uuid is None or uuid == "":
        raise ValueError("UUID is required")
    cond = F.col("uuid") == F.lit(uuid)
    if "partition_id" in df.columns and n_partitions:
        cond = (F.col("partition_id") == F.lit(partition_id_of(uuid, n_partitions))) & cond
    return cond


def select_records(df: DataFrame, uuid: str, start=None, end=None,
                   n_partitions: int | None = None) -> DataFrame:
    """F3-F5: one device, optional inclusive time bounds."""
    rng = start if isinstance(start, TimeRange) else TimeRange.parse(start, end)
    return df.where(device_filter(df, uuid, n_partitions) & time_filter(df, rng))


def list_uuids(df: DataFrame) -> DataFrame:
    """Distinct devices in binary order (partial aggregate per task, then one small sort)."""
    return df.select("uuid").distinct().orderBy("uuid")


def count_records(df: DataFrame, uuid: str, start=None, end=None,
                  n_partitions: int | None = None) -> DataFrame:
    """One row: ``total`` records of the device in the range."""
    sel = select_records(df, uuid, start, end, n_partitions)
    return sel.agg(F.count(F.lit(1)).cast("long").alias("total"))


def page_meta(df: DataFrame, uuid: str, start=None, end=None, page=1,
              page_size=DEFAULT_PAGE_SIZE, n_partitions: int | None = None) -> DataFrame:
    """One row: page, page_size, total, total_pages (at least 1), found.

    ``found`` is false when the requested page holds no record (the service's
    "not found" answer, also when the device has records on earlier pages).
    """
    p, s = normalize_page(page), normalize_page_size(page_size)
    total = count_records(df, uuid, start, end, n_partitions)
    return total.select(F.lit(p).alias("page"), F.lit(s).alias("page_size"), "total",
                        _total_pages(F.col("total"), s).alias("total_pages"),
                        (F.col("total") > F.lit(min((p - 1) * s, 2**63 - 1))).alias("found"))


def _total_pages(total: Column, size: int) -> Column:
    return F.greatest(F.ceil(total / F.lit(size)), F.lit(1)).cast("long")


def records_page(df: DataFrame, uuid: str, start=None, end=None, page=1,
                 page_size=DEFAULT_PAGE_SIZE, n_partitions: int | None = None) -> DataFrame:
    """L1+L2: one page of a device's records in time order.

    To walk deep into a device use ``records_after`` (one page of work at any depth), ``page_all`` or, with a rollup,
    ``rollup.page_by_rollup``.
    """
    p, s = normalize_page(page), normalize_page_size(page_size)
    return ordered_page(select_records(df, uuid, start, end, n_partitions), (p - 1) * s, s)


def ordered_page(sel: DataFrame, skip: int, size: int) -> DataFrame:
    """Rows ``skip + 1`` to ``skip + size`` in time order, at any depth.

    Up to SORTED_ROWS an ORDER BY with OFFSET and LIMIT, for which each task keeps its first offset + size rows; past that
    the rows are numbered by stored ranges, with 64-bit numbers and no more than a range in a task.
    """
    if skip + size <= SORTED_ROWS:
        return sel.orderBy(*order_key(sel)).offset(skip).limit(size)
    numbered = number_rows(sel, [], order_key(sel), out_col=_ROW)
    return numbered.where((F.col(_ROW) > min(skip, 2**63 - 1)) & (F.col(_ROW) <= min(skip + size, 2**63 - 1))).orderBy(_ROW).drop(_ROW)


def records_after(df: DataFrame, uuid: str, after: tuple | None = None, page_size=DEFAULT_PAGE_SIZE,
                  start=None, end=None, n_partitions: int | None = None) -> DataFrame:
    """Keyset paging: the next ``page_size`` records of a device after a cursor.

    ``after`` is the order key of the last record of the previous page, e.g.
    ``(timestamp, id)`` (see ``order_key``); None starts at the beginning.  The
    cost is one page at any depth (no offset rows are gathered), and the cursor's
    timestamp is a pushed lower bound on the scan.
    """
    s = normalize_page_size(page_size)
    sel = select_records(df, uuid, start, end, n_partitions)
    key = order_key(sel)
    if after is not None:
        if len(after) != len(key):
            raise ValueError(f"cursor must hold {len(key)} values: {key}")
        types = {f.name: f.dataType for f in sel.schema.fields}
        vals = [ts_literal(v if v.tzinfo else v.replace(tzinfo=timezone.utc), types[c])
                if isinstance(v, datetime) else F.lit(v).cast(types[c]) for c, v in zip(key, after)]
        # (k1, k2, ...) > (v1, v2, ...), plus k1 >= v1 as a pushable bound
        later = None
        for i in range(len(key) - 1, -1, -1):
            here = F.col(key[i]) > vals[i]
            later = here if later is None else here | ((F.col(key[i]) == vals[i]) & later)
        sel = sel.where((F.col(key[0]) >= vals[0]) & later)
    return sel.orderBy(*key).limit(s)


def telemetry_by_uuid(df: DataFrame, uuid: str, start_time=None, end_time=None, page=1,
                      page_size=DEFAULT_PAGE_SIZE, n_partitions: int | None = None
                      ) -> tuple[DataFrame, DataFrame]:
    """L6: the device query — (page of records, one-row pagination meta).

    Arguments follow the service rules: empty uuid and bad or reversed times
    raise ValueError; a bad page means 1, a bad page size means 100.  An empty
    page is an empty DataFrame (the meta still tells the total).
    """
    rng = TimeRange.parse(start_time, end_time)
    rows = records_page(df, uuid, rng, None, page, page_size, n_partitions)
    rows = rows.select(*[c for c in TELEMETRY_COLUMNS if c in rows.columns])
    meta = page_meta(df, uuid, rng, None, page, page_size, n_partitions)
    return rows, meta


def page_all(df: DataFrame, page_size=DEFAULT_PAGE_SIZE, start=None, end=None,
             num_tasks: int | None = None) -> DataFrame:
    """L3: every record of every device with its 1-based row number and page.

    Uses the skew-safe numbering: a device holding a third of the table is
    spread over many tasks instead of one window partition.
    """
    s = normalize_page_size(page_size)
    rng = TimeRange.parse(start, end)
    sel = df.where(time_filter(df, rng))
    numbered = number_rows(sel, ["uuid"], order_key(sel), out_col="rn", num_ranges=num_tasks)
    return numbered.withColumn("page", (F.floor((F.col("rn") - 1) / s) + 1).cast("long"))


def page_meta_all(df: DataFrame, page_size=DEFAULT_PAGE_SIZE, start=None, end=None) -> DataFrame:
    """Pagination meta of every device: uuid, page_size, total, total_pages."""
    s = normalize_page_size(page_size)
    rng = TimeRange.parse(start, end)
    totals = df.where(time_filter(df, rng)).groupBy("uuid").agg(
        F.count(F.lit(1)).cast("long").alias("total"))
    return totals.select("uuid", F.lit(s).alias("page_size"), "total",
                         _total_pages(F.col("total"), s).alias("total_pages"))


def recent_records(df: DataFrame, as_of, duration: str = "2 minutes") -> DataFrame:
    """ST9: records stamped within ``duration`` before ``as_of`` (both ends inclusive)."""
    at = parse_rfc3339(as_of) if not isinstance(as_of, datetime) else as_of
    dt = df.schema["timestamp"].dataType
    hi = ts_literal(at, dt)
    lo = hi - F.expr(f"INTERVAL {duration}")
    cond = (F.col("timestamp") >= lo) & (F.col("timestamp") <= hi)
    if DATE_COLUMN in df.columns:
        first = utc_wall_clock(lo, dt).cast("date")
        cond = cond & (F.col(DATE_COLUMN) >= first) & (F.col(DATE_COLUMN) <= utc_wall_clock(hi, dt).cast("date"))
    return df.where(cond)
