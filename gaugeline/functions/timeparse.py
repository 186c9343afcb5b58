"""RFC 3339 arguments and timestamp literals.

Query bounds are single values given by the caller, so they are validated and
parsed once on the driver and enter the plan as literals (which keeps the
predicate pushable to the Parquet scan).
"""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

# Fixed value: RFC 3339 date-time (fraction optional, 'Z' or a numeric offset).
_RFC3339 = re.compile(
    r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:\d{2})$"
)


def parse_rfc3339(text: str | None) -> datetime | None:
    """Parse to an aware UTC datetime; '' / None -> None; bad text -> ValueError."""
    if text is None or text == "":
        return None
    if isinstance(text, datetime):
        return text if text.tzinfo else text.replace(tzinfo=timezone.utc)
    if not _RFC3339.match(text):
        raise ValueError(f"invalid RFC 3339 time: {text!r}")
    s = text.replace("Z", "+00:00")
    m = re.match(r"^(.*?\.)(\d+)(.*)$", s)
    if m:  # Python takes at most 6 fraction digits
        s = m.group(1) + m.group(2)[:6].ljust(6, "0") + m.group(3)
    try:
        return datetime.fromisoformat(s).astimezone(timezone.utc)
    except ValueError as e:
        raise ValueError(f"invalid RFC 3339 time: {text!r}") from e


def ts_literal(value: datetime, dtype: T.DataType) -> Column:
    """A literal of the column's own timestamp type (NTZ columns hold UTC)."""
    utc = value.astimezone(timezone.utc)
    text = utc.strftime("%Y-%m-%d %H:%M:%S.%f")
    if isinstance(dtype, T.TimestampNTZType):
        return F.lit(text).cast("timestamp_ntz")
    return F.to_timestamp(F.lit(text + "Z"), "yyyy-MM-dd HH:mm:ss.SSSSSSX")


def utc_instant(ts: Column, dtype: T.DataType) -> Column:
    """TIMESTAMP of a column; a TIMESTAMP_NTZ value is read as a UTC wall clock
    (not through the session time zone)."""
    if isinstance(dtype, T.TimestampNTZType):
        return F.from_utc_timestamp(ts.cast("timestamp"), F.current_timezone())
    return ts.cast("timestamp")


def utc_wall_clock(ts: Column, dtype: T.DataType) -> Column:
    """TIMESTAMP_NTZ holding the UTC wall clock of a column's instants."""
    if isinstance(dtype, T.TimestampNTZType):
        return ts
    return F.to_utc_timestamp(ts, F.current_timezone()).cast("timestamp_ntz")
