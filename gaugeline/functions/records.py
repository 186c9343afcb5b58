"""Record <-> JSON text (one object per line in the NDJSON log form)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

from gaugeline.schema import OMIT_EMPTY, TELEMETRY_COLUMNS, TELEMETRY_SCHEMA

# Fixed value: timestamp text format (RFC 3339, microseconds, UTC 'Z').
JSON_TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
_UTC_TEXT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def utc_text(ts: Column, ntz: bool) -> Column:
    """RFC 3339 text in UTC whatever the session time zone (NTZ values hold UTC)."""
    if ntz:
        return F.date_format(ts, _UTC_TEXT)
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), _UTC_TEXT)


def record_to_json(prefix: str | None = None, ntz: bool = False, typed: bool = False) -> Column:
    """JSON object of the 12 record fields; empty optional fields are omitted.

    ``ntz``: the timestamp column is TIMESTAMP_NTZ (UTC wall clock).  ``typed``: the labels are a VARIANT.
    """
    fields = []
    for c in TELEMETRY_COLUMNS:
        col = F.col(f"{prefix}.{c}" if prefix else c)
        if c == "labels":
            col = F.when(~F.to_json(col).isin("{}", "null") if typed else F.size(col) > 0, col)
        elif c in OMIT_EMPTY:
            col = F.nullif(col, F.lit(""))
        elif c == "timestamp":
            col = utc_text(col, ntz)
        fields.append(col.alias(c))
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "true"})


def record_from_json(text, typed: bool = False) -> Column:
    """struct of the 12 record fields; absent optional strings become ''.  ``typed``: the labels are read as a VARIANT."""
    t = F.col(text) if isinstance(text, str) else text
    schema = T.StructType([T.StructField(f.name, T.VariantType()) if typed and f.name == "labels" else f for f in TELEMETRY_SCHEMA])
    s = F.from_json(t, schema, {"timestampFormat": JSON_TS_FORMAT})
    fields = []
    for f in TELEMETRY_SCHEMA.fields:
        v = s[f.name]
        if f.name in OMIT_EMPTY and f.name != "labels":
            v = F.coalesce(v, F.lit(""))
        fields.append(v.alias(f.name))
    return F.struct(*fields)
