"""Raw CSV cells -> typed records, with bad rows set aside by reason.

``parse_records`` keeps every input row and adds ``reject_reason`` (NULL for a
good row), so one scan feeds both the good stream and the dead-letter output;
``valid``/``rejects``/``reject_counts`` split or summarise it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gaugeline.functions.labels import parse_labels
from gaugeline.functions.values import is_strict_float
from gaugeline.schema import CORRUPT_COLUMN, LABELS_TYPE, MIN_CSV_CELLS, TELEMETRY_COLUMNS
from gaugeline.sources.csv import ARRIVAL, cell_count

# Reject reasons.
REJECT_COLUMN_COUNT = "column_count"
REJECT_VALUE = "invalid_value"
REJECT_TIME = "invalid_timestamp"

# Fixed value: accepted text of the source timestamp cell (RFC 3339).
SOURCE_TS_PATTERN = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]XXX"


def parse_records(raw: DataFrame, event_time: str = "ingest", keep: list[str] | None = None) -> DataFrame:
    """Type the 12 cells; add ``reject_reason``.

    event_time='ingest' stamps rows with the processing time (the source's
    behaviour, the CSV time cell is ignored); 'source' parses the cell instead, and
    rejects a row whose cell is no RFC 3339 time.
    Missing strings become '' (never NULL); an empty label cell gives a NULL
    map, any other label text a (possibly empty) map.  A row with fewer than 12
    cells is rejected, extra cells are ignored.
    """
    keep = list(keep or [])
    corrupt = F.col(CORRUPT_COLUMN) if CORRUPT_COLUMN in raw.columns else F.lit(None).cast("string")
    short = corrupt.isNotNull() & (cell_count(corrupt) < MIN_CSV_CELLS)
    value_txt = F.coalesce(F.col("value"), F.lit(""))
    reason = (F.when(short, F.lit(REJECT_COLUMN_COUNT))
              .when(~is_strict_float(value_txt), F.lit(REJECT_VALUE)))
    if event_time == "ingest":
        ts = F.current_timestamp()
    elif event_time == "source":
        ts = F.try_to_timestamp(F.col("timestamp"), F.lit(SOURCE_TS_PATTERN))
        reason = reason.when(ts.isNull(), F.lit(REJECT_TIME))
    else:
        raise ValueError("event_time must be 'ingest' or 'source'")
    labels_txt = F.col("labels")
    labels = F.when(labels_txt.isNull() | (labels_txt == ""), F.lit(None).cast(LABELS_TYPE)) \
        .otherwise(parse_labels(labels_txt))
    out = []
    for c in TELEMETRY_COLUMNS:
        if c == "timestamp":
            out.append(ts.alias(c))
        elif c == "value":
            out.append(F.when(reason.isNull(), value_txt.try_cast("double")).alias(c))
        elif c == "labels":
            out.append(labels.alias(c))
        else:
            out.append(F.coalesce(F.col(c), F.lit("")).alias(c))
    trace = [F.col(c) for c in ARRIVAL if c in raw.columns]
    return raw.select(*[F.col(k) for k in keep], *out, reason.alias("reject_reason"),
                      corrupt.alias("source_record"), *trace)


def valid(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reject_reason").isNull()).drop("reject_reason", "source_record", *ARRIVAL)


def rejects(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reject_reason").isNotNull())


def reject_counts(parsed: DataFrame) -> DataFrame:
    """F1 summary: rows per reason (partial aggregate, a handful of keys)."""
    return rejects(parsed).groupBy("reject_reason").agg(F.count(F.lit(1)).cast("long").alias("rows"))


def reject_rate(parsed: DataFrame) -> DataFrame:
    """Parse-error share over all rows (the documented error-rate metric)."""
    return parsed.agg(
        F.count(F.lit(1)).cast("long").alias("rows"),
        F.count("reject_reason").cast("long").alias("rejected"),
    ).withColumn("reject_rate", F.col("rejected") / F.greatest(F.col("rows"), F.lit(1)))
