"""Registered queries: name -> (spark callable, DuckDB oracle SQL or None).

Every query reads the driver tables under ``sf_dir`` (or data Spark derives
from them) in full.  Parameters are fixed here so the Spark side and the SQL
oracle compute the same thing; computed columns carry the same alias on both
sides.  Map columns are not compared directly: the label ``k`` is extracted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugeline.functions.timeparse import utc_wall_clock
from gaugeline.operators import partitioning, query
from gaugeline.schema import CSV_COLUMNS, DATE_COLUMN
from gaugeline.sources.adapters import events_as_telemetry

# Fixed parameters of the registered queries.
DEVICE = "GPU-8"
RANGE_START = "2024-01-06T00:38:38.318794Z"   # equal to an existing ts (inclusive bound)
RANGE_END = "2024-01-21T05:34:46.602205Z"     # equal to an existing ts (inclusive bound)
PAGE_SIZE = 25
AS_OF = "2024-01-15T00:00:00Z"
RECENT = "2 hours"
N_PARTITIONS = 3

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def flat(df: DataFrame) -> DataFrame:
    """Comparable output: the label map replaced by its ``k`` entry, and the
    table's TIMESTAMP shown as the driver tables' TIMESTAMP_NTZ (UTC)."""
    out = []
    for f in df.schema.fields:
        if f.name == DATE_COLUMN:
            continue   # a directory of the table, derived from the timestamp
        if f.name == "labels":
            out.append(F.col("labels")["k"].alias("label_k"))
        elif f.name == "timestamp":
            out.append(utc_wall_clock(F.col(f.name), f.dataType).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events seen as telemetry records (computed columns, no layout)."""
    return events_as_telemetry(spark, sf_dir)


def table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The telemetry table the service queries: the events persisted once per
    session (partition_id directories, files clustered on uuid/timestamp)."""
    from gaugeline.sources.table import read_table
    return read_table(spark, written_table(spark, sf_dir))


# ---------------------------------------------------------------- oracle pieces
_T = """(SELECT event_id AS id, ts AS "timestamp", event_type AS metric_name,
        CAST(user_id AS VARCHAR) AS gpu_id, '' AS device, concat('GPU-', user_id) AS uuid,
        '' AS model_name, '' AS hostname, '' AS container, '' AS pod, '' AS namespace,
        value, json_extract_string(props, '$.k') AS label_k FROM events)"""
_REC = """"timestamp", metric_name, gpu_id, device, uuid, model_name, hostname,
        container, pod, namespace, value, label_k"""
_RANGE = (f"\"timestamp\" >= TIMESTAMP '{RANGE_START[:-1].replace('T', ' ')}' "
          f"AND \"timestamp\" <= TIMESTAMP '{RANGE_END[:-1].replace('T', ' ')}'")
_PID = ("CAST(list_sum(list_transform(string_split(sha256(uuid), ''), lambda x: ascii(x))) "
        f"% {N_PARTITIONS} AS INTEGER)")


# ------------------------------------------------------------ gateway queries
@register("telemetry_scan", f"SELECT id, {_REC} FROM {_T} t")
def q_telemetry_scan(spark, sf_dir):
    """S4 + P9: the table scan with the 12 record columns (labels decoded)."""
    return flat(telemetry(spark, sf_dir))


@register("list_uuids", f"SELECT DISTINCT uuid FROM {_T} t ORDER BY uuid")
def q_list_uuids(spark, sf_dir):
    """A2 + L5."""
    return query.list_uuids(table(spark, sf_dir))


@register("telemetry_by_uuid",
          f"SELECT {_REC} FROM {_T} t WHERE uuid = '{DEVICE}' ORDER BY \"timestamp\", id LIMIT 100")
def q_telemetry_by_uuid(spark, sf_dir):
    """L6 (F3 + L1 + L2): page 1, default page size, of one device."""
    rows, _meta = query.telemetry_by_uuid(table(spark, sf_dir), DEVICE, n_partitions=N_PARTITIONS)
    return flat(rows)


@register("telemetry_time_range",
          f"SELECT {_REC} FROM {_T} t WHERE uuid = '{DEVICE}' AND {_RANGE} "
          f"ORDER BY \"timestamp\", id LIMIT 1000")
def q_telemetry_time_range(spark, sf_dir):
    """F4 + F5: inclusive bounds, both equal to stored timestamps."""
    rows, _ = query.telemetry_by_uuid(table(spark, sf_dir), DEVICE, RANGE_START, RANGE_END,
                                      page=1, page_size=1000, n_partitions=N_PARTITIONS)
    return flat(rows)


CURSOR_ID = 1722   # with RANGE_START: the order key of an existing record of the device


@register("telemetry_after",
          f"SELECT {_REC} FROM {_T} t WHERE uuid = '{DEVICE}' AND "
          f"(\"timestamp\" > TIMESTAMP '{RANGE_START[:-1].replace('T', ' ')}' OR "
          f"(\"timestamp\" = TIMESTAMP '{RANGE_START[:-1].replace('T', ' ')}' AND id > {CURSOR_ID})) "
          f"ORDER BY \"timestamp\", id LIMIT {PAGE_SIZE}")
def q_telemetry_after(spark, sf_dir):
    """L2 by keyset: the page after a (timestamp, id) cursor, one page of work at any depth."""
    from gaugeline.functions.timeparse import parse_rfc3339
    rows = query.records_after(table(spark, sf_dir), DEVICE, (parse_rfc3339(RANGE_START), CURSOR_ID),
                               PAGE_SIZE, n_partitions=N_PARTITIONS)
    return flat(rows.select(*[c for c in query.TELEMETRY_COLUMNS if c in rows.columns]))


@register("telemetry_page",
          f"SELECT {_REC} FROM {_T} t WHERE uuid = '{DEVICE}' ORDER BY \"timestamp\", id "
          f"LIMIT {PAGE_SIZE} OFFSET {PAGE_SIZE}")
def q_telemetry_page(spark, sf_dir):
    """L2: page 2 of size 25."""
    rows, _ = query.telemetry_by_uuid(table(spark, sf_dir), DEVICE, page=2, page_size=PAGE_SIZE,
                                      n_partitions=N_PARTITIONS)
    return flat(rows)


@register("count_by_uuid", f"SELECT count(*) AS total FROM {_T} t WHERE uuid = '{DEVICE}'")
def q_count_by_uuid(spark, sf_dir):
    """A1."""
    return query.count_records(table(spark, sf_dir), DEVICE, n_partitions=N_PARTITIONS)


@register("count_time_range",
          f"SELECT count(*) AS total FROM {_T} t WHERE uuid = '{DEVICE}' AND {_RANGE}")
def q_count_time_range(spark, sf_dir):
    """A1 with F4 + F5."""
    return query.count_records(table(spark, sf_dir), DEVICE, RANGE_START, RANGE_END,
                               n_partitions=N_PARTITIONS)


@register("page_meta",
          f"SELECT 1 AS page, {PAGE_SIZE} AS page_size, count(*) AS total, "
          f"greatest(CAST(ceil(count(*) / {PAGE_SIZE}.0) AS BIGINT), 1) AS total_pages, "
          f"count(*) > 0 AS found FROM {_T} t WHERE uuid = '{DEVICE}'")
def q_page_meta(spark, sf_dir):
    """A4 + A1: pagination of the device query."""
    _, meta = query.telemetry_by_uuid(table(spark, sf_dir), DEVICE, page=1, page_size=PAGE_SIZE,
                                      n_partitions=N_PARTITIONS)
    return meta


@register("page_meta_all",
          f"SELECT uuid, {PAGE_SIZE} AS page_size, count(*) AS total, "
          f"greatest(CAST(ceil(count(*) / {PAGE_SIZE}.0) AS BIGINT), 1) AS total_pages "
          f"FROM {_T} t GROUP BY uuid")
def q_page_meta_all(spark, sf_dir):
    """A4 for every device."""
    return query.page_meta_all(table(spark, sf_dir), PAGE_SIZE)


@register("page_all",
          f"SELECT id, uuid, \"timestamp\", metric_name, value, rn, "
          f"CAST(floor((rn - 1) / {PAGE_SIZE}) + 1 AS BIGINT) AS page FROM "
          f"(SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY \"timestamp\", id) AS rn "
          f"FROM {_T} t) s")
def q_page_all(spark, sf_dir):
    """L3: every device's records numbered and paged (skew-safe numbering)."""
    t = table(spark, sf_dir).select("id", "uuid", "timestamp", "metric_name", "value")
    return flat(query.page_all(t, PAGE_SIZE).select("id", "uuid", "timestamp", "metric_name",
                                                    "value", "rn", "page"))


@register("recent_records",
          f"SELECT id, \"timestamp\", uuid, metric_name, value FROM {_T} t "
          f"WHERE \"timestamp\" >= TIMESTAMP '{AS_OF[:-1].replace('T', ' ')}' - INTERVAL {RECENT} "
          f"AND \"timestamp\" <= TIMESTAMP '{AS_OF[:-1].replace('T', ' ')}'")
def q_recent_records(spark, sf_dir):
    """ST9: the recent-records window, boundary inclusive, at a fixed as-of time."""
    t = table(spark, sf_dir).select("id", "timestamp", "uuid", "metric_name", "value", DATE_COLUMN)
    return flat(query.recent_records(t, AS_OF, RECENT))


# ------------------------------------------------------------ partitioning
@register("partition_assign", f"SELECT id, uuid, {_PID} AS partition_id FROM {_T} t")
def q_partition_assign(spark, sf_dir):
    """P8: partition of every record."""
    t = telemetry(spark, sf_dir).select("id", "uuid")
    return partitioning.with_partition(t, N_PARTITIONS)


@register("partition_balance",
          f"SELECT partition_id, count(*) AS records, count(DISTINCT uuid) AS devices FROM "
          f"(SELECT uuid, {_PID} AS partition_id FROM {_T} t) s GROUP BY partition_id")
def q_partition_balance(spark, sf_dir):
    """A5."""
    return partitioning.partition_balance(telemetry(spark, sf_dir).select("uuid"), N_PARTITIONS)


# ------------------------------------------------------------ parsing
def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")


def label_text_col():
    """Label text derived from each event, exercising every parser rule."""
    k = F.get_json_object(F.col("props"), "$.k")
    return F.concat(
        F.lit('k="'), k, F.lit('",type = '), F.col("event_type"),
        F.lit(', ,flag,note="x,y",empty=,=anon'),
        F.when(F.col("value") > 250, F.concat(F.lit(",k="), F.col("user_id").cast("string")))
        .otherwise(F.lit("")),
    )


_LABEL_TEXT_SQL = ("concat('k=\"', json_extract_string(props, '$.k'), '\",type = ', event_type, "
                   "', ,flag,note=\"x,y\",empty=,=anon', "
                   "CASE WHEN value > 250 THEN concat(',k=', user_id) ELSE '' END)")


@register("parse_labels", f"""
WITH t AS (SELECT event_id, {_LABEL_TEXT_SQL} AS txt FROM events),
p AS (SELECT event_id, unnest(string_split(txt, ',')) AS piece,
             unnest(generate_series(1, len(string_split(txt, ',')))) AS i FROM t),
q AS (SELECT event_id, i, trim(piece) AS piece FROM p),
r AS (SELECT event_id, i, trim(substr(piece, 1, instr(piece, '=') - 1)) AS label_key,
             trim(substr(piece, instr(piece, '=') + 1)) AS v
      FROM q WHERE piece <> '' AND instr(piece, '=') > 0),
s AS (SELECT event_id, label_key,
             CASE WHEN length(v) >= 2 AND starts_with(v, '"') AND ends_with(v, '"')
                  THEN substr(v, 2, length(v) - 2) ELSE v END AS label_value,
             row_number() OVER (PARTITION BY event_id, label_key ORDER BY i DESC) AS rk
      FROM r)
SELECT event_id, label_key, label_value FROM s WHERE rk = 1""")
def q_parse_labels(spark, sf_dir):
    """P4: label text -> map (split, trim, first '=', unquote, last key wins), exploded."""
    from gaugeline.functions.labels import parse_labels
    ev = _events(spark, sf_dir)
    m = ev.select("event_id", F.explode(parse_labels(label_text_col())).alias("label_key", "label_value"))
    return m


def _ts_text(c):
    return F.date_format(F.col(c), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def csv_line_col():
    """One CSV source line per event; some rows are made odd on purpose, by content:
    value < 2 -> only 5 cells; error with value in [2,4) -> 'invalid'; view with value in [2,5) -> '1e400' (overflow);
    value > 470 -> leading space; value in [6,9) -> a time cell that is no time; value in [10,12) -> a 13th cell, quoted, long
    and full of doubled quotes and commas; value in [12,14) -> a long blank label piece; value in [14,16) -> a line break
    inside the quoted label cell.  The device cell holds the event id: the line's number."""
    v = F.col("value")
    vtxt = (F.when((F.col("event_type") == "error") & (v >= 2) & (v < 4), F.lit("invalid"))
            .when((F.col("event_type") == "view") & (v >= 2) & (v < 5), F.lit("1e400"))
            .when(v > 470, F.concat(F.lit(" "), v.cast("string")))
            .otherwise(v.cast("string")))
    k = F.get_json_object(F.col("props"), "$.k")
    blank = F.when((v >= 12) & (v < 14), F.concat(F.lit(","), F.repeat(F.lit(" "), F.lit(2000)))).otherwise("")
    broken = F.when((v >= 14) & (v < 16), F.lit("\n")).otherwise("")
    labels = F.concat(F.lit('"k=""'), k, F.lit('"",'), broken, F.lit("type="), F.col("event_type"), blank, F.lit('"'))
    extra = F.when((v >= 10) & (v < 12), F.concat(F.lit(',"'), F.repeat(F.lit('x"",'), F.lit(1000)), F.lit('"'))).otherwise("")
    uid = F.col("user_id").cast("string")
    uuid = F.concat(F.lit("GPU-"), uid)
    time = F.when((v >= 6) & (v < 9), F.lit("2024-13-99T25:00:00Z")).otherwise(_ts_text("ts"))
    device = F.col("event_id").cast("string")
    full = F.concat(F.concat_ws(",", time, F.col("event_type"), uid, device, uuid,
                                F.lit(""), F.lit(""), F.lit(""), F.lit(""), F.lit(""), vtxt, labels), extra)
    short = F.concat_ws(",", time, F.col("event_type"), uid, device, uuid)
    return F.when(v < 2, short).otherwise(full)


_INGEST_REASONS = """WHEN value < 2 THEN 'column_count'
       WHEN event_type = 'error' AND value >= 2 AND value < 4 THEN 'invalid_value'
       WHEN event_type = 'view' AND value >= 2 AND value < 5 THEN 'invalid_value'
       WHEN value > 470 THEN 'invalid_value'"""
# why a row is rejected; with the processing time as event time the time cell doesn't matter
_REASON_INGEST_SQL = f"CASE {_INGEST_REASONS} END"
_REASON_SQL = f"CASE {_INGEST_REASONS} WHEN value >= 6 AND value < 9 THEN 'invalid_timestamp' END"


def parsed_events(spark, sf_dir):
    from gaugeline.operators.parse import parse_records
    from gaugeline.sources.csv import csv_lines
    lines = _events(spark, sf_dir).select("event_id", csv_line_col().alias("line"))
    return parse_records(csv_lines(lines, "line", keep=["event_id"]), event_time="source",
                         keep=["event_id"])


@register("parse_value", f"""
SELECT event_id, "timestamp", uuid, metric_name, gpu_id, value, label_k, label_type FROM (
  SELECT event_id, ts AS "timestamp", concat('GPU-', user_id) AS uuid, event_type AS metric_name,
         CAST(user_id AS VARCHAR) AS gpu_id, value,
         json_extract_string(props, '$.k') AS label_k, event_type AS label_type,
         {_REASON_SQL} AS reason
  FROM events) s WHERE reason IS NULL""")
def q_parse_value(spark, sf_dir):
    """P1 + P2 + F2: CSV text lines -> typed records; bad rows drop out of the good set."""
    from gaugeline.operators.parse import valid
    good = valid(parsed_events(spark, sf_dir))
    return good.select("event_id", utc_wall_clock(F.col("timestamp"), good.schema["timestamp"].dataType)
                       .alias("timestamp"),
                       "uuid", "metric_name", "gpu_id", "value",
                       F.col("labels")["k"].alias("label_k"), F.col("labels")["type"].alias("label_type"))


@register("parse_rejects", f"""
SELECT reason AS reject_reason, count(*) AS rows FROM (SELECT {_REASON_SQL} AS reason FROM events) s
WHERE reason IS NOT NULL GROUP BY reason""")
def q_parse_rejects(spark, sf_dir):
    """rejected rows per reason."""
    from gaugeline.operators.parse import reject_counts
    return reject_counts(parsed_events(spark, sf_dir))


@register("parse_reject_rate", f"""
SELECT count(*) AS rows, count(reason) AS rejected,
       count(reason) / greatest(count(*), 1) AS reject_rate
FROM (SELECT {_REASON_SQL} AS reason FROM events) s""")
def q_parse_reject_rate(spark, sf_dir):
    """F1 metric: share of rows rejected by the parser."""
    from gaugeline.operators.parse import reject_rate
    return reject_rate(parsed_events(spark, sf_dir))


@register("csv_scan", f"""
SELECT "timestamp", uuid, metric_name, value, label_k FROM (
  SELECT ts AS "timestamp", concat('GPU-', user_id) AS uuid, event_type AS metric_name, value,
         json_extract_string(props, '$.k') AS label_k, {_REASON_SQL} AS reason
  FROM events) s WHERE reason IS NULL""")
def q_csv_scan(spark, sf_dir):
    """S1: CSV files (header row, RFC 4180 quoting) written from the events, scanned and parsed."""
    from gaugeline.operators.parse import parse_records, valid
    from gaugeline.session import scratch_path
    from gaugeline.sources.csv import read_csv
    path = scratch_path(spark, "csv-scan")
    _write_csv(spark, sf_dir, path)
    good = valid(parse_records(read_csv(spark, path, multi_line="auto"), event_time="source"))
    return good.select(utc_wall_clock(F.col("timestamp"), good.schema["timestamp"].dataType)
                       .alias("timestamp"), "uuid",
                       "metric_name", "value", F.col("labels")["k"].alias("label_k"))


def _write_csv(spark, sf_dir, path, cond=None, files: int = 8):
    """A CSV drop folder of ``files`` files in event order, each with its header row, modified one after the other."""
    from gaugeline.operators.commits import file_system
    first = F.monotonically_increasing_id() % (1 << 33) == 0   # of a task, so of a file
    header = F.lit(",".join(CSV_COLUMNS))
    events = _events(spark, sf_dir)
    (events.where(F.lit(True) if cond is None else cond).select("event_id", csv_line_col().alias("line"))
     .repartitionByRange(files, "event_id").sortWithinPartitions("event_id")
     .select(F.explode(F.when(first, F.array(header, "line")).otherwise(F.array("line"))).alias("value"))
     .write.mode("append").text(path))
    fs, hpath = file_system(spark, f"{path}/part-*")
    found = sorted(fs.globStatus(hpath), key=lambda s: (s.getModificationTime() // 60_000, s.getPath().getName()))
    for k, s in enumerate(found):
        fs.setTimes(s.getPath(), s.getModificationTime() // 60_000 * 60_000 + k, -1)


@register("csv_rejects", f"""
SELECT reason AS reject_reason, count(*) AS rows FROM (SELECT {_REASON_SQL} AS reason FROM events) s
WHERE reason IS NOT NULL GROUP BY reason""")
def q_csv_rejects(spark, sf_dir):
    """F1 + F2 on files: rejected rows per reason, short and bad rows included."""
    from gaugeline.operators.parse import parse_records, reject_counts
    from gaugeline.session import scratch_path
    from gaugeline.sources.csv import read_csv
    path = scratch_path(spark, "csv-rejects")
    _write_csv(spark, sf_dir, path)
    return reject_counts(parse_records(read_csv(spark, path, multi_line="auto"), event_time="source"))


@register("labels_json", """
SELECT event_id AS id, '{"k":"' || json_extract_string(props, '$.k') || '"}' AS labels_json,
       json_extract_string(props, '$.k') AS label_k FROM events""")
def q_labels_json(spark, sf_dir):
    """P5 + P6: label map -> JSON text -> map."""
    from gaugeline.functions.labels import labels_from_json, labels_to_json
    t = telemetry(spark, sf_dir).select("id", labels_to_json(F.col("labels")).alias("labels_json"))
    return t.select("id", "labels_json", labels_from_json(F.col("labels_json"))["k"].alias("label_k"))


@register("record_json", """
SELECT event_id AS id,
  '{"timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') || '","metric_name":"' || event_type
  || '","gpu_id":"' || user_id || '","uuid":"GPU-' || user_id || '","value":' || CAST(value AS VARCHAR)
  || ',"labels":{"k":"' || json_extract_string(props, '$.k') || '"}}' AS record_json,
  concat('GPU-', user_id) AS uuid, value FROM events""")
def q_record_json(spark, sf_dir):
    """P7: record -> one JSON object (empty optional fields omitted) and back."""
    from gaugeline.functions.records import record_from_json, record_to_json
    t = telemetry(spark, sf_dir)
    j = t.select("id", record_to_json(ntz=True).alias("record_json"))
    back = j.select("id", "record_json", record_from_json("record_json").alias("r"))
    return back.select("id", "record_json", F.col("r.uuid").alias("uuid"), F.col("r.value").alias("value"))


# ------------------------------------------------------------ the record log
SPLIT_TS = "2024-01-15 00:00:00"       # the events are appended as two batches
POSITIONS = {"g1": {1: 3000, 2: 5000}, "g2": {0: 2900, 1: 10}}   # stored group positions
MAX_RECORDS = 100
_LOGS: dict[tuple[str, str], str] = {}

_LOG_SQL = f"""(SELECT partition_id, row_number() OVER (PARTITION BY partition_id ORDER BY "timestamp", id) - 1
         AS "offset", id, uuid, "timestamp", metric_name, value
       FROM (SELECT *, {_PID} AS partition_id FROM {_T} t) s)"""


def _log_events(spark, sf_dir):
    return telemetry(spark, sf_dir)


def written_log(spark: SparkSession, sf_dir: str) -> str:
    """The events appended to a log in two batches (once per session and input)."""
    from gaugeline.operators.log import append_log
    from gaugeline.session import scratch_path
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _LOGS:
        path = scratch_path(spark, "log")
        ev = _log_events(spark, sf_dir)
        split = F.lit(SPLIT_TS).cast("timestamp_ntz")
        order = ["timestamp", "id"]
        append_log(ev.where(F.col("timestamp") < split), path, N_PARTITIONS, order).collect()
        append_log(ev.where(F.col("timestamp") >= split), path, N_PARTITIONS, order).collect()
        _LOGS[key] = path
    return _LOGS[key]


def _log_out(df, *extra):
    return df.select(*extra, "partition_id", "offset", "uuid",
                     utc_wall_clock(F.col("timestamp"), df.schema["timestamp"].dataType).alias("timestamp"),
                     "metric_name", "value")


@register("log_offsets", f"SELECT partition_id, \"offset\", id FROM {_LOG_SQL} l")
def q_log_offsets(spark, sf_dir):
    """ST1: hash partition + dense offsets in arrival (time) order, skew-safe numbering."""
    from gaugeline.operators.log import assign_offsets
    t = telemetry(spark, sf_dir).select("id", "uuid", "timestamp")
    return assign_offsets(t, N_PARTITIONS, ["timestamp", "id"]).select("partition_id", "offset", "id")


@register("append_report", f"""
SELECT partition_id, count(*) FILTER (WHERE "timestamp" >= TIMESTAMP '{SPLIT_TS}') AS records,
       count(*) AS next_offset FROM {_LOG_SQL} l GROUP BY partition_id""")
def q_append_report(spark, sf_dir):
    """K1 + K2 + A6: second append continues each partition's offsets; its report."""
    from gaugeline.operators.log import append_log
    from gaugeline.session import scratch_path
    path = scratch_path(spark, "log-report")
    ev = _log_events(spark, sf_dir)
    split = F.lit(SPLIT_TS).cast("timestamp_ntz")
    append_log(ev.where(F.col("timestamp") < split), path, N_PARTITIONS, ["timestamp", "id"]).collect()
    return append_log(ev.where(F.col("timestamp") >= split), path, N_PARTITIONS, ["timestamp", "id"])


@register("append_responses", f"""
SELECT id, partition_id, true AS success, n AS "offset" FROM (
  SELECT id, "timestamp", partition_id, count(*) OVER (PARTITION BY partition_id) AS n
  FROM (SELECT *, {_PID} AS partition_id FROM {_T} t) s) x
WHERE "timestamp" >= TIMESTAMP '{SPLIT_TS}'""")
def q_append_responses(spark, sf_dir):
    """K2 per record: success and the partition's next offset for every record of the second append."""
    from gaugeline.operators.log import append_log, produce_responses
    from gaugeline.session import scratch_path
    path = scratch_path(spark, "log-responses")
    ev = _log_events(spark, sf_dir).select("id", "uuid", "timestamp", "metric_name", "gpu_id", "device",
                                           "model_name", "hostname", "container", "pod", "namespace",
                                           "value", "labels")
    split = F.lit(SPLIT_TS).cast("timestamp_ntz")
    append_log(ev.where(F.col("timestamp") < split), path, N_PARTITIONS, ["timestamp", "id"]).collect()
    second = ev.where(F.col("timestamp") >= split)
    report = append_log(second, path, N_PARTITIONS, ["timestamp", "id"])
    return produce_responses(second, report, N_PARTITIONS).select("id", "partition_id", "success", "offset")


@register("log_scan", f"SELECT partition_id, \"offset\", uuid, \"timestamp\", metric_name, value FROM {_LOG_SQL} l")
def q_log_scan(spark, sf_dir):
    """S3: the written log read back (records + partition + offset)."""
    from gaugeline.sources.log import read_log
    return _log_out(read_log(spark, written_log(spark, sf_dir)))


@register("end_offsets", f"SELECT partition_id, count(*) AS next_offset FROM {_LOG_SQL} l GROUP BY partition_id")
def q_end_offsets(spark, sf_dir):
    """A6: next write position of every partition."""
    from gaugeline.operators.log import end_offsets
    from gaugeline.sources.log import read_log
    return end_offsets(read_log(spark, written_log(spark, sf_dir)), N_PARTITIONS)


@register("consume_offset", f"""
SELECT partition_id, "offset", uuid, "timestamp", metric_name, value FROM {_LOG_SQL} l
WHERE partition_id = 1 AND "offset" >= 100 ORDER BY "offset" LIMIT 50""")
def q_consume_offset(spark, sf_dir):
    """ST2 + L4: 50 records of partition 1 from offset 100."""
    from gaugeline.operators.log import consume
    from gaugeline.sources.log import read_log
    return _log_out(consume(read_log(spark, written_log(spark, sf_dir)), 1, 100, 50))


def _positions_sql(groups):
    rows = [f"('{g}', {p}, {o})" for g in groups for p, o in POSITIONS[g].items()]
    return f"(SELECT * FROM (VALUES {', '.join(rows)}) v(grp, partition_id, next_offset))"


def _group_sql(groups):
    names = ", ".join(f"('{g}')" for g in groups)
    return f"""(SELECT g.grp, p.partition_id, coalesce(pos.next_offset, 0) AS start_offset
    FROM (VALUES {names}) g(grp), (SELECT range AS partition_id FROM range({N_PARTITIONS})) p
    LEFT JOIN {_positions_sql(groups)} pos ON pos.grp = g.grp AND pos.partition_id = p.partition_id)"""


def _consume_sql(groups):
    return f"""
SELECT s.grp AS "group", l.partition_id, l."offset", l.uuid, l."timestamp", l.metric_name, l.value
FROM {_LOG_SQL} l JOIN {_group_sql(groups)} s ON l.partition_id = s.partition_id
WHERE l."offset" >= s.start_offset AND l."offset" < s.start_offset + {MAX_RECORDS}"""


@register("consume_group", _consume_sql(["g1"]))
def q_consume_group(spark, sf_dir):
    """ST3 + U1: one group reads every partition from its stored position (0 if none)."""
    from gaugeline.operators.log import consume_groups
    from gaugeline.sources.log import read_log
    log = read_log(spark, written_log(spark, sf_dir))
    out = consume_groups(log, {"g1": POSITIONS["g1"]}, ["g1"], MAX_RECORDS, N_PARTITIONS)
    return _log_out(out, "group")


@register("consume_two_groups", _consume_sql(["g1", "g2"]))
def q_consume_two_groups(spark, sf_dir):
    """ST5: two groups with independent positions over the same log."""
    from gaugeline.operators.log import consume_groups
    from gaugeline.sources.log import read_log
    log = read_log(spark, written_log(spark, sf_dir))
    out = consume_groups(log, POSITIONS, ["g1", "g2"], MAX_RECORDS, N_PARTITIONS)
    return _log_out(out, "group")


@register("consume_status", f"""
WITH e AS (SELECT partition_id, count(*) AS end_offset FROM {_LOG_SQL} l GROUP BY partition_id),
s AS (SELECT s.grp, s.partition_id, s.start_offset, coalesce(e.end_offset, 0) AS end_offset
      FROM {_group_sql(["g1", "g2"])} s LEFT JOIN e ON e.partition_id = s.partition_id)
SELECT grp AS "group", partition_id, start_offset,
       CAST(greatest(least(start_offset + {MAX_RECORDS}, end_offset) - start_offset, 0) AS BIGINT) AS records,
       CAST(start_offset + greatest(least(start_offset + {MAX_RECORDS}, end_offset) - start_offset, 0) AS BIGINT)
         AS next_offset,
       start_offset + greatest(least(start_offset + {MAX_RECORDS}, end_offset) - start_offset, 0) < end_offset
         AS has_more
FROM s""")
def q_consume_status(spark, sf_dir):
    """ST4 + ST6: records read, new position and has_more per group and partition."""
    from gaugeline.operators.log import consume_status, end_offsets
    from gaugeline.sources.log import read_log
    ends = end_offsets(read_log(spark, written_log(spark, sf_dir)), N_PARTITIONS)
    return consume_status(ends, POSITIONS, ["g1", "g2"], MAX_RECORDS, N_PARTITIONS)


# ------------------------------------------------------------ table writes
_TABLES: dict[tuple[str, str], str] = {}


def written_table(spark: SparkSession, sf_dir: str) -> str:
    """The events persisted as the telemetry table (once per session and input)."""
    from gaugeline.operators.table import persist
    from gaugeline.session import scratch_path
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _TABLES:
        path = scratch_path(spark, "table")
        persist(telemetry(spark, sf_dir), path, N_PARTITIONS, mode="overwrite")
        _TABLES[key] = path
    return _TABLES[key]


@register("table_scan", f"SELECT id, {_REC}, {_PID} AS partition_id FROM {_T} t")
def q_table_scan(spark, sf_dir):
    """K3 + S5 + S4: records persisted (partitioned, clustered) and scanned back."""
    from gaugeline.sources.table import read_table
    t = read_table(spark, written_table(spark, sf_dir))
    return flat(t)


@register("table_device_page",
          f"SELECT {_REC} FROM {_T} t WHERE uuid = '{DEVICE}' AND {_RANGE} "
          f"ORDER BY \"timestamp\", id LIMIT {PAGE_SIZE} OFFSET {PAGE_SIZE}")
def q_table_device_page(spark, sf_dir):
    """L6 on the persisted table: partition directory pruned, uuid/time pushed to the scan."""
    from gaugeline.sources.table import read_table
    t = read_table(spark, written_table(spark, sf_dir))
    rows, _ = query.telemetry_by_uuid(t, DEVICE, RANGE_START, RANGE_END, page=2,
                                      page_size=PAGE_SIZE, n_partitions=N_PARTITIONS)
    return flat(rows)


@register("insert_if_absent", f"""
SELECT id, uuid, "timestamp", value FROM {_T} t WHERE "timestamp" >= TIMESTAMP '2024-01-25 00:00:00'""")
def q_insert_if_absent(spark, sf_dir):
    """K4: a batch with repeated rows against a table already holding part of it."""
    from gaugeline.operators.table import insert_if_absent
    t = telemetry(spark, sf_dir).select("id", "uuid", "timestamp", "value")
    ts = F.col("timestamp")
    existing = t.where(ts < F.lit("2024-01-25 00:00:00").cast("timestamp_ntz"))
    new = (t.where(ts >= F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))
           .unionByName(t.where(ts >= F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))))
    return insert_if_absent(new, existing, ["id"])


@register("persist_table", f"SELECT id, {_REC}, {_PID} AS partition_id FROM {_T} t")
def q_persist_table(spark, sf_dir):
    """K3 + S5: the write itself, into a new table each time, and its scan."""
    from gaugeline.operators.table import persist
    from gaugeline.session import scratch_path
    from gaugeline.sources.table import read_table
    path = scratch_path(spark, "persist-table")
    persist(telemetry(spark, sf_dir), path, N_PARTITIONS)
    return flat(read_table(spark, path))


@register("not_null_rejects", """
SELECT event_id AS id, CASE WHEN event_type = 'error' AND value < 50 THEN 'null_uuid' ELSE 'null_value' END AS violation
FROM events WHERE (event_type = 'error' AND value < 50) OR value > 250""")
def q_not_null_rejects(spark, sf_dir):
    """S5: rows that break NOT NULL are set aside with the violation when a table is written."""
    from gaugeline.operators.table import persist
    from gaugeline.session import scratch_path
    path = scratch_path(spark, "not-null")
    t = telemetry(spark, sf_dir)
    broken = t.withColumns({"uuid": F.when((F.col("metric_name") == "error") & (F.col("value") < 50), None).otherwise(F.col("uuid")),
                            "value": F.when(F.col("value") > 250, None).otherwise(F.col("value"))})
    persist(broken, f"{path}/table", N_PARTITIONS, rejects_path=f"{path}/rejects")
    return spark.read.parquet(f"{path}/rejects").select("id", "violation")


# ------------------------------------------------------------ streaming
def _arrival_sql(reason: str, slices: str = "0"):
    """The log of a streamed ingest: offsets in arrival order, which is slice by slice the line order."""
    return f"""
SELECT partition_id, row_number() OVER (PARTITION BY partition_id ORDER BY slice, event_id) - 1 AS "offset",
       uuid, "timestamp", metric_name, value, CAST(event_id AS VARCHAR) AS device FROM (
  SELECT event_id, ts AS "timestamp", concat('GPU-', user_id) AS uuid, event_type AS metric_name, value, {slices} AS slice,
         {_PID.replace('sha256(uuid)', "sha256(concat('GPU-', user_id))")} AS partition_id, {reason} AS reason
  FROM events) s WHERE reason IS NULL"""


_STREAM_COLUMNS = ["partition_id", "offset", "uuid", "metric_name", "value", "device"]
_SLICE_SQL = f"CASE WHEN ts < TIMESTAMP '{SPLIT_TS}' THEN 0 ELSE 1 END"


@register("stream_ingest", f"SELECT {', '.join(_STREAM_COLUMNS).replace('offset', chr(34) + 'offset' + chr(34))} FROM ({_arrival_sql(_REASON_INGEST_SQL)}) l")
def q_stream_ingest(spark, sf_dir):
    """S2 + ST7 + ST10 + K1 + ST1: CSV folder -> stream -> parse -> log (availableNow drain); stamped with the processing
    time, so offsets follow the line order alone."""
    from gaugeline.session import scratch_path
    from gaugeline.sources.log import read_log
    from gaugeline.streaming.ingest import ingest_stream
    base = scratch_path(spark, "stream-ingest")
    _write_csv(spark, sf_dir, f"{base}/csv")
    ingest_stream(spark, f"{base}/csv", f"{base}/log", f"{base}/ckpt", N_PARTITIONS,
                  event_time="ingest", trigger="availableNow").awaitTermination()
    return read_log(spark, f"{base}/log").select(*_STREAM_COLUMNS)


@register("stream_rejects", f"""
SELECT reason AS reject_reason, count(*) AS rows FROM (SELECT {_REASON_SQL} AS reason FROM events) s
WHERE reason IS NOT NULL GROUP BY reason""")
def q_stream_rejects(spark, sf_dir):
    """F1 + F2 in a stream: the dead-letter folder's rows per reason."""
    from gaugeline.session import scratch_path
    from gaugeline.streaming.ingest import ingest_stream
    base = scratch_path(spark, "stream-rejects")
    _write_csv(spark, sf_dir, f"{base}/csv")
    ingest_stream(spark, f"{base}/csv", f"{base}/log", f"{base}/ckpt", N_PARTITIONS, event_time="source",
                  trigger="availableNow", rejects_path=f"{base}/rejects").awaitTermination()
    return (spark.read.parquet(f"{base}/rejects").groupBy("reject_reason")
            .agg(F.count(F.lit(1)).cast("long").alias("rows")))


@register("stream_resume", _arrival_sql(_REASON_SQL, _SLICE_SQL))
def q_stream_resume(spark, sf_dir):
    """ST8 + ST5 + K3: ingest restarted on the same checkpoint after new files
    arrive; a consumer group restarted likewise persists the log to the table."""
    from gaugeline.session import scratch_path
    from gaugeline.sources.table import read_table
    from gaugeline.streaming.consume import consume_stream
    from gaugeline.streaming.ingest import ingest_stream
    base = scratch_path(spark, "stream-resume")
    csv, log, table = f"{base}/csv", f"{base}/log", f"{base}/table"
    split = F.col("ts") < F.lit(SPLIT_TS).cast("timestamp_ntz")
    _write_csv(spark, sf_dir, csv, split)
    for _run in range(2):
        ingest_stream(spark, csv, log, f"{base}/ingest-ckpt", N_PARTITIONS, event_time="source",
                      trigger="availableNow").awaitTermination()
        consume_stream(spark, log, "g2", table, f"{base}/groups", N_PARTITIONS,
                       trigger="availableNow").awaitTermination()
        if _run == 0:
            _write_csv(spark, sf_dir, csv, ~split)
    return _log_out(read_table(spark, table), "device")


@register("stream_two_sources", _arrival_sql(_REASON_SQL, _SLICE_SQL))
def q_stream_two_sources(spark, sf_dir):
    """S2 + K1: two folders with a checkpoint each fill one log; both streams count their batches from 0."""
    from gaugeline.session import scratch_path
    from gaugeline.sources.log import read_log
    from gaugeline.streaming.ingest import ingest_stream
    base = scratch_path(spark, "stream-two")
    split = F.col("ts") < F.lit(SPLIT_TS).cast("timestamp_ntz")
    for name, cond in (("a", split), ("b", ~split)):
        _write_csv(spark, sf_dir, f"{base}/{name}", cond)
        ingest_stream(spark, f"{base}/{name}", f"{base}/log", f"{base}/ckpt-{name}", N_PARTITIONS, event_time="source",
                      trigger="availableNow").awaitTermination()
    return _log_out(read_log(spark, f"{base}/log"), "device")


@register("append_replay_partial", f"SELECT partition_id, \"offset\", uuid, \"timestamp\", metric_name, value FROM {_LOG_SQL} l")
def q_append_replay_partial(spark, sf_dir):
    """K1 + ST8: one partition's files of a micro-batch landed, then the writer died; the replay makes the batch whole."""
    from gaugeline.operators import log as logs
    from gaugeline.session import scratch_path
    from gaugeline.sources.log import read_log
    path, order = scratch_path(spark, "log-partial"), ["timestamp", "id"]
    ev = _log_events(spark, sf_dir)
    early = F.col("timestamp") < F.lit(SPLIT_TS).cast("timestamp_ntz")
    logs.append_log(ev.where(early), path, N_PARTITIONS, order, batch=0, stream="s")
    base = logs.end_offsets(read_log(spark, path), N_PARTITIONS)
    landed = logs.to_log_rows(logs.assign_offsets(ev.where(~early), N_PARTITIONS, order, base), 1).where("partition_id = 1")
    landed.write.mode("append").partitionBy("partition_id").parquet(path)
    logs._WRITTEN.pop((spark.sparkContext.applicationId, path), None)   # a new process
    for _ in range(2):   # the second replay finds the batch committed
        logs.append_log(ev.where(~early), path, N_PARTITIONS, order, batch=1, stream="s")
    return _log_out(read_log(spark, path))


@register("collect_loop", f"SELECT partition_id, \"offset\", uuid, \"timestamp\", metric_name, value FROM {_LOG_SQL} l")
def q_collect_loop(spark, sf_dir):
    """ST3 + ST4 + ST6 + K3: poll, persist, commit until nothing is left, stopped and started again in the middle."""
    from gaugeline.operators.log import log_state
    from gaugeline.session import scratch_path
    from gaugeline.sources.table import read_table
    from gaugeline.streaming.collect import collect_loop
    base, log = scratch_path(spark, "collect"), written_log(spark, sf_dir)
    third = max(log_state(spark, log, N_PARTITIONS)[0].values()) // 3 + 1
    for most in (2, None):
        collect_loop(spark, log, f"{base}/table", f"{base}/positions", "g1", third, N_PARTITIONS, max_polls=most)
    return _log_out(read_table(spark, f"{base}/table"))


@register("log_json_scan", f"SELECT partition_id, \"offset\", uuid, \"timestamp\", metric_name, value FROM {_LOG_SQL} l")
def q_log_json_scan(spark, sf_dir):
    """S3 + P7: the log exported as NDJSON (one record object per line) and read back."""
    from gaugeline.operators.log import export_log_json
    from gaugeline.session import scratch_path
    from gaugeline.sources.log import read_log
    path = scratch_path(spark, "log-json")
    export_log_json(read_log(spark, written_log(spark, sf_dir)), path)
    return _log_out(read_log(spark, path, fmt="json"))


@register("ingest_time", f"""
SELECT event_id, uuid, metric_name, value, true AS stamped_after_source FROM (
  SELECT event_id, concat('GPU-', user_id) AS uuid, event_type AS metric_name, value, {_REASON_INGEST_SQL} AS reason
  FROM events) s WHERE reason IS NULL""")
def q_ingest_time(spark, sf_dir):
    """P3: records stamped with the processing time (the CSV time cell is ignored)."""
    from gaugeline.operators.parse import parse_records, valid
    from gaugeline.sources.csv import csv_lines
    lines = _events(spark, sf_dir).select("event_id", "ts", csv_line_col().alias("line"))
    good = valid(parse_records(csv_lines(lines, "line", keep=["event_id", "ts"]), event_time="ingest",
                               keep=["event_id", "ts"]))
    return good.select("event_id", "uuid", "metric_name", "value",
                       (F.col("timestamp") > F.col("ts").cast("timestamp")).alias("stamped_after_source"))


# ------------------------------------------------------------ typed labels
def typed_label_text():
    """Label JSON of many types, derived from each event; some texts are bad, no object, or missing."""
    k, v = F.get_json_object(F.col("props"), "$.k"), F.col("value")
    kind = F.col("event_id") % 7
    good = F.concat(F.lit('{"b": '), F.when(v > 250, "true").otherwise("false"), F.lit(', "k": '), k, F.lit(', "o": {"type": "'), F.col("event_type"),
                    F.lit('", "u": ['), F.col("user_id").cast("string"), F.lit(', null, "x"]}, "s": "'), k, F.lit('"}'))
    return (F.when(kind == 0, F.lit('{"k": 1')).when(kind == 1, F.lit("[1, 2]")).when(kind == 2, F.lit(None).cast("string")).otherwise(good))


@register("labels_typed", """
WITH e AS (SELECT event_id, event_id % 7 AS kind, json_extract_string(props, '$.k') AS k, value > 250 AS b, event_type AS t, user_id AS u FROM events)
SELECT event_id AS id, CASE WHEN kind < 2 THEN '{}' WHEN kind = 2 THEN NULL ELSE
       '{"b":' || CAST(b AS VARCHAR) || ',"k":' || k || ',"o":{"type":"' || t || '","u":[' || u || ',null,"x"]},"s":"' || k || '"}' END AS labels_json,
       CASE WHEN kind > 2 THEN CAST(k AS BIGINT) END AS label_k, CASE WHEN kind > 2 THEN b END AS label_b, CASE WHEN kind > 2 THEN u END AS label_u FROM e""")
def q_labels_typed(spark, sf_dir):
    """P5 + P6 + S4 + K3: label JSON of every type decoded, persisted as VARIANT, read back and encoded."""
    from gaugeline.functions.labels import typed_label, typed_labels
    from gaugeline.operators.table import persist
    from gaugeline.session import scratch_path
    from gaugeline.sources.table import read_table
    path = scratch_path(spark, "typed-table")
    texts = _events(spark, sf_dir).select(F.col("event_id").alias("id"), typed_labels(typed_label_text()).alias("labels"))
    persist(events_as_telemetry(spark, sf_dir, with_labels=False).join(texts, "id"), path, N_PARTITIONS)
    t = read_table(spark, path, typed=True)
    return t.select("id", F.to_json("labels").alias("labels_json"), typed_label("labels", "k", "long").alias("label_k"),
                    typed_label("labels", "b", "boolean").alias("label_b"), F.try_variant_get("labels", F.lit("$.o.u[0]"), "long").alias("label_u"))


# ------------------------------------------------------------ rollup
_ROLLUPS: dict[tuple[str, str], str] = {}


def written_rollup(spark: SparkSession, sf_dir: str) -> str:
    """The rollup of the events, added in two batches, the second one twice (once per session and input)."""
    from gaugeline.operators.rollup import add_to_rollup
    from gaugeline.session import scratch_path
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _ROLLUPS:
        path = scratch_path(spark, "rollup")
        ev = telemetry(spark, sf_dir).select("uuid", "timestamp")
        early = F.col("timestamp") < F.lit(SPLIT_TS).cast("timestamp_ntz")
        for batch, cond in ((0, early), (1, ~early), (1, ~early)):
            add_to_rollup(ev.where(cond), path, batch, "s", N_PARTITIONS)
        _ROLLUPS[key] = path
    return _ROLLUPS[key]


@register("count_rollup", f"SELECT count(*) AS total FROM {_T} t WHERE uuid = '{DEVICE}' AND {_RANGE}")
def q_count_rollup(spark, sf_dir):
    """A1 from the rollup: whole days by their counts, the two days at the ends by their records."""
    from gaugeline.operators.rollup import count_by_rollup, read_rollup
    return count_by_rollup(table(spark, sf_dir), read_rollup(spark, written_rollup(spark, sf_dir)), DEVICE, RANGE_START, RANGE_END, N_PARTITIONS)


@register("page_rollup",
          f"SELECT {_REC} FROM {_T} t WHERE uuid = '{DEVICE}' AND {_RANGE} ORDER BY \"timestamp\", id LIMIT 3 OFFSET 9")
def q_page_rollup(spark, sf_dir):
    """L2 + L6 by the rollup: the page's day is found by a running sum over days, only its days are read."""
    from gaugeline.operators.rollup import page_by_rollup, read_rollup
    rows, _ = page_by_rollup(table(spark, sf_dir), read_rollup(spark, written_rollup(spark, sf_dir)), DEVICE, 4, 3, RANGE_START, RANGE_END, N_PARTITIONS)
    return flat(rows.select(*[c for c in query.TELEMETRY_COLUMNS if c in rows.columns]))


@register("compact_latest", f"""
SELECT partition_id, "offset", uuid, "timestamp", metric_name, value FROM (
  SELECT *, row_number() OVER (PARTITION BY uuid, metric_name, "timestamp" ORDER BY "offset" DESC) AS rk FROM (
    SELECT partition_id, "offset", uuid, date_trunc('day', "timestamp") AS "timestamp", metric_name, value FROM {_LOG_SQL} l) s) r WHERE rk = 1""")
def q_compact_latest(spark, sf_dir):
    """2.11 compaction: the last record of every (device, metric, time), times cut to days so that keys repeat."""
    from gaugeline.operators.rollup import latest_per_key
    from gaugeline.session import scratch_path
    from gaugeline.sources.log import read_log
    log = read_log(spark, written_log(spark, sf_dir))
    path = scratch_path(spark, "compacted")
    latest_per_key(log.withColumn("timestamp", F.date_trunc("day", "timestamp")).drop("labels")).write.partitionBy("partition_id").parquet(path)
    return _log_out(spark.read.parquet(path))


# ------------------------------------------------------------ skew by sketches, devices in the log
FIRST_DAY, LAST_DAY = "2024-01-05", "2024-01-20"


@register("skew_sketches", f"""
SELECT partition_id, CAST(sum(n) AS BIGINT) AS records, count(*) AS devices, max(n) AS hot_records, TRUE AS records_equal, TRUE AS devices_within,
       TRUE AS hot_within
FROM (SELECT {_PID} AS partition_id, uuid, count(*) AS n FROM {_T} t
      WHERE CAST("timestamp" AS DATE) BETWEEN DATE '{FIRST_DAY}' AND DATE '{LAST_DAY}' GROUP BY 1, 2) d GROUP BY partition_id""")
def q_skew_sketches(spark, sf_dir):
    """A5 / 2.11: skew of a range of days by stored sketches, held against the exact form (device counts within four standard
    errors, the hottest device's records within the sketch's bound; where no device stands out, that is from 0)."""
    from gaugeline.operators import sketches
    from gaugeline.session import scratch_path
    ev = telemetry(spark, sf_dir).select("uuid", "timestamp")
    path = scratch_path(spark, "sketches")
    early = F.col("timestamp") < F.lit(SPLIT_TS).cast("timestamp_ntz")
    for batch, cond in ((0, early), (1, ~early), (1, ~early)):   # the last batch twice, as after a restart
        sketches.add_sketches(ev.where(cond), path, batch, "s", N_PARTITIONS)
    seen = sketches.partition_skew(sketches.read_sketches(spark, path), FIRST_DAY, LAST_DAY, top=1).select(
        "partition_id", F.col("records").alias("_n"), F.col("devices").alias("_devices"), F.coalesce(F.get("hot", F.lit(0))["records"], F.lit(0)).alias("_hot"))
    exact = sketches.exact_skew(ev, FIRST_DAY, LAST_DAY, N_PARTITIONS)
    within = lambda a, b, err: F.abs(F.col(a) - F.col(b)) <= err
    return exact.join(seen, "partition_id", "left").select(
        "partition_id", "records", "devices", "hot_records", (F.col("_n") == F.col("records")).alias("records_equal"),
        within("_devices", "devices", 4 * sketches.device_error() * F.col("devices")).alias("devices_within"),
        within("_hot", "hot_records", sketches.hot_error() * F.col("records")).alias("hot_within"))


@register("log_device", f"SELECT partition_id, \"offset\", uuid, \"timestamp\", metric_name, value FROM {_LOG_SQL} l WHERE uuid = '{DEVICE}'")
def q_log_device(spark, sf_dir):
    """F3 on the log: one device's records, its files' device filters skip row groups."""
    from gaugeline.operators.log import device_log
    from gaugeline.sources.log import read_log
    return _log_out(device_log(read_log(spark, written_log(spark, sf_dir)), DEVICE, N_PARTITIONS))


# ------------------------------------------------------------ device metadata
def _with_models(df: DataFrame) -> DataFrame:
    """Models that change with the weeks, hosts that change with the readings."""
    u = F.col("gpu_id").cast("int")
    return df.withColumns({"model_name": F.concat(F.lit("M"), (F.dayofmonth("timestamp") / 10).cast("int").cast("string"), F.lit("-"), (u % 3).cast("string")),
                           "hostname": F.when((u % 2 == 0) & (F.col("value") > 50), "big").otherwise("small")})


_META_SQL = f"""o AS (SELECT uuid, "timestamp" AS valid_from, max(ROW('M' || CAST(floor(day("timestamp") / 10) AS INT) || '-' || CAST(gpu_id AS INT) % 3,
          CASE WHEN CAST(gpu_id AS INT) % 2 = 0 AND value > 50 THEN 'big' ELSE 'small' END)) AS v FROM {_T} t GROUP BY uuid, "timestamp"),
c AS (SELECT *, lag(v) OVER (PARTITION BY uuid ORDER BY valid_from) AS b FROM o),
i AS (SELECT uuid, valid_from, v[1] AS model_name, v[2] AS hostname, lead(valid_from) OVER (PARTITION BY uuid ORDER BY valid_from) AS valid_to
      FROM c WHERE b IS DISTINCT FROM v)"""


def _intervals(spark, sf_dir, t):
    """The intervals after two batches, the later one first."""
    from gaugeline.operators.metadata import changes, merge_changes, observations, validity
    early = F.col("timestamp") < F.lit(SPLIT_TS).cast("timestamp_ntz")
    known = changes(observations(t.where(~early)))
    return validity(merge_changes(known, t.where(early)))


@register("metadata_intervals", f"WITH {_META_SQL} SELECT uuid, model_name, hostname, valid_from, valid_to FROM i")
def q_metadata_intervals(spark, sf_dir):
    """2.11 side table: which model and host each device had when, merged from two batches."""
    t = _with_models(telemetry(spark, sf_dir).select("uuid", "gpu_id", "timestamp", "value"))
    return _intervals(spark, sf_dir, t).select("uuid", "model_name", "hostname", "valid_from", "valid_to")


@register("metadata_as_of", f"""
WITH {_META_SQL} SELECT id, t.uuid, i.model_name AS valid_model, i.hostname AS valid_host
FROM {_T} t JOIN i ON t.uuid = i.uuid AND t."timestamp" >= i.valid_from AND (i.valid_to IS NULL OR t."timestamp" < i.valid_to)""")
def q_metadata_as_of(spark, sf_dir):
    """2.11 side table: each record with the model and host valid at its time (as-of join by device and day)."""
    from gaugeline.operators.metadata import with_metadata
    t = _with_models(telemetry(spark, sf_dir).select("id", "uuid", "gpu_id", "timestamp", "value"))
    return with_metadata(t.select("id", "uuid", "timestamp"), _intervals(spark, sf_dir, t)).select("id", "uuid", "valid_model", "valid_host")


# ------------------------------------------------------------ streams with state
def _write_events(spark, sf_dir, path, parts) -> None:
    """Records as Parquet files, one write per part of the ids modulo 4, so that event times come out of order."""
    from gaugeline.functions.timeparse import utc_instant
    ev = telemetry(spark, sf_dir).select("id", "uuid", "timestamp", "metric_name", "value")
    ev = ev.withColumn("timestamp", utc_instant(F.col("timestamp"), ev.schema["timestamp"].dataType))
    for part in parts:
        ev.where(F.col("id") % 4 == part).coalesce(1).write.mode("append").parquet(path)


_RECORD_STREAM = "id long, uuid string, timestamp timestamp, metric_name string, value double"


@register("stream_recent", f"""
SELECT id, uuid, "timestamp", metric_name, value FROM {_T} t
WHERE "timestamp" >= (SELECT max("timestamp") FROM {_T} m) - INTERVAL 12 HOURS""")
def q_stream_recent(spark, sf_dir):
    """ST9 as a stream: files out of order and delivered twice; the window equals the batch filter at the newest record."""
    from gaugeline.session import scratch_path
    from gaugeline.streaming.windows import read_recent, recent_stream
    base = scratch_path(spark, "stream-recent")
    _write_events(spark, sf_dir, f"{base}/in", (2, 0, 0, 3, 1))
    records = spark.readStream.schema(_RECORD_STREAM).option("maxFilesPerTrigger", "1").parquet(f"{base}/in")
    recent_stream(records, f"{base}/recent", f"{base}/ckpt", "12 hours", ["id"], trigger="availableNow").awaitTermination()
    rows = read_recent(spark, f"{base}/recent", "12 hours")
    return rows.select("id", "uuid", utc_wall_clock(F.col("timestamp"), rows.schema["timestamp"].dataType).alias("timestamp"), "metric_name", "value")


@register("stream_insert_if_absent", f"SELECT id, uuid, \"timestamp\", metric_name, value FROM {_T} t")
def q_stream_insert_if_absent(spark, sf_dir):
    """K4 as a stream: redelivered files before and after a restart give one row per key."""
    from gaugeline.session import scratch_path
    from gaugeline.streaming.windows import insert_stream
    base = scratch_path(spark, "stream-insert")
    for parts in ((0, 1, 0), (1, 2, 3, 2)):
        _write_events(spark, sf_dir, f"{base}/in", parts)
        records = spark.readStream.schema(_RECORD_STREAM).option("maxFilesPerTrigger", "2").parquet(f"{base}/in")
        insert_stream(records, ["id"], f"{base}/table", f"{base}/ckpt", "400 days").awaitTermination()
    rows = spark.read.parquet(f"{base}/table")
    return rows.select("id", "uuid", utc_wall_clock(F.col("timestamp"), rows.schema["timestamp"].dataType).alias("timestamp"), "metric_name", "value")


ALERT_RATE = 0.05


@register("stream_reject_alerts", f"""
SELECT day AS window_start, day + INTERVAL 1 DAY AS window_end, rows, rejected, rejected / rows AS reject_rate FROM (
  SELECT date_trunc('day', ts) AS day, count(*) AS rows, count({_REASON_INGEST_SQL}) AS rejected FROM events GROUP BY 1) s
WHERE rejected >= {ALERT_RATE} * rows AND day < (SELECT max(date_trunc('day', ts)) FROM events)""")
def q_stream_reject_alerts(spark, sf_dir):
    """2.11: a CSV file arrives per day; days on which too many records are rejected, counted after rows with line breaks are
    put together, are reported by a second stream."""
    from pyspark.sql import Window

    from gaugeline.operators.commits import file_system
    from gaugeline.session import scratch_path
    from gaugeline.streaming.ingest import ingest_stream
    from gaugeline.streaming.windows import alert_stream
    base = scratch_path(spark, "stream-alerts")
    header = F.lit(",".join(CSV_COLUMNS))
    lines = _events(spark, sf_dir).select(F.unix_date(F.col("ts").cast("date")).alias("day"), "event_id", csv_line_col().alias("line"))
    first = F.row_number().over(Window.partitionBy("day").orderBy("event_id")) == 1
    (lines.withColumn("first", first).select("day", F.explode(F.when(F.col("first"), F.array(header, "line")).otherwise(F.array("line"))).alias("value"))
     .write.partitionBy("day").text(f"{base}/csv"))
    fs, pattern = file_system(spark, f"{base}/csv/day=*/part-*")
    for s in fs.globStatus(pattern):  # each file arrives at the start of its day
        fs.setTimes(s.getPath(), int(s.getPath().getParent().getName().split("=")[1]) * 86_400_000, -1)
    ingest_stream(spark, f"{base}/csv", f"{base}/log", f"{base}/ckpt", N_PARTITIONS, trigger="availableNow", outcomes_path=f"{base}/outcomes").awaitTermination()
    alert_stream(spark, f"{base}/outcomes", f"{base}/alerts", f"{base}/alert-ckpt", "1 day", ALERT_RATE, trigger="availableNow").awaitTermination()
    rows = spark.read.parquet(f"{base}/alerts")
    wall = lambda c: utc_wall_clock(F.col(c), rows.schema[c].dataType).alias(c)
    return rows.select(wall("window_start"), wall("window_end"), "rows", "rejected", "reject_rate")
