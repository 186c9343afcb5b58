"""Record layouts.

A telemetry record is a metric time series point keyed by (uuid, metric_name,
timestamp).  It lives in four shapes: a CSV row (12 positional cells), a log row
(record + partition_id + offset), a table row (record + the log key) and JSON.
"""

from pyspark.sql import types as T

# CSV cell order of the source files (index 0..11).
CSV_COLUMNS = [
    "timestamp", "metric_name", "gpu_id", "device", "uuid", "model_name",
    "hostname", "container", "pod", "namespace", "value", "labels",
]
MIN_CSV_CELLS = 12

# The 12 record fields, in the order the query API returns them.
TELEMETRY_COLUMNS = list(CSV_COLUMNS)

# Record fields that are omitted from JSON when empty.
OMIT_EMPTY = ["gpu_id", "device", "model_name", "hostname", "container",
              "pod", "namespace", "labels"]

STRING_FIELDS = [c for c in TELEMETRY_COLUMNS if c not in ("timestamp", "value", "labels")]

CORRUPT_COLUMN = "_corrupt_record"

# Raw CSV: every cell read as text, positional (header row skipped, names ignored).
CSV_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType(), True) for c in CSV_COLUMNS]
    + [T.StructField(CORRUPT_COLUMN, T.StringType(), True)]
)

LABELS_TYPE = T.MapType(T.StringType(), T.StringType(), True)

TELEMETRY_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampType(), False),
    T.StructField("metric_name", T.StringType(), False),
    T.StructField("gpu_id", T.StringType(), True),
    T.StructField("device", T.StringType(), True),
    T.StructField("uuid", T.StringType(), False),
    T.StructField("model_name", T.StringType(), True),
    T.StructField("hostname", T.StringType(), True),
    T.StructField("container", T.StringType(), True),
    T.StructField("pod", T.StringType(), True),
    T.StructField("namespace", T.StringType(), True),
    T.StructField("value", T.DoubleType(), False),
    T.StructField("labels", LABELS_TYPE, True),
])

# Log row = record + hash partition + dense per-partition offset.
# ``batch`` is the id of the streaming micro-batch that appended the row (NULL
# for batch appends); it makes a replayed micro-batch detectable.
LOG_KEY = ["partition_id", "offset"]
LOG_SCHEMA = T.StructType(
    list(TELEMETRY_SCHEMA.fields)
    + [T.StructField("partition_id", T.IntegerType(), False),
       T.StructField("offset", T.LongType(), False),
       T.StructField("batch", T.LongType(), True)]
)
LOG_COLUMNS = LOG_SCHEMA.fieldNames()

# The table's UTC date directory.
DATE_COLUMN = "date"

# Defaults of the original service configuration.
DEFAULT_PARTITIONS = 3
DEFAULT_PAGE_SIZE = 100
MAX_PAGE_SIZE = 1000
DEFAULT_MAX_RECORDS = 100
