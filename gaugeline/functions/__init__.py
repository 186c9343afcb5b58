"""Column expressions built from Spark built-ins (no Python UDFs)."""

from gaugeline.functions.text import utrim, strip_quotes  # noqa: F401
from gaugeline.functions.partition import partition_id, partition_id_of  # noqa: F401
from gaugeline.functions.labels import parse_labels, labels_to_json, labels_from_json  # noqa: F401
from gaugeline.functions.values import is_strict_float  # noqa: F401
from gaugeline.functions.timeparse import parse_rfc3339, ts_literal, utc_instant, utc_wall_clock  # noqa: F401
from gaugeline.functions.records import record_to_json, record_from_json  # noqa: F401
