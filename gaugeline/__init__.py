"""gaugeline: device-telemetry analytics expressed as Spark DataFrame jobs.

Layers
------
functions/   column expressions (label parsing, partition hash, value parsing, JSON, time)
sources/     readers: CSV files, the offset-numbered log, the telemetry table, driver tables
operators/   DataFrame -> DataFrame operators (gateway queries, numbering, log, table writes)
streaming/   Structured Streaming ingest and consumer-group pipelines
plans/       plan inspection helpers used by tests and the bench
"""

from gaugeline.schema import TELEMETRY_COLUMNS, CSV_COLUMNS  # noqa: F401

__version__ = "0.1.0"
