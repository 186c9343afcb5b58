"""Readers: CSV metric files, the partitioned log, the telemetry table, driver tables."""

from gaugeline.sources.csv import read_csv, csv_lines  # noqa: F401
from gaugeline.sources.log import read_log  # noqa: F401
from gaugeline.sources.table import read_table  # noqa: F401
from gaugeline.sources.adapters import events_as_telemetry  # noqa: F401
