"""Structured Streaming pipelines: CSV drop folder -> log, log -> table per consumer group."""

from gaugeline.streaming.ingest import ingest_stream  # noqa: F401
from gaugeline.streaming.consume import consume_stream  # noqa: F401
