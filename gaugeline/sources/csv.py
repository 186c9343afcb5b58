"""CSV metric files: 12 positional cells, header row skipped, RFC 4180 quoting.

Cells are read as text; typing and validation happen in
``operators.parse.parse_records`` so that bad rows become data (a reject
reason) instead of failing the job.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gaugeline.schema import CORRUPT_COLUMN, CSV_SCHEMA
from gaugeline.sources.csv_records import ARRIVAL, read_records  # noqa: F401 - ARRIVAL for users of both readers

# Files of one folder that a micro-batch takes unless told otherwise.
DEFAULT_FILES_PER_TRIGGER = 1000

CSV_OPTIONS = {
    "header": "true",          # first line of every file is skipped, names unused
    "enforceSchema": "true",   # positional, whatever the header says
    "sep": ",",
    "quote": '"',
    "escape": '"',             # "" inside a quoted cell is one quote
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": CORRUPT_COLUMN,
    "columnPruning": "false",  # a pruned parser doesn't notice short rows
}


def read_csv(spark: SparkSession, path, multi_line: bool | str = "auto") -> DataFrame:
    """Batch scan of one file, a directory or a glob.

    ``"auto"`` honours line breaks inside quoted cells with every file split across tasks (``csv_records``): the lines are
    read once and written to the shared folder, and the records are put together from them.  ``True`` reads every file
    whole, by one task each, without a copy; ``False`` splits files and takes every line for a record.
    """
    if multi_line == "auto":
        return csv_lines(read_records(spark, path), keep=["source_file"]).select(*CSV_SCHEMA.fieldNames(), "source_file")
    df = (spark.read.schema(CSV_SCHEMA).options(**CSV_OPTIONS)
          .option("multiLine", str(bool(multi_line)).lower()).csv(path))
    return with_source_file(df)


def with_source_file(df: DataFrame) -> DataFrame:
    """Add the file each row came from (kept on rejects for tracing)."""
    return df.withColumn("source_file", F.col("_metadata.file_path"))


def with_arrival(df: DataFrame) -> DataFrame:
    """Add the rest of ARRIVAL to rows that have their source file."""
    return df.withColumns({"source_time": F.col("_metadata.file_modification_time"),
                           "source_block": F.col("_metadata.file_block_start")})


def stream_csv(spark: SparkSession, path, multi_line: bool = True,
               max_files_per_trigger: int | None = DEFAULT_FILES_PER_TRIGGER) -> DataFrame:
    """Continuous source: every new file in ``path`` (one folder or several) is read once.

    A micro-batch takes ``max_files_per_trigger`` files of each folder at most (None: all there are).  ``multi_line=True``
    honours line breaks inside quoted cells; each file is one task then.  ``False`` splits files across tasks and cuts such
    rows into fragments (``streaming.ingest`` by default streams lines instead and puts records together).
    """
    r = (spark.readStream.schema(CSV_SCHEMA).options(**CSV_OPTIONS)
         .option("multiLine", str(multi_line).lower()))
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    folders = [path] if isinstance(path, str) else list(path)
    return reduce(DataFrame.unionAll, [
        with_arrival(with_source_file(r.csv(f))) for f in folders])


def csv_lines(df: DataFrame, line_col: str = "line", keep: list[str] | None = None) -> DataFrame:
    """Parse CSV text lines held in a column (same cells as ``read_csv``)."""
    opts = {k: v for k, v in CSV_OPTIONS.items() if k not in ("header", "enforceSchema")}
    parsed = F.from_csv(F.col(line_col), CSV_SCHEMA.simpleString(), opts)
    cols = [F.col(c) for c in (keep or [])]
    # inline(array(struct)) expands the cells with a generator: later filters on
    # derived columns cannot be pushed below it, so the line is parsed once
    return df.select(*cols, F.inline(F.array(parsed)))


# A quoted cell, or a part of one between doubled quotes: after the start, a separator or a quote.  The run inside is
# possessive, so the match neither recurses nor goes back.  A quote elsewhere in an unquoted cell is ordinary text.
_QUOTED = r'(?<=^|,|")"[^"]*+"'


def cell_count(raw: Column) -> Column:
    """Number of cells in one raw CSV record text: its separators outside quotes, plus one."""
    bare = F.regexp_replace(raw, _QUOTED, "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1
