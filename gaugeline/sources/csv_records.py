"""Records of CSV files whose quoted cells may hold line breaks, with every file split across tasks.

A task that starts in the middle of a file doesn't know whether its first line lies inside a quoted cell.  Each line is a map
from "inside a quoted cell before it" to "inside after it", found by regular expressions; most lines give the same answer
either way.  The maps of a block compose to the block's map, the blocks' maps to the state before each block (prefix
sums over one small row per block).  Then every line knows its state: lines that are records by themselves stay where they
are, only the lines of broken records are brought together.

The lines are written once to the shared folder as they are read; no file is read twice, and none is read by one task.  A file's
first record is its header.

A line end inside a quoted cell is read as LF where the file's own line ends are CR LF, and as it is in other files.
Quotes open a cell only at its start, as RFC 4180 has it; elsewhere in an unquoted cell they are text.  A quoted cell
that is never closed takes the rest of its file, as it does in a reader of whole files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import Window as W

from gaugeline.session import scratch_path

#: What a line does to the state: both to outside, exchange, leave, both to inside (bit 0: from outside, bit 1: from inside).
#: A blank line leaves it.
OUT, SWAP, SAME, IN, BLANK = range(5)

# A quoted piece: at the start of a cell, or right after another piece (a doubled quote).  The run inside is possessive, so
# the match neither recurses nor goes back.
_PIECE = r'(?:(?<=^|,)|\G(?<!^))"[^"]*+"'
_BLOCK = ["source_file", "source_block"]
_LINE = [*_BLOCK, "place"]
#: Where a row came from: with the place inside its block they give its arrival order.
ARRIVAL = ["source_time", "source_file", "source_block"]


def _opens(line: Column) -> Column:
    """Whether a line that starts outside ends inside a quoted cell."""
    return F.regexp_replace(line, _PIECE, "").rlike('(?:^|,)"[^"]*$')


def line_code(line: Column) -> Column:
    return (F.when(line.rlike(r"^[\x00-\x20]*$"), BLANK).when(F.instr(line, '"') == 0, SAME)
            .otherwise(F.when(_opens(line), 1).otherwise(0) + F.when(_opens(F.concat(F.lit('"'), line)), 2).otherwise(0)).cast("byte"))


def with_line(text: DataFrame) -> DataFrame:
    """Lines of the text reader with their file, its time, their block and their code."""
    line = F.col("value")
    return text.select(line.alias("line"), F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_modification_time").alias("source_time"),
                       F.col("_metadata.file_block_start").alias("source_block"), line_code(line).alias("code"), F.endswith(line, F.lit("\r")).alias("cr"))


def _before(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Add ``known`` and ``flip``: whether the state before a row follows from its group alone, and that state (or, if not
    known, whether it is the opposite of the state before the group)."""
    w = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    swaps = F.coalesce(F.sum(F.when(F.col("code") == SWAP, 1).otherwise(0)).over(w), F.lit(0))
    fixed = F.when(F.col("code").isin(OUT, IN), F.struct((F.col("code") == IN).alias("inside"), F.col("_swaps").alias("at")))
    return (rows.withColumn("_swaps", swaps).withColumn("_fixed", F.last(fixed, ignorenulls=True).over(w))
            .withColumn("known", F.col("_fixed").isNotNull())
            .withColumn("flip", F.coalesce(F.col("_fixed.inside"), F.lit(False)) != ((F.col("_swaps") - F.coalesce(F.col("_fixed.at"), F.lit(0))) % 2 == 1))
            .drop("_swaps", "_fixed"))


def _after(code: Column, known: Column, flip: Column) -> Column:
    """The map up to and including a row, given the map before it."""
    before = F.when(known, F.when(flip, IN).otherwise(OUT)).otherwise(F.when(flip, SWAP).otherwise(SAME))
    return F.when(code.isin(OUT, IN), code).when(code == SWAP, IN - before).otherwise(before)  # exchanged: both bits change


def _written(df: DataFrame, path: str) -> DataFrame:
    """Write a table and read it back: its size is known to the plans that use it."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _line_states(narrow: DataFrame) -> DataFrame:
    """Per line the state before it and the records begun up to it, as far as its block tells: begun for sure, and those
    begun if the block starts outside or inside a quoted cell."""
    rows = _before(narrow, _BLOCK, ["place"])
    upto = W.partitionBy(*_BLOCK).orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    begun = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).over(upto)
    return rows.withColumns({"sure": begun(F.col("known") & ~F.col("flip")), "from_outside": begun(~F.col("known") & ~F.col("flip")),
                             "from_inside": begun(~F.col("known") & F.col("flip"))})


def _block_states(lines: DataFrame) -> DataFrame:
    """``source_file, source_block, inside, base`` from the lines' states: the state before each block, and the records begun in
    earlier blocks of its file."""
    last = F.max_by(F.struct(_after(F.col("code"), F.col("known"), F.col("flip")).alias("code"), "sure", "from_outside", "from_inside"), "place")
    blocks = _before(lines.groupBy(*_BLOCK).agg(last.alias("x")).select(*_BLOCK, "x.*"), ["source_file"], ["source_block"])  # a file starts outside
    own = F.col("sure") + F.when(F.col("flip"), F.col("from_inside")).otherwise(F.col("from_outside"))
    earlier = W.partitionBy("source_file").orderBy("source_block").rowsBetween(W.unboundedPreceding, -1)
    return blocks.select(*_BLOCK, F.col("flip").alias("inside"), F.coalesce(F.sum(own).over(earlier), F.lit(0)).alias("base"))


def lines_of_long_records(lines: DataFrame, broken: DataFrame, scratch: str) -> DataFrame:
    """``source_file, source_block, place, record`` of the lines of ``broken`` files that belong to records of several lines;
    records are numbered within their file.  Only the lines' codes are read and shuffled."""
    rows = _written(_line_states(lines.select(*_LINE, "code").join(broken, "source_file", "left_semi")), f"{scratch}/states")
    rows = rows.join(_block_states(rows), _BLOCK)
    inside = F.when(F.col("known"), F.col("flip")).otherwise(F.col("flip") != F.col("inside"))
    record = F.col("base") + F.col("sure") + F.when(F.col("inside"), F.col("from_inside")).otherwise(F.col("from_outside"))
    return _written(rows.where(inside | F.col("code").isin(SWAP, IN)).select(*_LINE, record.alias("record")), f"{scratch}/long")


def _record(text) -> Column:
    """A text without the rest of its line's end."""
    return F.regexp_replace(text, "\r$", "")


def split_records(lines: DataFrame, scratch: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """``(whole, joined)`` of written lines, without headers and blank lines: those that are records by themselves, with all
    their columns, and the records that go over several lines, ``line, source_time, source_file, source_block, place``
    (where their first line is), or None where there are none.  Small tables about the lines are written to
    ``scratch``, by default a new folder of the shared scratch space."""
    scratch = scratch or scratch_path(lines.sparkSession, "csv-blocks")
    narrow = lines.select(*_LINE, "code", "cr")
    marks = _written(narrow.groupBy(*_BLOCK).agg(F.max(F.col("code").isin(SWAP, IN)).alias("opens"),
                                                 F.min(F.when(F.col("code") != BLANK, F.struct("place", "cr"))).alias("first")), f"{scratch}/marks")
    heads = (marks.where("first is not null").groupBy("source_file").agg(F.min(F.struct("source_block", "first")).alias("h"))
             .select("source_file", "h.source_block", F.col("h.first.place").alias("head"), F.col("h.first.cr").alias("crlf")))
    whole, joined = lines, None
    broken = marks.where("opens").select("source_file").distinct()
    if not broken.isEmpty():
        long = lines_of_long_records(lines, broken, scratch)
        whole = lines.join(long.drop("record"), _LINE, "left_anti")
        parts = F.array_sort(F.collect_list(F.struct("source_block", "place", "source_time", "line")))
        grouped = lines.join(long, _LINE).groupBy("source_file", "record").agg(parts.alias("p")).withColumn("first", F.col("p")[0])
        crlf = heads.select(F.col("source_file").alias("f"), F.col("source_block").alias("b"), "head", "crlf")
        texts = F.transform("p", lambda x: F.when(F.col("crlf"), _record(x["line"])).otherwise(x["line"]))
        joined = (grouped.join(crlf, F.col("source_file") == F.col("f"))
                  .where((F.col("first.source_block") != F.col("b")) | (F.col("first.place") != F.col("head")))
                  .select(_record(F.array_join(texts, "\n")).alias("line"), F.col("first.source_time").alias("source_time"), "source_file",
                          F.col("first.source_block").alias("source_block"), F.col("first.place").alias("place")))
    whole = whole.where(F.col("code") != BLANK).join(heads.select(*_BLOCK, F.col("head").alias("place")), _LINE, "left_anti")
    return whole.withColumn("line", _record("line")).select(*lines.columns), joined


def read_lines(spark: SparkSession, path) -> DataFrame:
    """The lines of files, read once and written to the shared folder."""
    lines = with_line(spark.read.option("lineSep", "\n").text(path)).withColumn("place", F.monotonically_increasing_id())
    return _written(lines, scratch_path(spark, "csv-lines"))


def read_records(spark: SparkSession, path) -> DataFrame:
    """``line, source_file, source_time, source_block, place``: one record text per row."""
    whole, joined = split_records(read_lines(spark, path))
    whole = whole.select("line", *ARRIVAL, "place")
    return whole if joined is None else whole.unionByName(joined)


def stream_lines(spark: SparkSession, folder: str, files: int | None = None) -> DataFrame:
    """The lines of new files of a folder (see ``with_line``), as a stream."""
    r = spark.readStream.option("lineSep", "\n")
    return with_line((r.option("maxFilesPerTrigger", str(files)) if files else r).text(folder))
