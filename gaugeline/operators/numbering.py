"""Exact, skew-safe sequential numbering within groups.

``row_number() OVER (PARTITION BY g ORDER BY o)`` sends every group to one task; with a hot group (one device or one log
partition holding a third of all rows) that task sorts a third of the data.  Here the rows are range-partitioned by Spark
on (g, o) and written once with the range they fell into, so a hot group spans many ranges, and

    rn = row_number() OVER (PARTITION BY range, g ORDER BY o)      -- one range's rows
         + rows of the same group in earlier ranges                  -- small table

The range is a stored column, not a physical partition id of a plan that may run again: the numbering is the same under
any later plan, AQE decision or task re-execution.  The same path serves every size; nothing is collected.

The order must be total (end it with a unique key): equal keys fall into one range, and the numbering of equal keys is
arbitrary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gaugeline.session import scratch_path

_RANGE, _GK, _LOCAL, _BEFORE, _N = "_nr_range", "_nr_gk", "_nr_local", "_nr_before", "_nr_n"


def number_rows(df: DataFrame, group_cols: list[str], order_cols: list[str], out_col: str = "rn",
                num_ranges: int | None = None, start: Column | int = 1, scratch: str | None = None) -> DataFrame:
    """Append ``out_col`` = start + 0-based rank of the row in its group under ``order_cols``.

    ``start`` may be a Column already on the row (e.g. a per-group base offset).  There are ``num_ranges`` ranges,
    by default spark.sql.shuffle.partitions.  The ranged rows are written now (one job): to ``scratch``, which the
    caller may delete when the result is no longer read, or to a new folder of the shared scratch space.
    """
    spark = df.sparkSession
    group_cols, order_cols = list(group_cols), list(order_cols)
    n = num_ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch or scratch_path(spark, "numbering")
    ranged = df.repartitionByRange(n, *group_cols, *order_cols).withColumn(_RANGE, F.spark_partition_id())
    ranged.write.parquet(path)
    gk = F.struct(*[F.col(c) for c in group_cols]) if group_cols else F.lit(0)
    tagged = spark.read.schema(ranged.schema).parquet(path).withColumn(_GK, gk)

    runs = tagged.groupBy(_RANGE, _GK).agg(F.count(F.lit(1)).alias(_N))
    before = Window.partitionBy(_GK).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(_RANGE, _GK, F.coalesce(F.sum(_N).over(before), F.lit(0)).alias(_BEFORE))

    local = Window.partitionBy(_RANGE, _GK).orderBy(*[F.col(c) for c in order_cols])
    numbered = tagged.withColumn(_LOCAL, F.row_number().over(local))
    joined = numbered.join(runs, [_RANGE, _GK], "inner")
    base = start if isinstance(start, Column) else F.lit(start)
    rn = F.col(_LOCAL) - 1 + F.col(_BEFORE) + base
    keep = [c for c in df.columns if c != out_col]
    return joined.select(*keep, rn.cast("long").alias(out_col))
