"""Skew-safe numbering equals row_number(), including hot groups and NULL groups."""

from pyspark.sql import Window, functions as F

from gaugeline.operators.numbering import number_rows


def _expected(df, group, order):
    w = Window.partitionBy(*group).orderBy(*order) if group else Window.orderBy(*order)
    return {r.id: r.rn for r in df.withColumn("rn", F.row_number().over(w)).collect()}


def test_hot_group_matches_row_number(spark):
    # one key holds a third of the rows, the rest spread over 200 keys
    df = spark.range(6000).select(
        "id",
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 200).cast("string")))
        .alias("g"),
        ((F.col("id") * 7919) % 6000).alias("t"))
    got = {r.id: r.rn for r in number_rows(df, ["g"], ["t", "id"], num_ranges=16).collect()}
    assert got == _expected(df, ["g"], ["t", "id"])


def test_hot_group_is_split_over_ranges(spark):
    """Without a group column every row is one group; it still lies in several stored ranges."""
    from gaugeline.plans import plan_text
    df = spark.range(3000).select("id", F.lit("hot").alias("g"))
    out = number_rows(df, ["g"], ["id"], num_ranges=8)
    path = plan_text(out).split("Location: InMemoryFileIndex [")[1].split("]")[0]
    ranged = spark.read.parquet(path)
    assert ranged.select("_nr_range").distinct().count() == 8
    assert ranged.groupBy("_nr_range").count().agg(F.max("count")).first()[0] < 1500


def test_null_groups_and_start_column(spark):
    df = spark.createDataFrame(
        [(i, None if i % 4 == 0 else f"g{i % 3}", i * 10) for i in range(400)], "id long, g string, t long")
    df = df.withColumn("base", F.when(F.col("g") == "g1", F.lit(100)).otherwise(F.lit(0)))
    got = {r.id: r.rn for r in number_rows(df, ["g"], ["t"], num_ranges=5, start=F.col("base")).collect()}
    exp = _expected(df, ["g"], ["t"])
    base = {r.id: r.base for r in df.collect()}
    assert got == {k: v - 1 + base[k] for k, v in exp.items()}


def test_global_numbering_and_deterministic(spark):
    df = spark.range(2500).select("id", ((F.col("id") * 31) % 977).alias("t"))
    a = {r.id: r.rn for r in number_rows(df, [], ["t", "id"], num_ranges=7).collect()}
    b = {r.id: r.rn for r in number_rows(df.select("t", "id"), [], ["t", "id"], num_ranges=7).collect()}
    assert a == b == _expected(df, [], ["t", "id"])


def test_empty_input(spark):
    df = spark.range(0).select("id", F.lit("x").alias("g"))
    assert number_rows(df, ["g"], ["id"]).count() == 0


def test_many_ranges(spark):
    df = spark.range(5000).select(
        "id", F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise((F.col("id") % 50).cast("string")).alias("g"),
        ((F.col("id") * 13) % 5000).alias("t"))
    got = {r.id: r.rn for r in number_rows(df, ["g"], ["t", "id"], num_ranges=40).collect()}
    assert got == _expected(df, ["g"], ["t", "id"])
