"""Counts and pages by the rollup, deep pages without it, compaction: equal to the plain forms; plans read what they should."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gaugeline.operators import query, rollup
from gaugeline.operators.table import persist
from gaugeline.plans.explain import partition_filters
from gaugeline.sources.table import read_table

DAY0 = dt.datetime(2024, 3, 1)


@pytest.fixture(scope="module")
def stores(spark, tmp_path_factory):
    """One busy device (equal times included), one with a single record; counts added in three batches, one of them twice."""
    base = str(tmp_path_factory.mktemp("rollup"))
    rows = [(k, DAY0 + dt.timedelta(hours=(k * 7) % 240), "hot") for k in range(300)] + [(900 + k, DAY0 + dt.timedelta(hours=5), "hot") for k in range(20)] + [(999, DAY0, "one")]
    df = spark.createDataFrame(rows, "id long, timestamp timestamp_ntz, uuid string")
    full = df.select("timestamp", F.lit("m").alias("metric_name"), *[F.lit("").alias(c) for c in ("gpu_id", "device")], "uuid",
                     *[F.lit("").alias(c) for c in ("model_name", "hostname", "container", "pod", "namespace")], F.col("id").cast("double").alias("value"),
                     F.lit(None).cast("map<string,string>").alias("labels"), "id")
    persist(full, f"{base}/t", 3)
    for batch, part in ((0, 0), (1, 1), (1, 1), (2, 2)):
        rollup.add_to_rollup(full.where(F.col("id") % 3 == part), f"{base}/r", batch)
    return read_table(spark, f"{base}/t"), rollup.read_rollup(spark, f"{base}/r")


RANGES = [(None, None), ("2024-03-02T10:00:00Z", None), (None, "2024-03-04T00:00:00Z"), ("2024-03-02T10:00:00Z", "2024-03-06T03:00:00Z"),
          ("2024-03-02T01:00:00Z", "2024-03-02T09:00:00Z"), ("2024-03-02T00:00:00Z", "2024-03-03T00:00:00Z"), ("2025-01-01T00:00:00Z", None)]


@pytest.mark.parametrize("start,end", RANGES)
def test_counts_and_pages_equal_the_plain_forms(stores, start, end):
    table, counts = stores
    for uuid in ("hot", "one", "none"):
        assert rollup.count_by_rollup(table, counts, uuid, start, end, 3).first().total == query.count_records(table, uuid, start, end, 3).first().total
    for page, size in ((1, 7), (9, 7), (46, 7), (10**9, 7), ("x", 0), (2**62, 1000)):
        rows, meta = rollup.page_by_rollup(table, counts, "hot", page, size, start, end, 3)
        want = query.records_page(table, "hot", start, end, page, size, 3)
        assert [r.id for r in rows.collect()] == [r.id for r in want.collect()]
        assert meta.first() == query.page_meta(table, "hot", start, end, page, size, 3).first()


def test_a_count_reads_the_days_at_the_ends_only(stores):
    table, counts = stores
    found = " ".join(partition_filters(rollup.count_by_rollup(table, counts, "hot", "2024-03-02T10:00:00Z", "2024-03-06T03:00:00Z", 3)))
    assert "2024-03-02,2024-03-06" in found.replace(" ", "") and "partition_id" in found
    rows, _ = rollup.page_by_rollup(table, counts, "hot", 20, 10, n_partitions=3)
    days = {r[0] for r in rows.select(F.to_date("timestamp")).distinct().collect()}
    assert len(days) <= 2 and ">=" in " ".join(partition_filters(rows))


def test_deep_pages_are_numbered(stores, monkeypatch):
    table, _ = stores
    want = [r.id for r in query.records_page(table, "hot", page=30, page_size=10, n_partitions=3).collect()]
    monkeypatch.setattr(query, "SORTED_ROWS", 50)
    assert [r.id for r in query.records_page(table, "hot", page=30, page_size=10, n_partitions=3).collect()] == want and len(want) == 10
    assert query.records_page(table, "hot", page=2**62, page_size=1000, n_partitions=3).collect() == []


def test_latest_per_key(spark):
    rows = [("u", "m", DAY0, k, float(k)) for k in (3, 9, 5)] + [("u", "n", DAY0, 4, 4.0), ("v", "m", DAY0, 1, 1.0)]
    df = spark.createDataFrame(rows, "uuid string, metric_name string, timestamp timestamp_ntz, offset long, value double")
    assert sorted((r.uuid, r.metric_name, r.offset, r.value) for r in rollup.latest_per_key(df).collect()) == [("u", "m", 9, 9.0), ("u", "n", 4, 4.0), ("v", "m", 1, 1.0)]
    assert "Window" not in rollup.latest_per_key(df)._jdf.queryExecution().toString() and rollup.latest_per_key(df.limit(0)).count() == 0
