"""Device query: argument rules, paging, counts, time bounds, pushdown."""

import pytest
from pyspark.sql import functions as F

from gaugeline.operators import query
from gaugeline.plans import partition_filters, pushed_filters
from gaugeline.sources.adapters import events_as_telemetry
from tests.conftest import SF001

SAMPLE = ("sm_clock", "3", "nv3", "dev-3c41", "H20", "rack3.lan", "box-3", "pod-3", "lab", 61.5, {"slot": "a"})


@pytest.fixture(scope="module")
def table(spark):
    rows = []
    for i in range(50):
        rows.append((f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}",) + SAMPLE)
    rows.append(("2024-01-02 00:00:00", "x", "", "", "other", "", "", "", "", "", 1.0, None))
    df = spark.createDataFrame(rows, "ts string, metric_name string, gpu_id string, device string, uuid string, "
                                     "model_name string, hostname string, container string, pod string, "
                                     "namespace string, value double, labels map<string,string>")
    return df.select(F.col("ts").cast("timestamp").alias("timestamp"), *df.columns[1:], F.unix_timestamp("ts").alias("id"))


def test_argument_errors(table):
    with pytest.raises(ValueError):
        query.telemetry_by_uuid(table, "")
    with pytest.raises(ValueError):
        query.telemetry_by_uuid(table, "u", start_time="2024-01-02")
    with pytest.raises(ValueError):
        query.telemetry_by_uuid(table, "u", start_time="yesterday")
    with pytest.raises(ValueError):
        query.telemetry_by_uuid(table, "u", "2024-01-02T00:00:00Z", "2024-01-01T00:00:00Z")


def test_list_uuids(spark, table):
    assert [r.uuid for r in query.list_uuids(table).collect()] == [SAMPLE[3], "other"]
    assert query.list_uuids(table.limit(0)).count() == 0


def test_found_page_and_meta(table):
    rows, meta = query.telemetry_by_uuid(table, SAMPLE[3], page=2, page_size=20)
    got = rows.collect()
    assert len(got) == 20 and got[0].timestamp.second == 20
    assert got[0].labels == SAMPLE[10]
    m = meta.collect()[0]
    assert (m.page, m.page_size, m.total, m.total_pages, m.found) == (2, 20, 50, 3, True)


def test_empty_page_still_counts(table):
    rows, meta = query.telemetry_by_uuid(table, SAMPLE[3], page=3, page_size=25)
    assert rows.count() == 0
    m = meta.collect()[0]
    assert (m.total, m.total_pages, m.found) == (50, 2, False)


def test_no_rows(table):
    rows, meta = query.telemetry_by_uuid(table, "missing")
    assert rows.count() == 0
    assert tuple(meta.collect()[0]) == (1, 100, 0, 1, False)


def test_inclusive_time_bounds_with_offsets(table):
    rows, meta = query.telemetry_by_uuid(table, SAMPLE[3], "2024-01-01T01:00:10+01:00",
                                         "2024-01-01T00:00:19.000Z", page_size=1000)
    assert rows.count() == 10 and meta.collect()[0].total == 10


def test_page_arguments():
    for bad in (" 5 ", "1_0", "٣", "1.0", "", None, "0", "-3", "x", str(2**63), 2**63, True, 2.0):
        assert query.normalize_page(bad) == 1, bad
        assert query.normalize_page_size(bad) == 100, bad
    assert [query.normalize_page(x) for x in ("7", "+7", 7, "007")] == [7] * 4
    assert query.normalize_page_size("1001") == 100 and query.normalize_page_size("1000") == 1000


def test_page_beyond_any_row(table):
    rows, _ = query.telemetry_by_uuid(table, SAMPLE[3], page=2**62, page_size=1000)
    assert rows.count() == 0


def test_order_must_be_total(table):
    import pytest
    with pytest.raises(ValueError):
        query.order_key(table.select("timestamp", "metric_name"))


def test_pushdown_on_table(spark, tmp_dir):
    from gaugeline.operators.table import persist
    from gaugeline.sources.table import read_table
    persist(events_as_telemetry(spark, SF001), tmp_dir, 3, mode="overwrite")
    t = read_table(spark, tmp_dir)
    sel = query.select_records(t, "GPU-8", "2024-01-02T00:00:00Z", None, n_partitions=3)
    pf = " ".join(pushed_filters(sel))
    assert "EqualTo(uuid,GPU-8)" in pf and "GreaterThanOrEqual(timestamp" in pf
    assert any("partition_id" in p for p in partition_filters(sel))
    assert sel.count() == events_as_telemetry(spark, SF001).where(
        (F.col("uuid") == "GPU-8") & (F.col("timestamp") >= F.lit("2024-01-02").cast("timestamp_ntz"))).count()


def test_page_all_and_meta_all(spark):
    t = events_as_telemetry(spark, SF001)
    pages = query.page_all(t, 10).groupBy("uuid").agg(F.max("rn").alias("n"), F.max("page").alias("p"))
    meta = query.page_meta_all(t, 10)
    j = pages.join(meta, "uuid").collect()
    assert len(j) == 15 and all(r.n == r.total and r.p == r.total_pages for r in j)


def test_keyset_paging_walks_all_pages(spark):
    from gaugeline.plans import pushed_filters
    t = events_as_telemetry(spark, SF001)
    expected = [r.id for r in t.where(F.col("uuid") == "GPU-8").orderBy("timestamp", "id").collect()]
    seen, cursor = [], None
    while True:
        page = query.records_after(t, "GPU-8", cursor, page_size=10).collect()
        if not page:
            break
        seen += [r.id for r in page]
        cursor = (page[-1].timestamp, page[-1].id)
    assert seen == expected
    first = (t.where(F.col("uuid") == "GPU-8").orderBy("timestamp", "id").first())
    sel = query.records_after(t, "GPU-8", (first.timestamp, first.id), page_size=5)
    assert any("GreaterThanOrEqual(ts" in p for p in pushed_filters(sel))
