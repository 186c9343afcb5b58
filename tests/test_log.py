"""Log append, offsets, consume by offset, consumer groups (literal fixtures)."""

import pytest
from pyspark.sql import functions as F

from gaugeline.functions.partition import partition_id_of
from gaugeline.operators.log import (append_log, consume, consume_groups, consume_status, end_offsets,
                                     merge_positions, poll)
from gaugeline.sources.log import read_log


def records(spark, n, uuid="uuid-1", start=0):
    rows = [(f"2024-01-01 00:00:{i % 60:02d}.{i:06d}", "m", uuid, float(i)) for i in range(start, start + n)]
    df = spark.createDataFrame(rows, "ts string, metric_name string, uuid string, value double")
    return df.select(F.col("ts").cast("timestamp").alias("timestamp"), "metric_name",
                     *[F.lit("").alias(c) for c in ("gpu_id", "device", "model_name", "hostname",
                                                      "container", "pod", "namespace")],
                     "uuid", "value", F.lit(None).cast("map<string,string>").alias("labels"))


ORDER = ["timestamp", "value"]


def test_one_device_one_partition(spark, tmp_dir):
    rep = append_log(records(spark, 2, "rack7-slot2"), tmp_dir, 3, ORDER).collect()
    pid = partition_id_of("rack7-slot2", 3)
    assert [(r.partition_id, r.records, r.next_offset) for r in rep] == [(pid, 2, 2)]
    assert sorted(r.offset for r in read_log(spark, tmp_dir).collect()) == [0, 1]


def test_empty_append(spark, tmp_dir):
    assert append_log(records(spark, 0), tmp_dir, 3, ORDER).count() == 0


def test_offsets_continue_and_reopen(spark, tmp_dir):
    append_log(records(spark, 3, start=0), tmp_dir, 3, ORDER).collect()
    rep = append_log(records(spark, 4, start=3), tmp_dir, 3, ORDER).collect()
    assert [(r.records, r.next_offset) for r in rep] == [(4, 7)]
    back = read_log(spark, tmp_dir).orderBy("offset").collect()
    assert [r.offset for r in back] == list(range(7)) and [r.value for r in back] == [float(i) for i in range(7)]


@pytest.fixture()
def log5(spark, tmp_dir):
    append_log(records(spark, 5, "rack1-slot9"), tmp_dir, 3, ORDER).collect()
    return read_log(spark, tmp_dir), partition_id_of("rack1-slot9", 3)


def _status(log, positions, group, m):
    return consume_status(end_offsets(log, 3), positions, [group], m, 3).collect()


def test_fetch_from_offset(spark, log5):
    log, pid = log5
    for start, m, n_rows, nxt, more in [(1, 9, 4, 5, False), (0, 3, 3, 3, True), (3, 1, 1, 4, True),
                                       (5, 7, 0, 5, False), (64, 7, 0, 64, False)]:
        rows = consume(log, pid, start, m).collect()
        assert len(rows) == n_rows
        st = [r for r in _status(log, {"g": {pid: start}}, "g", m) if r.partition_id == pid][0]
        assert (st.records, st.next_offset, st.has_more) == (n_rows, nxt, more)


def test_max_records(spark, tmp_dir):
    append_log(records(spark, 20), tmp_dir, 3, ORDER).collect()
    log = read_log(spark, tmp_dir)
    pid = partition_id_of("uuid-1", 3)
    assert consume(log, pid, 0, 10).count() == 10
    st = [r for r in _status(log, {"g": {}}, "g", 10) if r.partition_id == pid][0]
    assert st.has_more and st.next_offset == 10


def test_two_groups_are_independent(spark, log5):
    log, pid = log5
    positions = {}
    seen = []
    for group, m in [("a", 2), ("b", 3), ("a", 10), ("b", 10)]:
        recs, status = poll(log, positions, group, m, 3)
        n = recs.count()
        positions = merge_positions(positions, status)
        nxt = [r.next_offset for r in status.collect() if r.partition_id == pid][0]
        seen.append((group, n, nxt))
    assert seen == [("a", 2, 2), ("b", 3, 3), ("a", 3, 5), ("b", 2, 5)]


def test_five_groups_each_read_all(spark, tmp_dir):
    df = records(spark, 100).withColumn("uuid", F.concat(F.lit("u"), (F.col("value") % 7).cast("int").cast("string")))
    append_log(df, tmp_dir, 3, ORDER).collect()
    log = read_log(spark, tmp_dir)
    out = consume_groups(log, {}, [f"g{i}" for i in range(5)], 1000, 3)
    assert {r.group: r.n for r in out.groupBy("group").agg(F.count("*").alias("n")).collect()} == \
        {f"g{i}": 100 for i in range(5)}


def test_consume_is_pruned(spark, log5):
    from gaugeline.plans import partition_filters, pushed_filters
    log, pid = log5
    sel = consume(log, pid, 2, 10)
    assert any("partition_id" in p for p in partition_filters(sel))
    assert any("offset" in p for p in pushed_filters(sel))


def _restart():
    from gaugeline.operators import log as log_module
    log_module._WRITTEN.clear()


def test_leftovers_of_an_unfinished_append_are_replaced(spark, tmp_dir):
    from gaugeline.operators.log import log_state, to_log_rows
    append_log(records(spark, 4), tmp_dir, 3, ORDER, batch=0, stream="a")
    pid = partition_id_of("uuid-1", 3)
    part = records(spark, 2, start=4).withColumns({"partition_id": F.lit(pid), "offset": F.col("value").cast("long")})
    to_log_rows(part, 1).write.mode("append").partitionBy("partition_id").parquet(tmp_dir)
    _restart()
    assert log_state(spark, tmp_dir, 3)[0][pid] == 4
    rep = append_log(records(spark, 5, start=4), tmp_dir, 3, ORDER, batch=1, stream="a").collect()
    assert [(r.records, r.next_offset) for r in rep] == [(5, 9)]
    back = read_log(spark, tmp_dir).collect()
    assert sorted((r.offset, r.value) for r in back) == [(k, float(k)) for k in range(9)]


def test_batches_are_counted_per_stream(spark, tmp_dir):
    for stream, start in (("a", 0), ("b", 10)):
        for _ in range(2):   # the second time it is a replay
            rep = append_log(records(spark, 10, start=start), tmp_dir, 3, ORDER, batch=0, stream=stream).collect()
            assert [(r.records, r.next_offset) for r in rep] == [(10, start + 10)]
    assert sorted(r.value for r in read_log(spark, tmp_dir).collect()) == [float(k) for k in range(20)]


def test_appends_of_one_process_take_turns(spark, tmp_dir):
    from concurrent.futures import ThreadPoolExecutor
    append_log(records(spark, 1), tmp_dir, 3, ORDER)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: append_log(records(spark, 10, start=10 * k), tmp_dir, 3, ORDER), range(1, 5)))
    got = read_log(spark, tmp_dir)
    assert sorted(r.offset for r in got.collect()) == list(range(41)) and got.select("value").distinct().count() == 41


def test_two_writers_cannot_both_commit(spark, tmp_dir):
    from gaugeline.operators.commits import read_commit, write_commit
    append_log(records(spark, 1), tmp_dir, 3, ORDER)
    number, doc = read_commit(spark, tmp_dir)
    with pytest.raises(Exception, match="already exists"):
        write_commit(spark, tmp_dir, number, doc)


def test_a_torn_commit_is_passed_over(spark, tmp_dir):
    from gaugeline.operators.commits import read_commit
    append_log(records(spark, 3), tmp_dir, 3, ORDER)
    number, doc = read_commit(spark, tmp_dir)
    with open(f"{tmp_dir}/_commit-{number + 1:012d}.json", "w") as f:
        f.write('{"ends": {"0"')
    assert read_commit(spark, tmp_dir) == (number + 1, doc)
    _restart()
    assert append_log(records(spark, 2, start=3), tmp_dir, 3, ORDER).first().next_offset == 5


def test_a_log_without_commits_is_taken_as_it_is(spark, tmp_dir):
    from gaugeline.operators.log import assign_offsets, to_log_rows
    rows = to_log_rows(assign_offsets(records(spark, 4), 3, ORDER))
    rows.write.mode("append").partitionBy("partition_id").parquet(tmp_dir)
    assert append_log(records(spark, 2, start=4), tmp_dir, 3, ORDER).first().next_offset == 6
    assert sorted(r.offset for r in read_log(spark, tmp_dir).collect()) == list(range(6))


def test_interrupted_position_write_keeps_the_old_ones(spark, tmp_dir):
    import os
    from gaugeline.operators.log import load_positions, save_positions
    at = lambda n: spark.createDataFrame([("g", 0, n)], "group string, partition_id int, next_offset long")
    for n in (1, 2, 3):
        save_positions(at(n), f"{tmp_dir}/p")
    os.makedirs(f"{tmp_dir}/p/v=3")   # begun, never finished
    assert load_positions(spark, f"{tmp_dir}/p").first().next_offset == 3
    save_positions(at(4), f"{tmp_dir}/p")
    assert load_positions(spark, f"{tmp_dir}/p").first().next_offset == 4


def test_an_idle_group_does_not_widen_the_scan():
    from gaugeline.operators.log import merged_intervals
    assert merged_intervals([0, 10**9, 10**9 + 50], 100) == [(0, 100), (10**9, 10**9 + 150)]
    assert merged_intervals([0, 500, 10_000], 100, most=2) == [(0, 600), (10_000, 10_100)]


def test_consume_groups_single_pruned_scan(spark, log5):
    from gaugeline.plans import plan_text, pushed_filters
    log, pid = log5
    out = consume_groups(log, {"a": {pid: 1}, "b": {pid: 3}}, ["a", "b"], 2, 3)
    import re
    assert len(re.findall(r"^\(\d+\) Scan parquet", plan_text(out), re.M)) == 1
    assert any("offset" in p for p in pushed_filters(out))
    got = sorted((r.group, r.offset) for r in out.collect() if r.partition_id == pid)
    assert got == [("a", 1), ("a", 2), ("b", 3), ("b", 4)]


def test_ndjson_export_roundtrip(spark, tmp_dir):
    from gaugeline.operators.log import export_log_json
    append_log(records(spark, 6, "uuid-2"), f"{tmp_dir}/log", 3, ORDER).collect()
    log = read_log(spark, f"{tmp_dir}/log")
    export_log_json(log, f"{tmp_dir}/json")
    back = read_log(spark, f"{tmp_dir}/json", fmt="json")
    a = sorted((r.partition_id, r.offset, r.value, r.uuid, r.container) for r in back.collect())
    b = sorted((r.partition_id, r.offset, r.value, r.uuid, r.container) for r in log.collect())
    assert a == b


def test_positions_saved_and_reloaded(spark, log5, tmp_dir):
    from gaugeline.operators.log import load_positions, save_positions
    log, pid = log5
    path = f"{tmp_dir}/positions"
    for group, m, expect in [("a", 2, 2), ("a", 2, 4), ("b", 1, 1), ("a", 10, 5)]:
        recs, status = poll(log, load_positions(spark, path), group, m, 3)
        recs.count()
        save_positions(merge_positions(load_positions(spark, path), status), path)
        got = {(r.group, r.partition_id): r.next_offset for r in load_positions(spark, path).collect()}
        assert got[(group, pid)] == expect
    assert got[("b", pid)] == 1


def test_log_times_do_not_depend_on_session_time_zone(spark, tmp_dir):
    from gaugeline.functions.timeparse import utc_wall_clock
    rec = records(spark, 1).withColumn("timestamp", F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"))
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
        append_log(rec, tmp_dir, 3, ORDER).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    log = read_log(spark, tmp_dir)
    got = log.select(utc_wall_clock(F.col("timestamp"), log.schema["timestamp"].dataType).alias("t")).collect()
    assert str(got[0].t) == "2024-01-15 12:00:00"


def test_a_failed_commit_undoes_the_append(spark, tmp_dir, monkeypatch):
    from gaugeline.operators import log as log_module
    append_log(records(spark, 3), tmp_dir, 3, ORDER)
    real = log_module.write_commit

    def boom(*a, **k):
        raise OSError("commit store unavailable")

    monkeypatch.setattr(log_module, "write_commit", boom)
    with pytest.raises(OSError):
        append_log(records(spark, 2, start=3), tmp_dir, 3, ORDER)   # data written, not committed
    monkeypatch.setattr(log_module, "write_commit", real)
    append_log(records(spark, 2, start=5), tmp_dir, 3, ORDER)
    back = sorted((r.offset, r.value) for r in read_log(spark, tmp_dir).collect())
    assert back == [(0, 0.0), (1, 1.0), (2, 2.0), (3, 5.0), (4, 6.0)]
