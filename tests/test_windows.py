"""Streams with state: recent window, insert-if-absent and alerts, with late and redelivered rows and restarts."""

import datetime as dt
import json
import os


from gaugeline.operators.metadata import changes, merge_changes, observations, validity, with_metadata
from gaugeline.streaming.windows import first_within, insert_stream, read_recent, recent_stream, reject_alerts

SCHEMA = "id long, timestamp timestamp, uuid string"
T0 = dt.datetime(2024, 3, 1)


def deliver(spark, folder, rows):
    """One file (one micro-batch) of ``(id, minutes)``."""
    made = spark.createDataFrame([(i, T0 + dt.timedelta(minutes=m), f"u{i}") for i, m in rows], SCHEMA)
    made.coalesce(1).write.mode("append").parquet(folder)


def source(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", "1").parquet(folder)


def test_recent_window_equals_the_batch_filter(spark, tmp_dir):
    batches = [[(1, 0), (2, 9)], [(3, 30), (4, 21), (2, 9)], [(5, 8), (6, 31), (3, 30)], [(7, 60), (8, 50), (9, 51)], [(10, 49), (7, 60)], [(11, 59), (12, 1)]]
    for n, rows in enumerate(batches):
        deliver(spark, f"{tmp_dir}/in", rows)
        recent_stream(source(spark, f"{tmp_dir}/in"), f"{tmp_dir}/recent", f"{tmp_dir}/ck", "10 minutes", ["id"], trigger="availableNow").awaitTermination()
        every = {i: m for b in batches[:n + 1] for i, m in b}
        newest = max(every.values())
        got = [r.id for r in read_recent(spark, f"{tmp_dir}/recent", "10 minutes").collect()]
        assert sorted(got) == sorted(i for i, m in every.items() if m >= newest - 10)
    # directories that the window has left are gone
    left = [int(d.split("=")[1]) for d in os.listdir(f"{tmp_dir}/recent") if d.startswith("slot=")]
    assert min(left) > (T0 + dt.timedelta(minutes=45)).replace(tzinfo=dt.timezone.utc).timestamp()
    assert [r.id for r in read_recent(spark, f"{tmp_dir}/recent", "10 minutes", "2024-03-01T00:50:30Z").collect()] == [8]


def test_state_of_the_window_is_bounded(spark, tmp_dir):
    for k in range(8):
        deliver(spark, f"{tmp_dir}/in", [(100 * k + j, 20 * k + j % 5) for j in range(50)])
    q = first_within(source(spark, f"{tmp_dir}/in"), ["id"], "10 minutes").writeStream.format("noop").option("checkpointLocation", f"{tmp_dir}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    kept = [json.loads(p.json)["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress]
    assert len(kept) >= 8 and max(kept) <= 150, kept  # 400 rows came


def test_insert_if_absent_over_restarts(spark, tmp_dir):
    for rows in ([[(1, 0), (2, 1), (2, 1)], [(1, 0), (3, 2)]], [[(2, 1), (4, 3)], [(4, 3), (3, 2)]], [[(5, 500)]], [[(6, 501), (7, 0), (5, 500)]]):
        for r in rows:
            deliver(spark, f"{tmp_dir}/in", r)
        insert_stream(source(spark, f"{tmp_dir}/in"), ["id"], f"{tmp_dir}/table", f"{tmp_dir}/ck", "60 minutes").awaitTermination()
    # 7 came more than an hour late: dropped, as stated
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_dir}/table").collect()) == [1, 2, 3, 4, 5, 6]


def test_a_replayed_batch_is_written_once(spark, tmp_dir):
    from gaugeline.streaming.windows import _write_batch
    rows = spark.createDataFrame([(1, T0, "u")], SCHEMA)
    for _ in range(2):
        _write_batch(rows, f"{tmp_dir}/t", "s", 3, [])
    _write_batch(rows, f"{tmp_dir}/t", "s", 4, [])
    assert spark.read.parquet(f"{tmp_dir}/t").count() == 2


def test_alerts_of_a_batch_and_a_stream(spark, tmp_dir):
    out = [(T0 + dt.timedelta(minutes=m), r) for m, r in ((0, None), (1, "bad"), (2, None), (5, "bad"), (6, None), (11, "bad"), (12, "bad"), (25, None))]
    batch = spark.createDataFrame(out, "arrived timestamp, reject_reason string")
    batch.coalesce(1).write.parquet(f"{tmp_dir}/in")
    want = [(0, 3, 1), (5, 2, 1), (10, 2, 2)]
    shape = lambda df: sorted(((r.window_start - T0).seconds // 60, r.rows, r.rejected) for r in df.collect())
    assert shape(reject_alerts(batch, "5 minutes", 1 / 3)) == want
    assert shape(reject_alerts(batch, "5 minutes", 0.5, min_rows=2)) == want[1:]
    stream = spark.readStream.schema(batch.schema).parquet(f"{tmp_dir}/in")
    q = (reject_alerts(stream, "5 minutes", 1 / 3).writeStream.format("parquet").option("path", f"{tmp_dir}/out").option("checkpointLocation", f"{tmp_dir}/ck")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    assert shape(spark.read.parquet(f"{tmp_dir}/out")) == want


def test_metadata_intervals_and_as_of(spark):
    def obs(rows):
        return spark.createDataFrame([(u, T0 + dt.timedelta(hours=h), m, "h") for u, h, m in rows], "uuid string, timestamp timestamp, model_name string, hostname string")

    history = [("a", 0, "x"), ("a", 5, "x"), ("a", 30, "y"), ("a", 31, "x"), ("a", 80, "x"), ("b", 50, "z")]
    late = [("a", 40, "q"), ("a", 20, "x"), ("b", 1, "z"), ("c", 3, None), ("c", 4, None)]
    known = changes(observations(obs(history)))
    assert sorted((r.uuid, r.model_name) for r in known.collect()) == [("a", "x"), ("a", "x"), ("a", "y"), ("b", "z")]
    intervals = validity(merge_changes(known, obs(late)))
    got = sorted([(r.uuid, (r.valid_from - T0).total_seconds() / 3600, r.valid_to and (r.valid_to - T0).total_seconds() / 3600, r.model_name) for r in intervals.collect()], key=str)
    # the record at hour 80 was no change when it came, so only the late change at hour 40 is known after hour 31
    assert got == sorted([("a", 0, 30, "x"), ("a", 30, 31, "y"), ("a", 31, 40, "x"), ("a", 40, None, "q"), ("b", 1, None, "z"), ("c", 3, None, None)], key=str)
    asked = [("a", -1, None), ("a", 0, "x"), ("a", 29, "x"), ("a", 30, "y"), ("a", 35, "x"), ("a", 200, "q"), ("b", 0, None), ("b", 300, "z"), ("c", 100, None), ("d", 5, None)]
    rows = spark.createDataFrame([(u, T0 + dt.timedelta(hours=h), m) for u, h, m in asked], "uuid string, timestamp timestamp, want string")
    found = with_metadata(rows, intervals).collect()
    assert len(found) == len(asked) and all(r.valid_model == r.want for r in found)
    assert with_metadata(rows.limit(0), intervals).count() == 0
