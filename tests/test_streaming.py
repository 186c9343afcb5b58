"""Structured Streaming: CSV folder -> log, restart, replayed batch, consumer groups."""

import os

import pytest
from pyspark.sql import functions as F

from gaugeline.operators.parse import parse_records
from gaugeline.sources.csv import read_csv
from gaugeline.sources.log import read_log
from gaugeline.streaming import consume
from gaugeline.streaming.consume import consume_stream, persist_batch
from gaugeline.streaming.ingest import ingest_batch, ingest_stream
from tests.test_parse import HEADER, ROWS


def _csv(path, name, lines):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w") as f:
        f.write("\n".join([HEADER] + lines) + "\n")


def test_ingest_restart_and_groups(spark, tmp_dir):
    csv, log, table_a, table_b = (f"{tmp_dir}/{x}" for x in ("csv", "log", "ta", "tb"))
    _csv(csv, "1.csv", ROWS[:3] + ["t,x,g,d,uuid-9,m,h,c,p,n,invalid,"])
    ingest_stream(spark, csv, log, f"{tmp_dir}/ck", 3, trigger="availableNow",
                  rejects_path=f"{tmp_dir}/rej").awaitTermination()
    assert read_log(spark, log).count() == 3
    assert spark.read.parquet(f"{tmp_dir}/rej").count() == 1

    # group a reads now, group b later: positions are per group
    consume_stream(spark, log, "a", table_a, f"{tmp_dir}/groups", 3, trigger="availableNow").awaitTermination()
    _csv(csv, "2.csv", ROWS[3:])
    ingest_stream(spark, csv, log, f"{tmp_dir}/ck", 3, trigger="availableNow").awaitTermination()
    got = read_log(spark, log)
    assert got.count() == 5
    per_part = got.groupBy("partition_id").agg(F.count("*").alias("n"), F.max("offset").alias("mx")).collect()
    assert all(r.mx == r.n - 1 for r in per_part)          # dense offsets across both runs

    consume_stream(spark, log, "a", table_a, f"{tmp_dir}/groups", 3, trigger="availableNow").awaitTermination()
    consume_stream(spark, log, "b", table_b, f"{tmp_dir}/groups", 3, trigger="availableNow").awaitTermination()
    assert spark.read.parquet(table_a).count() == 5
    assert spark.read.parquet(table_b).count() == 5


def test_replayed_batches_are_not_duplicated(spark, tmp_dir):
    _csv(f"{tmp_dir}/csv", "1.csv", ROWS)
    batch = parse_records(read_csv(spark, f"{tmp_dir}/csv"), event_time="source")
    for _ in range(2):                                     # replay of the same micro-batch
        ingest_batch(batch, 7, f"{tmp_dir}/log", 3, None, "s")
    log = read_log(spark, f"{tmp_dir}/log")
    assert log.count() == 5
    for _ in range(2):                                     # replay of a consumer batch, by key and by id
        persist_batch(log, f"{tmp_dir}/table", 3)
        persist_batch(log, f"{tmp_dir}/other", 3, "g", 0)
    assert spark.read.parquet(f"{tmp_dir}/table").count() == 5
    assert spark.read.parquet(f"{tmp_dir}/other").count() == 5


def test_a_consumer_batch_that_landed_in_part_is_completed(spark, tmp_dir, monkeypatch):
    from gaugeline.streaming import consume
    _csv(f"{tmp_dir}/csv", "1.csv", ROWS)
    ingest_batch(parse_records(read_csv(spark, f"{tmp_dir}/csv"), event_time="source"), 0, f"{tmp_dir}/log", 3, None, "s")
    log, table = read_log(spark, f"{tmp_dir}/log"), f"{tmp_dir}/table"
    real = consume.persist

    def dies(df, *a, **k):
        real(df.limit(2), *a, **k)
        raise OSError("lost")

    monkeypatch.setattr(consume, "persist", dies)
    with pytest.raises(OSError):
        persist_batch(log, table, 3, "g", 4)
    monkeypatch.setattr(consume, "persist", real)
    persist_batch(log, table, 3, "g", 4)
    got = spark.read.parquet(table)
    assert got.count() == 5 and got.select("partition_id", "offset").distinct().count() == 5


def test_a_micro_batch_does_not_look_at_the_table(spark, tmp_dir, monkeypatch):
    from gaugeline.streaming import consume
    _csv(f"{tmp_dir}/csv", "1.csv", ROWS)
    ingest_batch(parse_records(read_csv(spark, f"{tmp_dir}/csv"), event_time="source"), 0, f"{tmp_dir}/log", 3, None, "s")
    looked = []
    monkeypatch.setattr(consume, "_absent", lambda batch, path: looked.append(path) or batch)
    for k in range(3):
        persist_batch(read_log(spark, f"{tmp_dir}/log"), f"{tmp_dir}/table", 3, "g", k)
    assert not looked and spark.read.parquet(f"{tmp_dir}/table").count() == 15


def test_offsets_follow_the_lines_of_the_files(spark, tmp_dir):
    """Values out of order and equal readings: the log keeps the order of files and lines."""
    csv, values = f"{tmp_dir}/csv", [50, 10, 30, 20, 0, 0, 0, 40]
    for n, part in enumerate((values[:4], values[4:])):
        _csv(csv, f"{9 - n}.csv", [f"t,m,g,line{4 * n + k},one,m,h,c,p,n,{v}," for k, v in enumerate(part)])
        os.utime(f"{csv}/{9 - n}.csv", (1_700_000_000 + n, 1_700_000_000 + n))
    ingest_stream(spark, csv, f"{tmp_dir}/log", f"{tmp_dir}/ck", 3, trigger="availableNow").awaitTermination()
    got = read_log(spark, f"{tmp_dir}/log").orderBy("offset").collect()
    assert [(r.device, r.value) for r in got] == [(f"line{k}", float(v)) for k, v in enumerate(values)]


def test_two_streams_fill_one_log(spark, tmp_dir):
    for name in "ab":
        _csv(f"{tmp_dir}/{name}", "1.csv", [f"t,m,g,{name}{k},u{k},m,h,c,p,n,{k}," for k in range(10)])
        ingest_stream(spark, f"{tmp_dir}/{name}", f"{tmp_dir}/log", f"{tmp_dir}/ck-{name}", 3, trigger="availableNow",
                      rejects_path=f"{tmp_dir}/rej").awaitTermination()
    log = read_log(spark, f"{tmp_dir}/log")
    assert sorted(r.device for r in log.collect()) == sorted(f"{n}{k}" for n in "ab" for k in range(10))
    assert len([d for d in os.listdir(f"{tmp_dir}/rej") if d.startswith("stream=")]) == 2


def test_several_folders_in_one_stream(spark, tmp_dir):
    for name in "ab":
        _csv(f"{tmp_dir}/{name}", "1.csv", ROWS)
    ingest_stream(spark, [f"{tmp_dir}/a", f"{tmp_dir}/b"], f"{tmp_dir}/log", f"{tmp_dir}/ck", 3, trigger="availableNow").awaitTermination()
    assert read_log(spark, f"{tmp_dir}/log").count() == 2 * len(ROWS)


def test_processing_time_trigger_and_small_batches(spark, tmp_dir):
    csv, log = f"{tmp_dir}/csv", f"{tmp_dir}/log"
    for i, row in enumerate(ROWS):
        _csv(csv, f"{i}.csv", [row])
    _csv(csv, "bad.csv", ["t,x,g,d,uuid-9,m,h,c,p,n,oops,"])
    q = ingest_stream(spark, csv, log, f"{tmp_dir}/ck", 3, trigger="1 second", max_files_per_trigger=2)
    try:
        q.processAllAvailable()
        batches = [p for p in q.recentProgress if p["numInputRows"] > 0]
    finally:
        q.stop()
    assert len(batches) == 3                                  # 6 files, 2 per micro-batch
    observed = [b["observedMetrics"]["ingest"] for b in batches]
    assert sum(o["rows"] for o in observed) == 6 and sum(o["rejected"] for o in observed) == 1
    got = read_log(spark, log)
    assert got.count() == 5
    per_part = got.groupBy("partition_id").agg(F.count("*").alias("n"), F.max("offset").alias("mx"),
                                               F.countDistinct("batch").alias("b")).collect()
    assert all(r.mx == r.n - 1 for r in per_part)


def test_micro_batches_leave_no_scratch(spark, tmp_dir):
    from gaugeline.session import shared_dir
    scratch = os.path.join(shared_dir(spark), "gaugeline")
    _csv(f"{tmp_dir}/csv", "1.csv", ROWS)
    before = set(os.listdir(scratch)) if os.path.isdir(scratch) else set()
    ingest_stream(spark, f"{tmp_dir}/csv", f"{tmp_dir}/log", f"{tmp_dir}/ck", 3, trigger="availableNow").awaitTermination()
    assert set(os.listdir(scratch)) == before


def test_a_line_break_in_a_quoted_cell_is_one_record(spark, tmp_dir):
    """By default, with a break in the last cell and in a middle one, beside a file without any."""
    _csv(f"{tmp_dir}/csv", "a b.csv", ['t,m,g,d0,u0,m,h,c,p,n,1,"k=""a"",\ntype=x"', 't,m,g,"d\n1",u1,m,h,c,p,n,2,', "t,m,g,d2,u2,m,h,c,p,n,3,"])
    _csv(f"{tmp_dir}/csv", "plain.csv", ["t,m,g,d3,u3,m,h,c,p,n,4,", "t,x,g,d,uuid-9,m,h,c,p,n,oops,"])
    ingest_stream(spark, f"{tmp_dir}/csv", f"{tmp_dir}/log", f"{tmp_dir}/ck", 1, trigger="availableNow",
                  rejects_path=f"{tmp_dir}/rej").awaitTermination()
    got = {r.uuid: (r.device, r.value, r.labels) for r in read_log(spark, f"{tmp_dir}/log").collect()}
    assert got == {"u0": ("d0", 1.0, {"k": "a", "type": "x"}), "u1": ("d\n1", 2.0, None), "u2": ("d2", 3.0, None), "u3": ("d3", 4.0, None)}
    assert read_log(spark, f"{tmp_dir}/log").count() == 4
    assert [r.uuid for r in spark.read.parquet(f"{tmp_dir}/rej").collect()] == ["uuid-9"]


@pytest.mark.parametrize("rows,tasks", [(10, 1), (1_200_000, 3)])
def test_a_writing_task_holds_a_bounded_part_of_a_batch(spark, tmp_dir, monkeypatch, rows, tasks):
    seen = []
    monkeypatch.setattr(consume, "persist", lambda df, path, n, num_files: seen.append((df.count(), num_files)))
    batch = spark.range(rows).selectExpr("id as offset", "cast(id % 3 as int) as partition_id", "0L as batch")
    persist_batch(batch, f"{tmp_dir}/table", 3)
    assert seen == [(rows, tasks)]
