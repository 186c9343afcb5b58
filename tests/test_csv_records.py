"""CSV records put together from split files: equal to a reader of whole files, however the files are cut."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from gaugeline.plans.explain import plan_text
from gaugeline.sources import csv_records as cr
from gaugeline.sources.csv import read_csv
from gaugeline.sources.log import read_log
from gaugeline.streaming.ingest import ingest_stream
from tests.test_parse import HEADER

BITS = ["a", '"', ",", "\n", "b c", '""', 'x"y', "", '"\n"', "1.5", "\r", "é", "\n\n\n", '",\n,"']


@pytest.fixture()
def small_blocks(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def write_files(folder, seed, files=4, rows=60):
    rng = random.Random(seed)
    for f in range(files):
        s = io.StringIO()
        w = csv.writer(s, lineterminator="\n" if f % 2 else "\r\n")
        w.writerow([f"c{i}" for i in range(12)])
        for k in range(rows):
            odd = f > 1 or rng.random() < 0.05
            cells = ["".join(rng.choice(BITS if odd else "abc") for _ in range(rng.randint(0, 4))) for _ in range(rng.choice([12, 12, 12, 5, 13]))]
            w.writerow([f"r{k}", *cells[1:]])
            if f % 2 and k % 17 == 0:
                s.write(f'r{k}z,5" disk,7" x,a\n')
        with open(f"{folder}/f{f}.csv", "w", newline="") as out:
            out.write(s.getvalue())


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_whole_files(spark, tmp_dir, small_blocks, seed):
    write_files(tmp_dir, seed)
    cells = [f"`{c}`" for c in read_csv(spark, tmp_dir, True).columns if c not in ("_corrupt_record", "source_file")]
    rows = lambda df: sorted(tuple(x or "" for x in r) for r in df.select(*cells).collect())
    whole = rows(read_csv(spark, tmp_dir, True))
    assert rows(read_csv(spark, tmp_dir)) == whole and len(whole) >= 240
    assert spark.read.text(tmp_dir).rdd.getNumPartitions() > 20


def test_a_quoted_cell_over_many_blocks(spark, tmp_dir, small_blocks):
    """One cell of 200 lines, which look like records, in the middle of a file; quotes in unquoted cells; an empty file."""
    inside = "\n".join(f"t,m,g,fake{k},u,m,h,c,p,n,{k}," for k in range(200))
    lines = ['"multi\nline header",' + HEADER.split(",", 1)[1], "t,m,g,d0,u,m,h,c,p,n,1,", f't,m,g,"{inside}",u,m,h,c,p,n,2,', "", 't,m,g,5" disk,u,m,h,c,p,n,3,', "  "]
    open(f"{tmp_dir}/a.csv", "w").write("\n".join(lines))
    open(f"{tmp_dir}/empty.csv", "w").close()
    open(f"{tmp_dir}/header.csv", "w").write(HEADER)
    got = {r.value: r.device for r in read_csv(spark, tmp_dir).collect()}
    assert got == {"1": "d0", "2": inside, "3": '5" disk'}


def test_a_cell_that_is_never_closed_takes_the_rest(spark, tmp_dir, small_blocks):
    open(f"{tmp_dir}/a.csv", "w").write(HEADER + '\nt,m,g,d0,u,m,h,c,p,n,1,\nt,m,g,"open,u,m,h\n' + "t,m,g,d,u,m,h,c,p,n,9,\n" * 100)
    open(f"{tmp_dir}/b.csv", "w").write(HEADER + "\n" + "t,m,g,d,u,m,h,c,p,n,7,\n" * 30)
    rows = read_csv(spark, tmp_dir).collect()
    assert len(rows) == 32 and sum(r.value == "7" for r in rows) == 30 and sum(r.value == "9" for r in rows) == 0


def test_line_codes(spark):
    cases = {"a,b": cr.SAME, "": cr.BLANK, " \t": cr.BLANK, '"a",b': cr.OUT, 'a,"b': cr.IN, '"': cr.SWAP, 'b",c': cr.OUT, '""': cr.OUT, '"""': cr.SWAP, 'x"y"z': cr.OUT,
             '""""': cr.OUT, 'a,"b""': cr.IN, 'a","b': cr.IN, ',"': cr.IN}
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", cr.line_code(F.col("t")).alias("c")).collect()
    brute = {}
    for t in cases:
        if not t.strip():
            brute[t] = cr.BLANK
            continue
        ends = [_ends_inside(t, start) for start in (False, True)]
        brute[t] = ends[0] + 2 * ends[1]
    assert {r.t: r.c for r in rows} == brute


def _ends_inside(text, inside):
    """A reader of one character at a time; a quote opens a cell only at its start."""
    at_start, k = not inside, 0
    while k < len(text):
        c = text[k]
        if inside:
            if c == '"' and text[k + 1:k + 2] == '"':
                k += 1
            elif c == '"':
                inside = False
        elif c == '"' and at_start:
            inside = True
        at_start = not inside and c == ","
        k += 1
    return inside


def test_plan_has_no_python_and_no_whole_file(spark, tmp_dir):
    write_files(tmp_dir, 3)
    df = read_csv(spark, tmp_dir)
    assert "Python" not in plan_text(df) and "multiLine" not in plan_text(df)


def test_stream_counts_records(spark, tmp_dir, small_blocks):
    """Broken cells, blank lines and a bad row: log, dead-letter folder and the reported counts agree."""
    import os
    os.makedirs(f"{tmp_dir}/csv")
    lines = [f't,m,g,"d\n{k}",u{k},m,h,c,p,n,{k if k % 5 else "oops"},"a=""1"",\nb=2"' for k in range(40)]
    open(f"{tmp_dir}/csv/a.csv", "w").write("\n".join([HEADER, *lines, "", "short,row"]))
    seen = []
    ingest_stream(spark, f"{tmp_dir}/csv", f"{tmp_dir}/log", f"{tmp_dir}/ck", 3, trigger="availableNow", rejects_path=f"{tmp_dir}/rej",
                  on_metrics=lambda *m: seen.append(m)).awaitTermination()
    log = read_log(spark, f"{tmp_dir}/log").collect()
    assert sorted(int(r.value) for r in log) == [k for k in range(40) if k % 5] and all(r.labels == {"a": "1", "b": "2"} for r in log)
    assert seen == [(0, 41, 9)] and spark.read.parquet(f"{tmp_dir}/rej").count() == 9


