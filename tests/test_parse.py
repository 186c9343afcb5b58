"""Label, value and CSV row parsing; one case per parsing rule."""

import os

from pyspark.sql import functions as F

from gaugeline.functions.labels import parse_labels, labels_from_json, labels_to_json
from gaugeline.functions.values import is_strict_float
from gaugeline.operators.parse import parse_records, reject_counts, rejects, valid
from gaugeline.sources.csv import csv_lines, read_csv

LABEL_CASES = [
    ("", {}),                                                    # nothing
    (" , ,\t,", {}),                                             # blank pieces
    ("rack=7", {"rack": "7"}),                                   # bare value
    ('zone="eu-west"', {"zone": "eu-west"}),                     # one pair of quotes goes
    ('note=""quoted""', {"note": '"quoted"'}),                   # only one pair
    ('open="half', {"open": '"half'}),                           # an unpaired quote stays
    ('q="', {"q": '"'}),                                         # too short for a pair
    ('none=,empty=""', {"none": "", "empty": ""}),               # empty values
    ("=orphan", {"": "orphan"}),                                 # empty key
    ("flag,rack=7,word", {"rack": "7"}),                         # pieces without '='
    ("expr=a=b==c", {"expr": "a=b==c"}),                         # the first '=' splits
    ('list="x,y=z"', {"list": '"x', "y": 'z"'}),                 # commas split inside quotes too
    ("rack=1,zone=a,rack=2", {"rack": "2", "zone": "a"}),        # the last of a key counts
    ("\u3000rack\xa0= 7\u2003,\n zone =\tb", {"rack": "7", "zone": "b"}),   # Unicode white space
    ('pad=" in side "', {"pad": " in side "}),                   # inner space stays
    ("a" + " " * 3000 + "," + " " * 3000 + "k=v", {"k": "v"}),   # long blanks
]


def test_label_parser(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(LABEL_CASES)], "i int, t string")
    got = {r.i: r.m for r in df.select("i", parse_labels(F.col("t")).alias("m")).collect()}
    for i, (_, expected) in enumerate(LABEL_CASES):
        assert got[i] == expected, LABEL_CASES[i]


VALUE_CASES = [
    ("17.25", 17.25), ("0", 0.0), ("-8", -8.0), ("2.5E1", 25.0), ("+7", 7.0), (".125", 0.125), ("9.", 9.0), ("4e-2", 0.04),
    ("12 volts", None), ("n/a", None), (" 3", None), ("3\t", None), ("2f", None), ("2.0D", None), ("9e999", None),
    ("nan", None), ("-Inf", None), ("infinity", None), ("", None), ("0x1F", None), ("12_5", None), ("1e", None), (None, None),
]


def test_value_rules(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(VALUE_CASES)], "i int, t string")
    got = {r.i: r.v for r in df.select("i", F.when(is_strict_float(F.col("t")), F.col("t").try_cast("double")).alias("v")).collect()}
    for i, (_, expected) in enumerate(VALUE_CASES):
        assert got[i] == expected, VALUE_CASES[i]


def test_labels_json_roundtrip(spark):
    df = spark.createDataFrame([('{"key":"value"}',), ("not json",), (None,), ('{"k": 69}',)], "t string")
    out = [r.m for r in df.select(labels_from_json(F.col("t")).alias("m")).collect()]
    assert out == [{"key": "value"}, {}, None, {"k": "69"}]
    enc = df.select(labels_to_json(labels_from_json(F.col("t"))).alias("j")).collect()
    assert enc[0].j == '{"key":"value"}' and enc[2].j is None


HEADER = "when,metric,card,unit,device_uuid,model,host,box,pod,space,reading,tags"
_METRICS = ["clock_mhz", "fan_pct", "mem_mib", "watts", "celsius"]
ROWS = [f"2023-07-0{k + 1}T10:0{k}:30Z,{m},{k},nv{k},dev-{k}{k},mk{k},rack{k}.lan,box-{k},pod-{k},lab,{k * 11 + 0.25},"
        for k, m in enumerate(_METRICS)]


def _write(path, lines):
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")


def test_csv_file_scan(spark, tmp_dir):
    long_cell = '"' + 'y"",' * 50_000 + '"'
    extra = [
        "t,x,g,d,bad-number,m,h,c,p,n,12 volts,",                 # bad value
        "only,three,cells",                                       # short
        'no time,x,g,d,,m,h,c,p,n,-0.5,"u=""1"",w=""2"""',        # empty uuid, quoted labels
        "t,x,g,d,thirteen,m,h,c,p,n,2.5E1,k=v,extra",             # 13 cells
        f"t,x,g,d,thirteen-long,m,h,c,p,n,3,k=v,{long_cell}",     # 13 cells, one quoted and very long
        't,x,g,d,broken-line,m,h,c,p,n,7,"two\nlines=1"',         # newline in a quoted cell
        "t,x,g,d,no-labels,m,h,c,p,n,1,",                         # 12 cells, empty labels
        "t,x,g,d,no-value,m,h,c,p,n,,",                           # empty value
        'a,"b,c,d,e,f,g,h,i,j,k,l,m"',                            # 2 cells, the commas are inside quotes
    ]
    _write(f"{tmp_dir}/a.csv", [HEADER] + ROWS + extra)
    parsed = parse_records(read_csv(spark, f"{tmp_dir}/a.csv"), event_time="ingest")
    good = {r.uuid: r for r in valid(parsed).collect()}
    assert set(good) == {f"dev-{k}{k}" for k in range(5)} | {"", "thirteen", "thirteen-long", "broken-line", "no-labels"}
    assert good["dev-33"].value == 33.25 and good["dev-33"].labels is None and good["dev-33"].container == "box-3"
    assert good[""].labels == {"u": "1", "w": "2"}
    assert good["thirteen"].labels == {"k": "v"} and good["thirteen"].value == 25.0
    assert good["broken-line"].labels == {"two\nlines": "1"}
    counts = {r.reject_reason: r.rows for r in reject_counts(parsed).collect()}
    assert counts == {"invalid_value": 2, "column_count": 2}
    bad = rejects(parsed).where(F.col("reject_reason") == "column_count").collect()
    assert any(r.source_record.startswith("only,three") for r in bad)
    assert all(r.source_file.endswith("a.csv") for r in bad)


def test_cell_count_is_linear(spark):
    from gaugeline.sources.csv import cell_count
    cases = [("", 1), ("a", 1), (",", 2), ("a,b,c", 3), ('"a,b",c', 2), ('"a"",""b",c', 2), ('"",""', 2), ('a"b,c', 2),
             ('"' + "z" * 1_000_000 + '",b', 2), ('"' + '"",' * 200_000 + '",b', 2), ('"open,never closed', 2)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = {r.i: r.n for r in df.select("i", cell_count(F.col("t")).alias("n")).collect()}
    assert [got[i] for i in range(len(cases))] == [n for _, n in cases]


def test_header_only_and_source_time(spark, tmp_dir):
    _write(f"{tmp_dir}/h.csv", [HEADER])
    assert valid(parse_records(read_csv(spark, f"{tmp_dir}/h.csv"))).count() == 0
    times = ["2023-07-01T10:00:30.5+01:00", "yesterday", "2023-02-30T00:00:00Z", "", "2023-07-01 10:00:30"]
    _write(f"{tmp_dir}/s.csv", [HEADER] + [f"{t},x,g,d,u,m,h,c,p,n,1," for t in times])
    parsed = parse_records(read_csv(spark, f"{tmp_dir}/s.csv"), event_time="source")
    good = valid(parsed).collect()
    assert len(good) == 1 and good[0].timestamp.isoformat().startswith("2023-07-01T09:00:30.5")
    assert {r.reject_reason: r.rows for r in reject_counts(parsed).collect()} == {"invalid_timestamp": 4}


def test_csv_lines_from_column(spark):
    df = spark.createDataFrame([(1, ROWS[0]), (2, "a,b")], "id int, line string")
    parsed = parse_records(csv_lines(df, "line", keep=["id"]), keep=["id"])
    got = {r.id: r.reject_reason for r in parsed.collect()}
    assert got == {1: None, 2: "column_count"}


def test_csv_auto_split_keeps_multiline_files_whole(spark, tmp_dir):
    folder = f"{tmp_dir}/with space 100%"
    os.makedirs(folder)
    _write(f"{folder}/plain.csv", [HEADER] + ROWS * 40)
    _write(f"{folder}/tricky one.csv", [HEADER, 't,x,g,d,odd,m,h,c,p,n,7,"two\nlines=1"', ROWS[0]])
    auto = valid(parse_records(read_csv(spark, folder, multi_line="auto")))
    whole = valid(parse_records(read_csv(spark, folder, multi_line=True)))
    key = lambda r: (r.uuid, r.value, str(r.labels))
    assert sorted(map(key, auto.collect())) == sorted(map(key, whole.collect()))
    assert auto.count() == 202
