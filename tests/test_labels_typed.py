"""Label values that aren't text: JSON to VARIANT, through the table and back."""

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.functions.labels import parse_labels, typed_label, typed_labels
from gaugeline.functions.records import record_from_json, record_to_json
from gaugeline.operators.table import persist
from gaugeline.sources.adapters import events_as_telemetry
from gaugeline.sources.table import read_table
from tests.conftest import SF001

TEXTS = ['{"k": 69, "b": true, "o": {"z": [1, 2.5, null], "a": "x"}, "s": "t"}', '{"k": "69"}', "{}", "[1]", "7", '"x"', "bad", "", "null", None,
         '{"it\'s \\\\ odd": 1, "é": "\\u00e9"}', '{"long": "' + "x" * 100_000 + '"}']


def test_texts(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string").select("id", typed_labels("t").alias("v")).select(
        "id", F.to_json("v").alias("j"), typed_label("v", "k", "long").alias("k"), typed_label("v", "b", "boolean").alias("b"), typed_label("v", "it's \\ odd", "int").alias("odd")).collect()
    for r in rows:
        try:
            want = json.loads(TEXTS[r.id]) if TEXTS[r.id] is not None else None
            want = want if want is None or isinstance(want, dict) else {}
        except ValueError:
            want = {}
        assert (json.loads(r.j) if r.j is not None else None) == want, r.id
    by = {r.id: r for r in rows}
    assert by[0].k == 69 and by[0].b is True and by[1].k == 69 and by[2].k is None and by[10].odd == 1


def test_through_table_and_json(spark, tmp_dir):
    ev = events_as_telemetry(spark, SF001, with_labels=False).limit(len(TEXTS)).withColumn("n", F.col("id") % len(TEXTS))
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "n long, t string")
    persist(ev.join(texts, "n").withColumn("labels", typed_labels("t")), f"{tmp_dir}/t", 3)
    back = read_table(spark, f"{tmp_dir}/t", typed=True)
    assert isinstance(back.schema["labels"].dataType, T.VariantType) and back.count() == len(TEXTS)
    again = back.select("id", F.to_json("labels").alias("a"), record_from_json(record_to_json(ntz=True, typed=True), typed=True).alias("r"))
    for r in again.select("id", "a", F.to_json("r.labels").alias("b")).collect():
        assert r.a == r.b or (r.b is None and r.a in (None, "{}"))  # empty labels are omitted from a record's JSON


def test_map_and_text_tables_read_as_typed(spark, tmp_dir):
    ev = events_as_telemetry(spark, SF001).limit(5)
    persist(ev, f"{tmp_dir}/map", 3)
    persist(ev.withColumn("labels", F.lit('{"k": 5}')), f"{tmp_dir}/text", 3)
    kept = {r.id: r.k for r in read_table(spark, f"{tmp_dir}/map").select("id", F.col("labels")["k"].alias("k")).collect()}
    got = {r.id: r.k for r in read_table(spark, f"{tmp_dir}/map", typed=True).select("id", typed_label("labels", "k").alias("k")).collect()}
    assert got == kept
    assert {r.k for r in read_table(spark, f"{tmp_dir}/text", typed=True).select(typed_label("labels", "k", "int").alias("k")).collect()} == {5}


def test_many_repeated_keys_are_linear(spark):
    text = ",".join(f"k{i % 50}={i}" for i in range(40_000))
    got = spark.createDataFrame([(text,)], "t string").select(parse_labels(F.col("t")).alias("m")).first().m
    assert got == {f"k{i}": str(39_950 + i) for i in range(50)}
