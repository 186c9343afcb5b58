"""Property test: the label expression equals the parsing rules, on generated text."""

import re

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from gaugeline.functions.labels import parse_labels
from gaugeline.functions.text import UNICODE_WHITE_SPACE


_S = "[" + "".join(map(re.escape, UNICODE_WHITE_SPACE)) + "]*"
#: The label grammar as one expression over a text between commas: a key up to the first '=', a value in quotes or not.
PAIR = re.compile(rf'(?:^|(?<=,)){_S}(?P<key>[^=,]*?){_S}={_S}(?:"(?P<quoted>[^,]*)"|(?P<plain>[^,]*?)){_S}(?=,|$)')


def rules(text: str) -> dict:
    """Every pair that the grammar finds; a dict keeps a key's last value."""
    return {m["key"]: m["plain"] if m["quoted"] is None else m["quoted"] for m in PAIR.finditer(text)}


ALPHABET = list('abk=,"x ') + ["\t", "\n", " ", "　", " ", "é"]
texts = st.lists(st.text(alphabet=ALPHABET, min_size=0, max_size=30), min_size=200, max_size=200)


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(texts)
def test_parse_labels_matches_rules(spark, batch):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(batch)], "i int, t string")
    got = {r.i: r.m for r in df.select("i", parse_labels(F.col("t")).alias("m")).collect()}
    for i, t in enumerate(batch):
        assert got[i] == rules(t), repr(t)
