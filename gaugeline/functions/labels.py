"""Prometheus-style label text  <->  map<string,string>.

Rules of the source parser (applied in this order):
  empty text -> {}; split on every comma (quotes are not respected); trim each
  piece (Unicode white space); skip empty pieces; split on the first '=' and
  skip pieces without one; trim key and value; strip one pair of surrounding
  double quotes from the value; a repeated key keeps its last value.

The text is split on commas once; everything after is a character-set trim, a substring and array lambdas, so the cost
is linear in the text, whatever it holds.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gaugeline.functions.text import _c, strip_quotes, utrim
from gaugeline.schema import LABELS_TYPE


def _entries(text) -> Column:
    """array<struct<key,value>> in text order, duplicates kept."""
    pieces = F.filter(F.split(_c(text), ","), lambda p: F.instr(p, "=") > 0)
    return F.transform(pieces, lambda p: F.struct(
        utrim(F.substring_index(p, "=", 1)).alias("key"),
        strip_quotes(utrim(F.substr(p, F.instr(p, "=") + 1))).alias("value")))


def _last_wins(entries: Column) -> Column:
    """One entry per key, the last one: a stable sort by (key, place) keeps the last of each run of equal keys."""
    placed = F.array_sort(F.transform(entries, lambda e, i: F.struct(e["key"].alias("key"), i.alias("i"), e["value"].alias("value"))))
    # the lambda binds the sorted entries to a name: they are sorted once
    last = F.element_at(F.transform(F.array(placed), lambda p: F.filter(
        p, lambda e, i: ~F.coalesce(F.get(p, i + 1)["key"] == e["key"], F.lit(False)))), 1)
    repeated = F.size(F.array_distinct(entries.getField("key"))) < F.size(entries)
    return F.when(repeated, F.transform(last, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))).otherwise(entries)


def parse_labels(text) -> Column:
    """map<string,string>; NULL text gives NULL, any other text a map."""
    # the lambda binds the entries to a name: they are computed once, though used three times
    once = F.transform(F.array(_entries(text)), lambda e: F.map_from_entries(_last_wins(e)))
    return F.when(_c(text).isNotNull(), F.element_at(once, 1)).cast(LABELS_TYPE)


def labels_to_json(labels) -> Column:
    """map -> JSON object text; NULL map -> NULL (JSON null in the table)."""
    return F.to_json(_c(labels))


def labels_from_json(text) -> Column:
    """JSON object text -> map; unparsable text -> empty map, NULL stays NULL."""
    t = _c(text)
    parsed = F.from_json(t, LABELS_TYPE, {"mode": "PERMISSIVE"})
    empty = F.create_map().cast(LABELS_TYPE)
    return F.when(t.isNull(), F.lit(None).cast(LABELS_TYPE)).otherwise(F.coalesce(parsed, empty))


def typed_labels(text) -> Column:
    """JSON object text -> VARIANT that keeps numbers, booleans, lists and objects as they are.

    NULL and JSON null stay NULL; text that is no JSON object (also one that repeats a key) is the empty object.
    """
    t = _c(text)
    parsed = F.try_parse_json(t)
    kind = F.schema_of_variant(parsed)
    return (F.when(t.isNull() | (kind == "VOID"), F.lit(None).cast("variant"))
            .when(F.startswith(kind, F.lit("OBJECT")), parsed).otherwise(F.parse_json(F.lit("{}"))))


def typed_label(labels, key: str, kind: str = "string") -> Column:
    """One label of a VARIANT as ``kind``; NULL where it is absent or can't be read so."""
    if "'" not in key:
        return F.try_variant_get(_c(labels), f"$['{key}']", kind)
    # a path can't name such a key
    return F.try_variant_get(F.try_variant_get(_c(labels), "$", "map<string,variant>")[key], "$", kind)
