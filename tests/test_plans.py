"""Plan properties of the registered queries."""

from gaugeline import catalog
from gaugeline.plans import has_python_eval, read_schema
from tests.conftest import SF001


def test_no_python_nodes_in_any_query(spark):
    for name, fn in catalog.QUERIES.items():
        assert not has_python_eval(fn(spark, SF001)), name


def test_column_pruning_reaches_scan(spark):
    from gaugeline.operators import query
    from gaugeline.sources.adapters import events_as_telemetry
    df = query.count_records(events_as_telemetry(spark, SF001), "GPU-3")
    schemas = read_schema(df)
    assert schemas and all("props" not in s and "value" not in s for s in schemas)


def test_numbering_windows_are_bounded_by_key_ranges(spark):
    """The row_number window is partitioned by (range, group), never by the group alone (a hot group would be one task)."""
    import re
    from gaugeline.operators import query
    from gaugeline.plans import plan_text
    from gaugeline.sources.adapters import events_as_telemetry
    t = events_as_telemetry(spark, SF001).select("id", "uuid", "timestamp")
    text = plan_text(query.page_all(t, 10))
    rn = re.findall(r"row_number\(\) windowspecdefinition\(([^,]+),", text)
    assert rn and all("_nr_range" in p for p in rn), rn


def test_time_window_prunes_date_directories(spark):
    from gaugeline.plans import partition_filters
    for name in ("recent_records", "telemetry_time_range"):
        assert any("date" in f for f in partition_filters(catalog.QUERIES[name](spark, SF001))), name


def test_labels_are_split_once(spark):
    from gaugeline.plans import plan_text
    text = plan_text(catalog.QUERIES["parse_labels"](spark, SF001))
    assert "regexp" not in text and max(line.count("split(") for line in text.splitlines()) <= 1
