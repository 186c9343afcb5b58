"""Helpers over ``DataFrame.explain`` output (used by plan tests and the bench)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    """The physical plan as text (the same text ``df.explain(mode)`` prints)."""
    jdf = df._jdf
    return jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def _section(text: str, key: str) -> list[str]:
    return [m.group(1) for m in re.finditer(rf"{key}: \[(.*?)\]\n", text)]


def pushed_filters(df: DataFrame) -> list[str]:
    return _section(plan_text(df), "PushedFilters")


def partition_filters(df: DataFrame) -> list[str]:
    return _section(plan_text(df), "PartitionFilters")


def read_schema(df: DataFrame) -> list[str]:
    return re.findall(r"ReadSchema: (struct<.*?>)\n", plan_text(df))


def exchanges(df: DataFrame) -> list[str]:
    """Shuffle and broadcast exchanges of the planned query (before AQE re-planning)."""
    return re.findall(r"^\(\d+\) ((?:Exchange|BroadcastExchange)[^\n]*)", plan_text(df), re.M) + \
        re.findall(r"Arguments: ((?:hashpartitioning|rangepartitioning|SinglePartition)[^\n]*)",
                   plan_text(df))


def has_python_eval(df: DataFrame) -> bool:
    """True when a row-at-a-time or Arrow Python evaluation node is in the plan."""
    t = plan_text(df)
    return bool(re.search(r"BatchEvalPython|ArrowEvalPython|FlatMapGroupsInPandas|MapInPandas|"
                          r"MapInArrow|PythonUDF", t))
