"""Plan inspection: what reached the scan, where the shuffles are, no Python in the hot path."""

from gaugeline.plans.explain import (  # noqa: F401
    exchanges, has_python_eval, partition_filters, plan_text, pushed_filters, read_schema,
)
