"""Write PLANS.md: the physical-plan facts of every registered telemetry query.

For each query: shuffles (with their partitioning), broadcasts, what reached the
Parquet scans (partition filters, pushed filters, read schema) and whether any
Python evaluation node is present.  Plans are the pre-execution (AQE initial)
plans at the given scale.
Usage: python tools/explain_all.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gaugeline.plans import has_python_eval, plan_text  # noqa: E402
from gaugeline.session import get_spark  # noqa: E402


def facts(text: str) -> dict:
    shuffles = re.findall(r"Arguments: ((?:hashpartitioning|rangepartitioning|SinglePartition|RoundRobinPartitioning)"
                          r"\([^\n]*?\)|SinglePartition)[,\n]", text)
    shuffles = [re.sub(r"#\d+L?", "", s) for s in shuffles]
    return {
        "shuffles": shuffles,
        "broadcasts": len(re.findall(r"^\(\d+\) BroadcastExchange", text, re.M)),
        "scans": len(re.findall(r"^\(\d+\) Scan ", text, re.M)),
        "partition_filters": [re.sub(r"#\d+L?", "", x) for x in re.findall(r"PartitionFilters: \[(.+?)\]\n", text)],
        "pushed": [x for x in re.findall(r"PushedFilters: \[(.*?)\]\n", text) if x],
        "read_schema": re.findall(r"ReadSchema: (struct<.*?>)\n", text),
        "top": text.split("\n\n")[0].replace("== Physical Plan ==\n", ""),
    }


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from gaugeline import catalog
    spark = get_spark("local[8]", shuffle_partitions=8)
    print("# Physical plans of the registered queries\n")
    print(f"Generated by `python tools/explain_all.py {sf_dir}` (Spark {spark.version}, AQE initial plans;"
          " at run time AQE may turn small shuffle joins into broadcasts and coalesce partitions).\n")
    for name, fn in catalog.QUERIES.items():
        df = fn(spark, sf_dir)
        text = plan_text(df)
        f = facts(text)
        print(f"## `{name}`\n")
        print(f"- shuffles: {len(f['shuffles'])}" + ("" if not f["shuffles"] else
              " — " + "; ".join(f"`{s[:110]}`" for s in f["shuffles"])))
        print(f"- broadcasts: {f['broadcasts']}, scans: {f['scans']}, Python nodes: "
              f"{'yes' if has_python_eval(df) else 'none'}")
        for pf in f["partition_filters"]:
            print(f"- PartitionFilters: `{pf[:160]}`")
        for p in f["pushed"]:
            print(f"- PushedFilters: `{p[:200]}`")
        for rs in f["read_schema"][:3]:
            print(f"- ReadSchema: `{rs[:200]}`")
        print("\n```\n" + f["top"] + "\n```\n")
    spark.stop()


if __name__ == "__main__":
    main()
