"""Physical-plan summary of registered queries: operator counts, scan schemas, nested-loop joins.

Usage: python tests/plan_summary.py [sf_dir] [query ...]
"""

from __future__ import annotations

import collections
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

OPS = (r"BroadcastNestedLoopJoin|BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|Exchange hashpartitioning|"
       r"Exchange RoundRobinPartitioning|Exchange SinglePartition|BroadcastExchange|ArrowEvalPython|BatchEvalPython|"
       r"WindowGroupLimit|Window|HashAggregate|SortAggregate|ObjectHashAggregate|Generate|FileScan parquet")


def summarize(df) -> dict:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {"ops": dict(collections.Counter(re.findall(r"\b(" + OPS + r")", plan))),
            "read_schemas": sorted(set(re.findall(r"ReadSchema: (struct<[^>]*>)", plan))),
            "nested_loops": sorted(set(m[:140] for m in re.findall(r"BroadcastNestedLoopJoin [^\n]*", plan)))}


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from sitelens.session import get_spark
    spark = get_spark("local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    import __spark_entry__ as entry
    qs = entry.queries()
    for name in sys.argv[2:] or ["html_rule_match", "tech_with_implied", "endpoints_merged", "external_deps"]:
        s = summarize(qs[name](spark, sf_dir))
        print(name, s["ops"])
        for r in s["read_schemas"]:
            print("   ReadSchema", r)
        for n in s["nested_loops"]:
            print("   NLJ", n)


if __name__ == "__main__":
    main()
