"""Write PLANS.md: for each headline query, what the physical plan does
(exchanges, join strategies, aggregates, scans with pushed filters and read
columns), from ``explain("formatted")`` on the sf0.1 tables. Model
queries are skipped (their plans are the fitting passes, not one query).

usage: python tools/plan_report.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from abundance.plans.queries import QUERIES  # noqa: E402
from abundance.session import get_spark  # noqa: E402

TABLE_QUERIES = [
    "species_true_zeros", "max_n", "abundance_richness", "abundance_richness_skip3", "benthos_composition",
    "relief_moments", "habitat_cover", "size_class_abundance", "zero_fill_grid", "mismatch_report",
    "qa_report", "describe_habitat", "corr_matrix", "model_report", "first_by_min", "widen_habitat",
    "hist_30", "weighted_moments_large", "scatter_sample", "map_extent_saved", "running_total",
]


def formatted(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def summarize(text: str) -> dict:
    tree = text.split("\n\n")[0]
    scans = []
    for block in re.findall(r"\(\d+\) Scan parquet[^\n]*\n(.*?)(?:\n\n|\Z)", text, re.S):
        loc = re.search(r"Location: \w+ \[file:[^\]]*/([^/\]]+)\]", block)
        rs = re.search(r"ReadSchema: struct<(.*)>", block)
        pf = re.search(r"PushedFilters: \[(.*)\]", block)
        cols = [c.split(":")[0] for c in rs.group(1).split(",")] if rs else []
        scans.append((loc.group(1) if loc else "?", cols, pf.group(1) if pf else ""))
    return {
        "exchanges": len(re.findall(r"\+- Exchange|^\s*Exchange", tree, re.M)),
        "broadcast": len(re.findall(r"BroadcastHashJoin", tree)),
        "smj": len(re.findall(r"SortMergeJoin", tree)),
        "nested": len(re.findall(r"NestedLoopJoin|CartesianProduct", tree)),
        "partial_aggs": len(re.findall(r"partial_", text)),
        "windows": len(re.findall(r"\bWindow\b", tree)),
        "python": len(re.findall(r"MapInPandas|ArrowEvalPython|BatchEvalPython", tree)),
        "scans": scans,
    }


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_spark()
    print("# Physical plans of the table queries\n")
    print(f"Generated by `tools/plan_report.py` from `explain(\"formatted\")` on `{sf}` (AQE initial plans;")
    print("AQE may still turn a sort-merge join into a broadcast at run time from measured sizes).\n")
    print("| query | exchanges | broadcast joins | sort-merge joins | nested-loop / cartesian | partial aggregates | windows | Python stages |")
    print("| --- | --- | --- | --- | --- | --- | --- | --- |")
    details = []
    for name in TABLE_QUERIES:
        s = summarize(formatted(QUERIES[name][0](spark, sf)))
        print(f"| `{name}` | {s['exchanges']} | {s['broadcast']} | {s['smj']} | {s['nested']} | "
              f"{s['partial_aggs']} | {s['windows']} | {s['python']} |")
        details.append((name, s["scans"]))
    print("\n## Scans: columns read and filters pushed to Parquet\n")
    for name, scans in details:
        print(f"- `{name}`")
        for table, cols, pf in scans:
            print(f"  - `{table}`: reads {', '.join(cols)}" + (f"; pushed: {pf}" if pf else ""))


if __name__ == "__main__":
    main()
