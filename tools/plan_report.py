"""Summarise the physical plans of the reports in an at-scale configuration.

Usage: python tools/plan_report.py [sf_dir] > PLANS.md

Broadcast joins by size are disabled (as for dimensions too large to
broadcast), so the plans show the shuffle structure a large cluster runs. The
executed (adaptive) plans are used, after running each report once. A shared
exchange is counted where it is computed.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from marketlens.plans import Workload, all_reports  # noqa: E402
from marketlens.session import local_session  # noqa: E402
from marketlens.sources import ADAPTER_PARAMS, from_tpch  # noqa: E402

NOTES = """# Plan review

How the reports execute at scale, read from the executed adaptive plans (size-based
broadcast disabled, so that dimension joins show the shuffle structure of a large cluster).

* **Item joins**: how often the items meet the orders. One per report, two for
  `origin_seller` (its top city counts distinct orders), one per top-k table for
  `top_summary`. Reports that read order columns alone count the items per order before
  that join (`per order`); the others shuffle item rows once.
* **Shared work is reused.** `reused` counts exchanges Spark computed once and read again:
  the parts of a report read one aggregate of the fact.
* **Windows** run over values and slices, never over the rows they rank or number:
  `WindowGroupLimit` keeps k values per year and task.
* **No `Expand`** where several distinct counts are asked for.
* **No Python.** No plan contains a Python evaluation node.
"""


def walk(node, reused: bool = False):
    """Nodes of a plan, top down; below a shared exchange again only if ``reused``."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        yield from walk(node.executedPlan(), reused)
    elif kind.endswith("QueryStageExec"):
        yield from walk(node.plan(), reused)
    else:
        yield node
        children = node.children()
        below = [children.apply(i) for i in range(children.size())]
        if kind == "ReusedExchangeExec" and reused:
            below = [node.child()]
        for child in below:
            yield from walk(child, reused)


def kind_of(node) -> str:
    return node.getClass().getSimpleName()


def scans_items(node) -> bool:
    return any(kind_of(n) == "FileSourceScanExec" and "/lineitem.parquet" in n.toString() for n in walk(node, True))


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    print(NOTES)
    print(f"Data: `{sf_dir}`. Generated by `tools/plan_report.py`.\n")
    print("| report | shuffles | reused | item joins | windows | group-limited | Expand | python |")
    print("|---|---|---|---|---|---|---|---|")
    for name, report in all_reports().items():
        if name == "summary":
            continue
        df = report.build(Workload(from_tpch(spark, sf_dir), ADAPTER_PARAMS))
        df.collect()
        nodes = list(walk(df._jdf.queryExecution().executedPlan()))
        kinds = [kind_of(n) for n in nodes]
        joins, grains = 0, set()
        for n in nodes:
            said = n.simpleString(200)
            if "Join" in kind_of(n) and "[order_id#" in said and "FullOuter" not in said and scans_items(n):
                joins += 1
                side = next(x for x in list(walk(n, True))[1:] if kind_of(x) in ("HashAggregateExec", "FileSourceScanExec"))
                grains.add("per order" if kind_of(side) == "HashAggregateExec" else "items")
        text = df._jdf.queryExecution().executedPlan().toString()
        print(
            f"| {name} | {kinds.count('ShuffleExchangeExec')} | {kinds.count('ReusedExchangeExec')} "
            f"| {joins or ''} {', '.join(sorted(grains))} | {kinds.count('WindowExec')} "
            f"| {'yes' if 'WindowGroupLimitExec' in kinds else ''} | {kinds.count('ExpandExec') or ''} "
            f"| {'YES' if re.search(r'EvalPython|InPandas|PythonUDF', text) else 'no'} |"
        )
    spark.stop()


if __name__ == "__main__":
    main()
