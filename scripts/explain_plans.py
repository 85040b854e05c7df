"""Write ``explain("formatted")`` of the headline queries to docs/plans/<query>.txt
and print a one-line summary per query (exchanges, joins, pushed filters).

    python scripts/explain_plans.py [sf_dir] [query ...]
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from bench import HEADLINE  # noqa: E402
from hemicycle.queries import QUERIES  # noqa: E402
from hemicycle.session import get_spark  # noqa: E402


def main() -> None:
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.1"
    names = [a for a in args if not a.startswith("/")] or HEADLINE
    spark = get_spark()
    out_dir = os.path.join(ROOT, "docs", "plans")
    os.makedirs(out_dir, exist_ok=True)
    for name in names:
        df = QUERIES[name](spark, sf_dir)
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain("formatted")
        text = buf.getvalue()
        with open(os.path.join(out_dir, f"{name}.txt"), "w") as fh:
            fh.write(text)
        ops = {k: len(re.findall(rf"\b{k}\b \(\d+\)", text)) for k in
               ("Exchange", "BroadcastExchange", "SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin",
                "BroadcastNestedLoopJoin", "CartesianProduct", "WindowGroupLimit", "ArrowEvalPython",
                "MapInPandas", "HashAggregate")}
        pushed = sorted(set(re.findall(r"PushedFilters: (\[[^\]]+\])", text)))
        print(name, {k: v for k, v in ops.items() if v}, "pushed:", pushed)


if __name__ == "__main__":
    main()
