"""Print the physical plan of headline queries (operator tree, exchanges, scan schemas).

    python tools/explain_plans.py [sf_dir] [query ...]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or ["a31_feature_table", "e11_error_feature_table"]
    from proflex.plans.registry import QUERIES
    from proflex.session import build_session
    spark = build_session(8, 8)
    for name in names:
        df = QUERIES[name](spark, sf_dir)
        plan = df._jdf.queryExecution().executedPlan().toString()
        print(f"==== {name}")
        for line in plan.splitlines():
            if re.search(r"Exchange|Aggregate|Join|Generate|Scan|Window|ArrowEval|BatchEval|TakeOrdered|Sort\b", line):
                print(line[:220])
        print("exchanges:", len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", plan)),
              "reused:", plan.count("ReusedExchange"))


if __name__ == "__main__":
    main()
