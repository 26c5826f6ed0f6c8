"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints ONE JSON line.

error features, the J1 merge of both, M17 predictions, the M19 grid and M28 importance.  Each
query is fully executed (written to a no-op sink); times are wall-clock seconds of one run on a
fresh DataFrame, `docs_per_sec` the documents of the input over them.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from proflex.session import build_session  # noqa: E402


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(cpus, int(cpus) if cpus.isdigit() else 8)
    from proflex.plans.corpus import read_table
    from proflex.plans.registry import QUERIES

    names = ["t1_tokens", "a31_feature_table", "e11_error_feature_table", "j1_merged_features",
             "m17_h1_predictions", "m19_cv_grid", "m28_m29_permutation_importance"]
    docs = read_table(spark, sf_dir, "documents").count()
    times = {}
    for name in names:
        t0 = time.time()
        run(QUERIES[name](spark, sf_dir))
        times[name] = round(time.time() - t0, 3)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec",
                      "queries": times, "docs_per_sec": {n: round(docs / t, 1) for n, t in times.items()},
                      "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
