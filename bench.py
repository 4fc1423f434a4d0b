"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = {
    "findings_lineitem": "flagship",
    "duplicate_rows": "det_02_duplicate_rows",
    "bad_dates": "det_05_bad_dates",
    "formula_search": "det_11_formula_search",
    "outliers_iqr": "det_16_outliers_iqr",
    "winsorize": "act_05_winsorize",
    "clean_customers": "act_01_apply_defaults",
    "unify_dates": "gui_09_dates_one_format",
    "limits_clip": "gui_13_limits_clip",
    "merge_audit": "jn_12_run_merge",
    "collapse_by_key": "jn_08_collapse_by_key",
    "summary": "agg_02_numeric_summary",
    "spearman": "agg_05_correlation_spearman",
    "computed_columns": "agg_09_computed_columns",
    "fold_documents": "fn_10_fold",
    "dictionary": "dic_01_dictionary",
}


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    import registry
    from sparkscrub.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    runs = {**registry.QUERIES, "flagship": registry.flagship}
    for warm in ("det_01_missing", "fn_12_unify_dates"):  # JVM and Python worker start-up
        runs[warm](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for label, name in HEADLINE.items():
        start = time.perf_counter()
        runs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[label] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
