"""Headline tasks over one table, timed. Prints one JSON line.

The table is loaded and held in memory before the clock starts, as in the baseline, which times calls over a loaded
frame. Every task runs over all rows; each is run twice and the faster run counts, so start-up of the JVM is left out.
"""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from millrace.operators import association as A  # noqa: E402
from millrace.operators import columns as C  # noqa: E402
from millrace.operators import correlation, counts, drift, missingness, profile, quality, sampling  # noqa: E402
from millrace.plans.pipeline import build_pipeline  # noqa: E402
from millrace.plans.settings import default_settings  # noqa: E402
from millrace.session import local_session  # noqa: E402


def held(df, parts):
    df = df.repartition(parts).persist()
    df.count()
    return df


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    spark = local_session(cpus, int(cpus), "bench")
    line = held(spark.read.parquet(f"{folder}/lineitem.parquet"), int(cpus))
    orders = held(spark.read.parquet(f"{folder}/orders.parquet"), int(cpus))
    from millrace.catalog.base import VIEWS
    dirty = held(spark.sql(VIEWS["dirty_orders"], orders=orders), int(cpus))
    num, cat = C.numeric(line), C.categorical(line)
    early, late = (line.filter(f"l_shipdate {op} timestamp_ntz'1998-06-01'") for op in ("<", ">="))

    def done(df):
        df.write.format("noop").mode("overwrite").save()

    def fit():
        parts = sampling.split_frame(dirty, "status", 20, 0, key="id")
        p = build_pipeline(default_settings(), "status")
        done(p.fit_transform(parts.train))
        done(p.transform(parts.test))
        p.release()

    def compare():
        for table in drift.compare(early, late).values():
            table.collect()

    def split():
        s = sampling.assign_split(orders, "o_orderstatus", 20, 10, key="o_orderkey")
        s.write.format("noop").mode("overwrite").save()

    tasks = {
        "profile_numeric": lambda: profile.numeric_profile(line, num).collect(),
        "profile_categorical": lambda: counts.category_profile(line, cat).collect(),
        "quality_checks": lambda: quality.quality_checks(line).collect(),
        "correlations_pearson": lambda: correlation.pearson(line, num).collect(),
        "correlations_spearman": lambda: correlation.spearman(line, num).collect(),
        "mixed_associations": lambda: A.mixed_associations(line, num, cat).collect(),
        "missing_analysis": lambda: [d.collect() for d in missingness.missing_analysis(dirty).values()],
        "split": split,
        "pipeline_fit_transform": fit,
        "compare_versions": compare,
    }
    only, took = sys.argv[1:], {}
    for name, task in tasks.items():
        if only and name not in only:
            continue
        runs = []
        for _ in range(repeat):
            t0 = time.perf_counter()
            task()
            runs.append(time.perf_counter() - t0)
        took[name] = round(min(runs), 3)
        print(f"{name}: {took[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total of headline tasks, table in memory", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": os.path.basename(folder.rstrip("/")).replace("sf", ""), "rows": line.count(),
                      "rows_by_task": {k: orders.count() if k in ("missing_analysis", "split", "pipeline_fit_transform") else line.count() for k in took}}))


if __name__ == "__main__":
    main()
