"""How the work of a task grows with the rows: the slope of the logarithm of its rows read and shuffled over that of the rows.

Time depends on the machine and on what else runs; rows read and rows shuffled belong to the plan. A slope of 1 is linear, 0
does not depend on the table, 2 is quadratic.
"""
from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.profile import small_table
from millrace.operators.sampling import hash_order
from millrace.session import stored

SHARES = (0.25, 0.5, 1.0)
WORK = "task string, share double, rows long, rows_read long, rows_shuffled long, seconds double"


def nested_samples(df: DataFrame, key, shares=SHARES, seed: int = 0) -> dict[float, DataFrame]:
    """Shares of the table by the hash of the key; a smaller one lies inside each larger one."""
    place = F.conv(F.substring(hash_order(key, seed), 1, 8), 16, 10).cast("double") / 2 ** 32
    return {share: df if share >= 1 else df.filter(place < share) for share in shares}


def work_of(spark: SparkSession, task, part: DataFrame) -> tuple[int, int]:
    """Rows read from tables and rows written to shuffles by the stages of all jobs that task(part) starts."""
    sc = spark.sparkContext
    group, before = f"growth-{uuid.uuid4().hex}", sc.getLocalProperty("spark.jobGroup.id")
    sc.setJobGroup(group, "growth measurement")
    try:
        task(part)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", before)
        sc.setLocalProperty("spark.job.description", None)
    core = sc._jsc.sc()
    core.listenerBus().waitUntilEmpty()
    tracker, store = sc.statusTracker(), core.statusStore()
    ran: set[int] = set()
    for j in tracker.getJobIdsForGroup(group):
        ids = list(tracker.getJobInfo(j).stageIds)
        known = [s for s in ids if tracker.getStageInfo(s) is not None]
        if len(ids) - len(known) > store.job(j).numSkippedStages():
            raise RuntimeError("the session keeps too few stages for this task; raise spark.ui.retainedStages")
        ran.update(known)
    stages = [store.lastStageAttempt(s) for s in sorted(ran)]
    return sum(s.inputRecords() for s in stages), sum(s.shuffleWriteRecords() for s in stages)


def measure(df: DataFrame, tasks: dict, key, shares=SHARES, seed: int = 0) -> DataFrame:
    """(task, share, rows, rows_read, rows_shuffled, seconds) of every task over nested shares, each written as a table first."""
    rows = []
    for share, part in nested_samples(df, key, shares, seed).items():
        part = stored(part, "growth")
        n = part.count()
        for name, task in tasks.items():
            t0 = time.perf_counter()
            read, shuffled = work_of(df.sparkSession, task, part)
            rows.append({"task": name, "share": float(share), "rows": n, "rows_read": read, "rows_shuffled": shuffled, "seconds": time.perf_counter() - t0})
    return small_table(df.sparkSession, rows, WORK)


def growth_exponents(timings: DataFrame) -> DataFrame:
    """time ~ rows^exponent per task."""
    return timings.groupBy("task").agg(F.regr_slope(F.log("seconds"), F.log(F.col("rows").cast("double"))).alias("exponent"), F.count("*").alias("points"))


def growth_slopes(work: DataFrame) -> DataFrame:
    """Per task, by least squares: rows read ~ rows^read_slope and rows shuffled ~ rows^shuffle_slope; samples without rows are left out."""
    def slope(c):
        return F.regr_slope(F.log(F.greatest(F.col(c).cast("double"), F.lit(1.0))), F.log(F.col("rows").cast("double")))
    return (work.filter("rows > 0").groupBy("task")
            .agg(F.count("*").alias("points"), slope("rows_read").alias("read_slope"), slope("rows_shuffled").alias("shuffle_slope")))
