"""The driver contract, and a few registered queries against their SQL. tests/oracle_check.py runs all of them."""
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from oracle_check import compare, connect


def test_entry_and_names(spark):
    df = entry.entry(spark)
    assert df.count() == 6 and df.columns[:2] == ["column", "count"]
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 150


@pytest.mark.parametrize("name", ["d1_numeric_profile_dirty", "b15_clip_iqr", "k3_pipeline_transform", "g1_split_stratified", "e5_nmi_gaps",
                                  "h5_numeric_drift", "j8_bad_rows", "l7_stream_profile", "f6_autocorrelation"])
def test_query_equals_sql(spark, folder, name):
    text, good = compare(spark, connect(folder), folder, name, entry.queries(), entry.oracle_sql())
    assert good, text


def test_target_analysis_uses_all_rows(spark, folder):
    text, good = compare(spark, connect(folder), folder, "k16_analyze_target", entry.queries(), entry.oracle_sql())
    assert good, text


def test_growth_exponents(spark):
    from millrace.plans import scaling
    rows = [("t", n, 1e-5 * n ** 1.5) for n in (100, 1000, 10000)]
    r = scaling.growth_exponents(spark.createDataFrame(rows, "task string, rows long, seconds double")).first()
    assert abs(r["exponent"] - 1.5) < 1e-9
    t = scaling.measure(spark.range(2000), {"count": lambda d: d.count()}, "id")
    assert {r["task"] for r in t.collect()} == {"count"} and t.count() == 3


def test_growth_of_work(spark):
    """Rows read and shuffled come from the stages of the task, over nested samples; slopes are those of the plan."""
    from millrace.plans import scaling
    df = spark.range(4000).withColumn("g", F.col("id") % 3)
    parts = scaling.nested_samples(df, "id")
    ids = {k: {r["id"] for r in p.collect()} for k, p in parts.items()}
    assert ids[0.25] < ids[0.5] < ids[1.0] and len(ids[1.0]) == 4000 and 800 < len(ids[0.25]) < 1200
    tasks = {"keys": lambda d: d.groupBy("id").count().collect(), "twice": lambda d: (d.groupBy("id").count().collect(), d.agg(F.sum("g")).collect())}
    work = scaling.measure(df, tasks, "id")
    for r in work.collect():
        assert r["rows"] == len(ids[r["share"]]) and r["rows_read"] == r["rows"] * (1 if r["task"] == "keys" else 2)
        assert r["rows_shuffled"] == r["rows"] if r["task"] == "keys" else r["rows_shuffled"] > r["rows"]
    slopes = {r["task"]: r for r in scaling.growth_slopes(work).collect()}
    assert abs(slopes["keys"]["read_slope"] - 1) < 1e-9 and abs(slopes["keys"]["shuffle_slope"] - 1) < 1e-9 and slopes["keys"]["points"] == 3
    assert scaling.growth_slopes(scaling.measure(df.filter("false"), tasks, "id")).count() == 0
