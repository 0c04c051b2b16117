import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from millrace.functions import significance as S
from millrace.functions import text as X
from millrace.operators import advice, association, contract, drift, identity, missingness, profile, quality, roles, target, timeline


def test_published_tail_probabilities():
    assert abs(S.chi2_sf(3.841459, 1) - 0.05) < 1e-6
    assert abs(S.chi2_sf(18.307038, 10) - 0.05) < 1e-6
    assert abs(S.chi2_sf(124.342113, 100) - 0.05) < 1e-6
    assert abs(2 * S.normal_sf(1.959964) - 0.05) < 1e-6
    # t = 2.228139 with 10 degrees of freedom is the two-sided 5 % point
    t = 2.228139
    assert abs(S.correlation_p(t / math.sqrt(10 + t * t), 12) - 0.05) < 1e-6
    assert S.correlation_p(1.0, 30) == 0.0


def test_normality_of_normal_and_skewed(spark):
    df = spark.range(4000).select(F.randn(7).alias("n"), F.exp(F.randn(8)).alias("s"))
    shape = {r["column"]: r for r in profile.numeric_profile(df).collect()}
    assert shape["n"]["shape"].startswith("no clear") and shape["s"]["shape"] == "not normal"
    assert abs(shape["n"]["skew"]) < 0.15


def test_constant_and_empty_columns(spark):
    df = spark.range(10).select(F.lit(3.0).alias("c"), F.lit(None).cast("double").alias("e"))
    r = {x["column"]: x for x in profile.numeric_profile(df).collect()}
    assert (r["c"]["skew"], r["c"]["kurtosis"], r["c"]["outliers"]) == (0.0, 0.0, 0) and r["e"]["mean"] is None


def test_known_associations(spark):
    df = spark.range(4000).select(F.floor(F.rand(1) * 4).cast("string").alias("a"), F.floor(F.rand(2) * 4).cast("string").alias("b"),
                                  (F.rand(3) * 2 - 1).alias("x")).withColumn("same", F.col("a")).withColumn("y", F.col("x") ** 2)
    v = association.cramers(df, [("a", "same"), ("a", "b")])
    assert v[("a", "same")]["v"] > 0.999 and v[("a", "b")]["v"] < 0.06
    found = association.nonlinear_candidates(df, ["x", "y"]).collect()
    assert len(found) == 1 and abs(found[0]["pearson"]) < 0.1 and found[0]["nmi"] > 0.3


def test_vif_of_a_sum_is_infinite(spark):
    df = spark.range(500).select(F.randn(1).alias("a"), F.randn(2).alias("b")).withColumn("c", F.col("a") + F.col("b"))
    assert all(r["vif"] == math.inf for r in association.vif_table(df, ["a", "b", "c"]).collect())


def test_scores_of_columns_far_from_zero_keep_their_digits(spark):
    values = [(1e9 + (i * 7919) % 10007 / 100, 3e9 + (i * 104729) % 9973 / 100) for i in range(200_000)]
    means, stds = [], []
    for v in zip(*values):
        means.append(Fraction(sum(map(Fraction, v))) / len(v))
        stds.append(math.sqrt(sum((Fraction(x) - means[-1]) ** 2 for x in v) / (len(v) - 1)))
    df = spark.createDataFrame(values, "a double, b double").repartition(5)
    p = association.pca(df, ["a", "b"])
    sign = math.copysign(1, p["loadings"][1, 0] * p["loadings"][0, 0])
    for r in p["scores"].filter("a % 5 < 0.01").collect():
        a, b = (float(Fraction(r[c]) - means[i]) / stds[i] for i, c in enumerate("ab"))
        assert abs(r["pc1"] - (a + sign * b) / math.sqrt(2)) < 1e-12


def test_dependent_gaps_are_found(spark):
    df = spark.range(800).select((20 + F.col("id") % 60).alias("age"), F.rand(4).alias("z")).withColumn(
        "inc", F.when((F.col("age") > 45) & (F.rand(5) < 0.7), None).otherwise(F.rand(6)))
    r = {x["related_column"]: x for x in missingness.relations(df).collect()}
    assert r["age"]["suggests_dependence"] and not r["z"]["suggests_dependence"]


def test_blank_text_is_missing(spark):
    df = spark.createDataFrame([(" ",), ("",), ("5",), ("6",), ("7",)], "t string")
    assert missingness.missing_per_column(df).first()["missing"] == 2
    found = {r["id"]: r for r in advice.diagnose(df).collect()}
    assert found["numtext:t"]["evidence"]["blank values"] == 2 and found["missing:t"]["severity"] == 3


def test_quality_finds_seeded_faults(spark):
    df = spark.range(40).select(F.when(F.col("id") == 3, -3).otherwise(30).alias("age"),
                                F.when(F.col("id") == 1, "ny ").when(F.col("id") == 2, "N/A").when(F.col("id") == 4, "NY").otherwise("ny").alias("city"),
                                F.when(F.col("id") % 2 == 0, F.col("id").cast("string")).otherwise("x").alias("mix"),
                                F.lit(1).alias("one"), F.lit(None).cast("double").alias("none"))
    got = {(r["column"], r["check"]) for r in quality.quality_checks(df).collect()}
    assert {("age", "implausible negatives"), ("city", "extra spaces"), ("city", "disguised missing values"), ("city", "inconsistent spelling"),
            ("mix", "mixed types"), ("one", "constant"), ("none", "empty column"), (None, "duplicate rows")} <= got


def test_personal_data(spark):
    df = spark.createDataFrame([("a@b.example", "+49 30 1234567", "10.0.0.1", "4111 1111 1111 1111", "2024-01-05", "Ann")] * 5,
                               "mail string, tel string, ip string, card string, day string, FirstName string")
    got = {(r["column"], r["looks_like"]) for r in quality.pii_scan(df).collect()}
    assert {("mail", "email"), ("tel", "phone number"), ("ip", "IP address"), ("card", "card number")} <= got
    assert ("FirstName", "column name suggests personal data") in got and not any(c == "day" for c, _ in got)
    text = spark.createDataFrame([("write to a.b@c.example or 4111 1111 1111 1111",)], "t string")
    assert quality.redacted(text, ["t"]).first()["t"] == "write to [email] or [number]"
    assert [r[0] for r in spark.createDataFrame([("4111111111111112",), ("123",)], "c string").select(X.luhn(F.col("c"))).collect()] == [False, False]


def test_roles(spark):
    df = spark.range(120).select(
        F.format_string("C%04d", F.col("id")).alias("CustomerID"), F.format_string("0%04d", F.col("id") % 40).alias("PostalCode"),
        F.format_string("%d.5", F.col("id")).alias("Charges"), F.element_at(F.array(F.lit("low"), F.lit("Medium"), F.lit("high")), (F.col("id") % 3 + 1).cast("int")).alias("Size"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("Joined"),
        (F.col("id") % 2).alias("Flag"), (F.rand(1) * 60).alias("Age"), F.col("id").alias("row"), F.when(F.col("id") % 2 == 0, "yes").otherwise("no").alias("y"))
    got = roles.infer_roles(df, "y", order_by="row")
    assert {c: g["type"] for c, g in got.items()} == {
        "CustomerID": "id", "PostalCode": "categorical", "Charges": "continuous", "Size": "ordinal", "Joined": "datetime", "Flag": "categorical",
        "Age": "continuous", "row": "id", "y": "target"}
    assert got["Size"]["order"] == ["low", "medium", "high"]
    shuffled = df.withColumn("row", (F.col("row") * 37) % 120).withColumn("o", F.col("Age"))
    assert roles.infer_roles(shuffled, "y", order_by="o")["row"]["type"] == "continuous"


def test_contract_faults(spark):
    good = spark.range(30).select(F.format_string("C%02d", "id").alias("CustomerID"), (20 + F.col("id")).alias("Age"),
                                  F.element_at(F.array(*map(F.lit, "abc")), (F.col("id") % 3 + 1).cast("int")).alias("Type"))
    k = contract.infer_contract(good)
    assert k["columns"]["CustomerID"]["unique"] and k["columns"]["Age"]["min"] == 20.0 and k["columns"]["Type"]["allowed"] == ["a", "b", "c"]
    assert contract.validate(good, k).status == "passed"
    bad = good.select(F.when(F.col("Age") == 21, "C00").otherwise(F.col("CustomerID")).alias("CustomerID"),
                      F.when(F.col("Age") == 30, "old").when(F.col("Age") == 31, "500").otherwise(F.col("Age").cast("string")).alias("Age"),
                      F.when(F.col("Age") == 40, "z").otherwise(F.col("Type")).alias("Typ"))
    r = contract.validate(bad, k)
    got = {(x["column"], x["rule"]): x for x in r.issues.collect()}
    assert r.status == "failed" and got[("Age", "type")]["count"] == 1 and got[("Age", "max")]["count"] == 1 and got[("CustomerID", "unique")]["count"] == 2
    assert "`Typ`" in got[("Type", "exists")]["message"]
    assert contract.examples(r, "Age", "max", "CustomerID") == ["C11"]


def test_drift_pair(spark):
    a = spark.range(500).select((F.randn(1) * 5 + 35).alias("age"), F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("city"), F.lit(1.0).alias("k"))
    b = spark.range(500).select((F.randn(2) * 5 + 55).alias("age"), F.when(F.col("id") % 3 == 0, "new").otherwise("x").alias("city"), F.lit(1).alias("extra"))
    flags = {(r["kind"], r["column"]) for r in drift.drift_flags(a, b).collect()}
    assert flags == {("numeric drift", "age"), ("new categories", "city"), ("column added", "extra"), ("column removed", "k")}
    assert drift.correlation_change(a, a).count() == 0


def test_seasonal_series(spark):
    df = spark.range(300).select(F.timestamp_seconds(F.col("id") * 86400).alias("t"), (F.col("id") * 0.05 + F.sin(F.col("id") * 2 * math.pi / 7) * 3).alias("v"), "id")
    r = target.analyze_target(df, "v", "Time-series forecasting", time_col="t", tie="id")
    assert 7 in r["seasonal_lags"]
    assert {"trend", "not stationary"} <= {x["flag"] for x in r["flags"].collect()}
    hole = df.filter("id < 50 and not (id between 20 and 29)")
    p = timeline.time_profile(hole, "t").first()
    assert (p["irregular"], p["empty_periods"], p["period"]) == (1, 10, "D")


def test_classification_flags(spark):
    df = spark.range(600).select(F.when(F.col("id") % 12 == 0, "rare").otherwise("usual").alias("y"), F.rand(1).alias("x")).withColumn(
        "leak", F.when(F.col("y") == "rare", 1.0).otherwise(0.0) + F.rand(2) * 0.01)
    flags = {(r["flag"], r["item"]) for r in target.classification(df, "y")["flags"].collect()}
    assert ("imbalanced", "y") in flags and ("possible leakage", "leak") in flags and ("possible leakage", "x") not in flags


def test_readiness_score(spark):
    df = spark.range(100).select("id", F.rand(1).alias("x"), (F.col("id") % 2).alias("y"))
    score, checks = advice.readiness(df, "y", split_done=True, train=df, leakage=[])
    assert score == 100 and checks.filter("not passed").count() == 0
    assert advice.readiness(df.withColumn("t", F.lit("a")), "y")[0] < 70


def test_fingerprints(spark):
    df = spark.range(300).select("id", (F.col("id") % 7).cast("string").alias("s"))
    same = df.repartition(7).orderBy(F.desc("id"))
    assert identity.content_fingerprint(df) == identity.content_fingerprint(same) and identity.fingerprint(df) == identity.fingerprint(same)
    changed = df.withColumn("s", F.when(F.col("id") == 123, "changed").otherwise(F.col("s")))
    assert identity.content_fingerprint(changed) != identity.content_fingerprint(df)
    swapped = spark.createDataFrame([(1, None), (None, 1)], "a long, b long"), spark.createDataFrame([(None, 1), (None, 1)], "a long, b long")
    assert identity.content_fingerprint(swapped[0]) != identity.content_fingerprint(swapped[1])


def test_narrow_types(spark):
    df = spark.createDataFrame([(1, 300, 2 ** 40, 0.5), (-5, 7, 1, 0.25)], "a bigint, b bigint, c bigint, d double")
    out, changes = identity.narrow_types(df, float32=True)
    assert dict(out.dtypes) == {"a": "tinyint", "b": "smallint", "c": "bigint", "d": "float"} and changes.count() == 3
    assert [tuple(r) for r in out.collect()] == [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("cut", [2, 5])
def test_profile_merges_exactly(spark, cut):
    from millrace.operators import running
    df = spark.range(1000).select(F.when(F.col("id") % 11 != 0, F.randn(1) * 3 + 1e6).alias("x"), "id").persist()
    r = running.merged_numbers(running.number_partials(df, ["x"], F.col("id") % cut)).first()
    w = df.agg(F.avg("x"), F.stddev("x"), F.count("x")).first()
    assert abs(r["mean"] - w[0]) < 1e-6 and abs(r["std"] - w[1]) < 1e-9 and r["missing"] == 1000 - w[2]
