import collections
import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import leakage, sampling
from millrace.plans import lab, spec, steps
from millrace.plans.pipeline import Pipeline, SchemaMismatch, build_pipeline
from millrace.plans.settings import default_settings, merged


def frame(spark, n=120):
    return spark.range(n).select(
        "id", F.when(F.col("id") % 9 != 0, F.col("id") * 1.5).alias("age"), F.exp(F.col("id") % 7).alias("income"),
        F.element_at(F.array(*map(F.lit, "abc")), (F.col("id") % 3 + 1).cast("int")).alias("city"),
        F.when(F.col("id") % 4 == 0, "yes").otherwise("no").alias("y"))


def values(df, c):
    return [r[c] for r in df.collect()]


def test_statistics_come_from_train_only(spark):
    train = spark.createDataFrame([(1.0,), (3.0,), (None,)], "x double")
    other = spark.createDataFrame([(None,), (100.0,)], "x double")
    assert values(steps.Imputer(num_missing="Mean").fit(train).transform(other), "x") == [2.0, 100.0]
    scaler = steps.Scaler(method="Min-max (0 to 1)", cols=["x"]).fit(train.dropna())
    assert values(scaler.transform(other), "x") == [None, 49.5]


def test_unfitted_step_and_pipeline_refuse(spark):
    with pytest.raises(steps.NotFitted):
        steps.Scaler().transform(spark.range(3).toDF("x"))
    with pytest.raises(steps.NotFitted):
        build_pipeline(default_settings()).transform(spark.range(3).toDF("x"))


def test_rows_are_removed_from_train_only(spark):
    df = spark.createDataFrame([(float(i), "a") for i in range(30)] + [(9999.0, "a"), (9999.0, "a"), (None, "b")], "x double, c string")
    out = steps.Outliers(outliers="Remove rows with outliers (IQR)", out_cols=["x"]).fit(df)
    assert out.transform(df, training=True).count() == 31 and out.transform(df).count() == 33
    drop = steps.Imputer(num_missing="Drop rows").fit(df)
    assert drop.transform(df, training=True).count() == 32 and drop.transform(df).count() == 33
    clean = steps.TextCleanup().fit(df)
    assert clean.transform(df, training=True).count() == 32 and clean.transform(df).count() == 33


def test_clip_keeps_large_integers(spark):
    big = 2 ** 53
    df = spark.createDataFrame([(big + i,) for i in (0, 1, 2, 3)], "x bigint")
    step = steps.Outliers(outliers="Clip to IQR bounds", out_cols=["x"])
    step.fit(df)
    step.state = {"bounds": {"x": [float(big - 10), float(big + 10)]}}
    assert values(step.transform(df), "x") == [big, big + 1, big + 2, big + 3]


def test_unseen_categories(spark):
    train = spark.createDataFrame([("a",), ("b",), ("c",)], "c string")
    new = spark.createDataFrame([("b",), ("z",), (None,)], "c string")
    hot = steps.Encoder().fit(train)
    assert hot.transform(new).columns == ["c_b", "c_c"]
    assert [tuple(r) for r in hot.transform(new).collect()] == [(1, 0), (0, 0), (0, 0)]
    assert hot.problems(new) == ["`c`: 1 value(s) with a category not seen in training"]
    assert values(steps.Encoder(low="Ordinal").fit(train).transform(new), "c") == [1.0, -1.0, None]


def test_category_order_is_by_text(spark):
    df = spark.createDataFrame([("10",), ("2",), ("1",)], "c string")
    assert list(steps.Encoder(low="Ordinal").fit(df).state["low"]["c"]) == ["1", "10", "2"]


def test_large_mappings_live_in_a_table(spark, monkeypatch):
    monkeypatch.setattr(steps, "STATE_LIMIT", 5)
    df = spark.range(60).select(F.format_string("k%02d", F.col("id") % 20).alias("c"))
    step = steps.Encoder(high="Frequency", max_onehot=3).fit(df)
    assert "table" in step.state["high"]["c"]
    assert set(values(step.transform(df), "c")) == {0.05}
    assert values(step.transform(spark.createDataFrame([("new",), (None,)], "c string")), "c") == [0.0, None]


def test_text_cleanup(spark):
    df = spark.createDataFrame([("  o'neil a-b yORK 3rd ", " 1.5"), ("\t", " "), (None, "3")], "t string, n string")
    out = steps.TextCleanup(case="Title Case", dups=False).fit(df)
    assert [tuple(r) for r in out.transform(df).collect()] == [("O'Neil A-B York 3Rd", 1.5), (None, None), (None, 3.0)]
    late = spark.createDataFrame([("x", "1d")], "t string, n string")
    assert values(out.transform(late), "n") == [None]
    assert out.problems(late) == ["`n`: 1 value(s) were not numeric and became missing"]


def test_role_caster(spark):
    df = spark.createDataFrame([(1.0, "Low ", "2024-01-05", "7"), (2.5, "high", "05/01/2024", "x")], "code double, size string, d string, n string")
    step = steps.RoleCaster(types={"code": "categorical", "size": "ordinal", "d": "datetime", "n": "continuous"}, orders={"size": ["low", "high"]})
    rows = step.fit(df).transform(df).collect()
    assert [r["code"] for r in rows] == ["1", "2.5"] and [r["size"] for r in rows] == [0.0, 1.0]
    assert rows[0]["d"].year == 2024 and [r["n"] for r in rows] == [7.0, None]
    assert len(step.problems(df)) == 1


def test_pipeline_same_columns_everywhere_and_reload(spark):
    df = frame(spark)
    parts = sampling.split_frame(df, "y", 20, 20, key="id")
    cfg = merged(default_settings(), {"Transform": {"skew": True, "corr": 0.999, "outliers": "Clip to IQR bounds"}})
    p = build_pipeline(cfg, "y")
    train = p.fit_transform(parts.train)
    outs = [train, p.transform(parts.val), p.transform(parts.test)]
    assert len({tuple(o.columns) for o in outs}) == 1
    assert all(t in ("double", "int", "bigint") for _, t in train.dtypes)
    back = Pipeline.from_state(json.loads(json.dumps(p.state())))
    assert sorted(map(tuple, back.transform(parts.test).collect())) == sorted(map(tuple, outs[2].collect()))
    assert p.transform(parts.test.drop("y")).columns == [c for c in train.columns if c != "y"]
    with pytest.raises(SchemaMismatch):
        p.transform(parts.test.drop("age"))
    p.release()


def test_saved_state_is_checked(spark):
    p = build_pipeline({}, None)
    p.fit_transform(frame(spark))
    state = p.state()
    for bad in ({**state["steps"][0], "class": "os.system"}, {**state["steps"][0], "extra": 1}):
        with pytest.raises(ValueError):
            Pipeline.from_state({**state, "steps": [bad]})
    text = spec.dumps(spec.make_spec(p, {}, {}, frame(spark)))
    assert spec.loads(text)["version"] == 1
    for broken in ("{", "[]", text.replace(spec.FORMAT, "other"), text.replace('"version": 1', '"version": 9')):
        with pytest.raises(spec.SpecError):
            spec.loads(broken)


def test_contract_guards_saved_pipeline(spark):
    df = frame(spark)
    p = build_pipeline(default_settings(), "y")
    p.fit_transform(df)
    s = spec.make_spec(p, default_settings(), {"seed": 1, "key": "id", "balance": "Oversample minority"}, df)
    report, out = spec.checked_apply(s, df.withColumn("city", F.lit("elsewhere")))
    assert report.status == "failed" and out is None
    report, out = spec.checked_apply(s, df)
    assert report.status == "warnings" and out.count() == 120     # the target is an extra column
    parts = spec.refit(s, df)
    assert {r["count"] for r in parts["train"].groupBy("y").count().collect()} == {72}
    p.release()


def test_split_sizes_disjoint_and_stable(spark):
    df = frame(spark, 200)
    one = sampling.assign_split(df, "y", 20, 10, key="id")
    two = sampling.assign_split(df.repartition(9), "y", 20, 10, key="id")
    assert sorted(map(tuple, one.select("id", "_split").collect())) == sorted(map(tuple, two.select("id", "_split").collect()))
    sizes = {(r["y"], r["_split"]): r["count"] for r in one.groupBy("y", "_split").count().collect()}
    assert sizes[("yes", "test")] == 10 and sizes[("no", "test")] == 30 and sizes[("yes", "val")] == 5
    with pytest.raises(ValueError):
        sampling.split_frame(df, None, 0, key="id")


def test_copies_are_split_like_rows(spark):
    df = spark.createDataFrame([("same", 1)] * 60 + [(f"row{i}", i) for i in range(40)], "k string, v long")
    placed = sampling.assign_split(df, None, 25)
    sizes = {r["_split"]: r["count"] for r in placed.groupBy("_split").count().collect()}
    assert sizes == {"train": 75, "test": 25}
    assert placed.filter("k = 'same'").select("_split").distinct().count() == 2
    parts = sampling.split_frame(df, None, 25)
    assert leakage.row_overlap(parts.train, parts.test).first()[0] > 0


def test_balance_sample_and_folds(spark):
    df = frame(spark, 200)
    for how, n in (("Oversample minority", 150), ("Undersample majority", 50)):
        assert {r["count"] for r in sampling.balance_train(df, "y", how, key="id").groupBy("y").count().collect()} == {n}
    assert sampling.sample_rows(df, 37, key="id").count() == 37 and sampling.sample_rows(df, 999, key="id").count() == 200
    rare = spark.range(5000).withColumn("y", F.when(F.col("id") < 60, "rare").otherwise("usual"))
    s = {r["y"]: r["count"] for r in sampling.class_sample(rare, 1000, "y", key="id").groupBy("y").count().collect()}
    assert s["rare"] == 50
    counts = [r["count"] for r in sampling.folds(df, 4, target="y", key="id").groupBy("_fold", "y").count().collect()]
    assert len(counts) == 8 and max(counts) - min(c for c in counts if c > 20) <= 1


def test_target_copy_is_found(spark):
    df = frame(spark).withColumn("num", F.col("id") * 1.0).withColumn("copy", F.col("id") * 2.0)
    assert [c for c, _ in leakage.suspicious_features(df.select("num", "copy", "income"), "num")] == ["copy"]


def test_lab_reports_a_failing_variant(spark):
    df = frame(spark, 150)
    base = merged(default_settings(), {"Types": {"types": {"id": "id"}}})
    broken = merged(base, {"Encode": {"dates": True}})
    broken.pop("Encode")
    r = lab.run_lab(df, "y", {"fine": base, "broken": broken}, folds=2, key="id")
    table = {x["variant"]: x for x in r["table"].collect()}
    assert table["fine"]["verdict"] == "baseline" and table["fine"]["failed_folds"] == 0
    assert table["broken"]["failed_folds"] == 2 and table["broken"]["verdict"] is None


def test_values_of_long_columns_are_counted_once(spark, monkeypatch):
    """Sizes, lists and codes are read off one table of counts, and codes need no second sort of the texts."""
    df = spark.range(300).select(F.concat(F.lit("name-"), F.col("id") % 70).alias("many"), F.concat(F.lit("c"), F.col("id") % 3).alias("few"))
    calls, real = [], steps.value_counts
    monkeypatch.setattr(steps, "STATE_LIMIT", 20)
    monkeypatch.setattr(steps, "value_counts", lambda *a: calls.append(a[1]) or real(*a))
    monkeypatch.setattr(steps, "distinct_counts", lambda *a: pytest.fail("values are counted again"))
    step = steps.Encoder(high="Ordinal").fit(df)
    assert calls == [["many", "few"]]
    order = {v: float(i) for i, v in enumerate(sorted({f"name-{i}" for i in range(70)}))}
    rows = step.transform(df.unionByName(spark.createDataFrame([("new", "c1"), (None, None)], df.schema))).collect()
    assert collections.Counter(r["many"] for r in rows) == collections.Counter([*(order[f"name-{i % 70}"] for i in range(300)), -1.0, None])
    plan = steps.text_codes(df.select(F.col("many").alias("k")).distinct())._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan
