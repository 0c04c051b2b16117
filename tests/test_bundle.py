"""A saved pipeline as one folder: it moves, it is whole or not there, and its contract comes first."""
import json
import shutil

import pytest
from pyspark.sql import functions as F

from millrace.plans import bundle, spec, steps
from millrace.plans.pipeline import build_pipeline

CFG = {"Types": {"types": {"size": "ordinal"}}, "Clean": {"dups": False}, "Encode": {"high": "Ordinal", "max_onehot": 3}}


@pytest.fixture()
def fitted(spark, monkeypatch):
    monkeypatch.setattr(steps, "STATE_LIMIT", 5)
    df = spark.range(90).select(F.format_string("k%02d", F.col("id") % 30).alias("c"), F.format_string("S %02d", F.col("id") % 12).alias("size"), (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 2).alias("y"))
    p = build_pipeline(CFG, "y")
    p.fit_transform(df)
    p.release()
    return df, spec.make_spec(p, CFG, {}, df)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_bundle_moves_and_needs_nothing_outside(spark, fitted, tmp_path):
    df, made = fitted
    want = rows(spec.apply_saved(made, df))
    bundle.save_bundle(spark, made, str(tmp_path / "a"))
    shutil.copytree(tmp_path / "a", tmp_path / "b")
    back = bundle.load_bundle(spark, str(tmp_path / "b"))
    assert {p["table"] for p in bundle._tables(back["pipeline_state"], [])} == {str(tmp_path / "b" / "tables" / i) for i in ("0", "1")}
    out = spec.apply_saved(back, df)
    assert rows(out) == want and len({r[0] for r in want}) == 30
    assert all(f"{tmp_path}/b/" in f for f in out.inputFiles())
    with pytest.raises(Exception, match="(?i)exist"):
        bundle.save_bundle(spark, made, str(tmp_path / "a"))


def test_unpublished_or_damaged_bundles_are_refused(spark, fitted, tmp_path):
    df, made = fitted
    with pytest.raises(bundle.BundleError, match="no published"):
        bundle.load_bundle(spark, str(tmp_path / "none"))
    whole = str(tmp_path / "whole")
    bundle.save_bundle(spark, made, whole)
    tables = str(tmp_path / "unpublished")
    shutil.copytree(f"{whole}/tables", f"{tables}/tables")
    with pytest.raises(bundle.BundleError, match="no published"):
        bundle.load_bundle(spark, tables)
    cut = str(tmp_path / "cut")
    shutil.copytree(f"{whole}/manifest", f"{cut}/manifest")
    with pytest.raises(bundle.BundleError, match="cannot be read"):
        bundle.load_bundle(spark, cut)
    for name in ("0", "1"):
        spark.read.parquet(f"{whole}/tables/{name}").withColumn("v", F.col("v") + (1 if name == "1" else 0)).write.parquet(f"{cut}/tables/{name}")
    with pytest.raises(bundle.BundleError, match="not the table that was saved"):
        bundle.load_bundle(spark, cut)
    assert bundle.load_bundle(spark, cut, check_tables=False)["format"] == spec.FORMAT
    text = json.loads(spark.read.text(f"{whole}/manifest").first()[0])
    text["spec"] = text["spec"].replace('"k', '"q', 1)
    spark.createDataFrame([(json.dumps(text),)], "value string").write.text(str(tmp_path / "edited" / "manifest"))
    with pytest.raises(bundle.BundleError, match="damaged"):
        bundle.load_bundle(spark, str(tmp_path / "edited"))


def test_contract_comes_first(spark, fitted):
    df, made = fitted
    assert spec.apply_saved(made, df).count() == 90
    bad = df.withColumn("x", F.col("x") + 100)
    with pytest.raises(spec.ContractBroken) as e:
        spec.apply_saved(made, bad)
    assert [(r["column"], r["rule"], r["count"]) for r in e.value.report.issues.filter("level = 'error'").collect()] == [("x", "max", 90)]
    assert spec.apply_saved({**made, "input_contract": None}, bad).count() == 90
    assert spec.transform_saved(made, bad).count() == 90


def test_ordinal_scale_of_many_labels_is_a_table(spark, fitted):
    df, made = fitted
    caster = next(s for s in made["pipeline_state"]["steps"] if s["class"] == "RoleCaster")
    assert "table" in caster["learned"]["ranks"]["size"]
    step = steps.RoleCaster(types={"size": "ordinal"}).fit(df)
    got = {r["size"] for r in step.transform(df).select("size").collect()}
    assert got == {float(i) for i in range(12)}
    assert step.problems(df.withColumn("size", F.lit("S 99"))) == ["`size`: 90 value(s) are not in the learned order and became missing"]
