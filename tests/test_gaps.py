"""Models that accept gaps: fills, flags and branches against plain Python, and the model comparison with gaps left."""
import math
import statistics

import pytest

from millrace.plans import lab
from millrace.plans.gaps import Gaps, beyond

ROWS = [(1.0, 4, None, None), (None, 6, 2.5, None), (float("nan"), None, -1.0, None), (5.0, 8, 1e300, None), (3.0, 9, -1e300, None)]
SCHEMA = "a double, b int, c double, empty double"


def rows_of(gaps, df):
    return [tuple(r) for r in df.select(*gaps.columns(df)).collect()]


def test_indicator_fills_training_medians(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    gaps = Gaps.fit(df, ["a", "b", "c", "empty"], "indicator")
    mid = {"a": statistics.median([1, 5, 3]), "b": statistics.median([4, 6, 8, 9]), "c": statistics.median([2.5, -1.0, 1e300, -1e300]), "empty": 0.0}
    gone = lambda v: v is None or v != v
    want = [tuple(float(mid[n] if gone(v) else v) for n, v in zip(mid, r)) + tuple(float(gone(v)) for v in r) for r in ROWS]
    assert sorted(rows_of(gaps, df)) == sorted(want)


def test_branch_gives_gaps_below_and_above(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    gaps = Gaps.fit(df, ["a", "c"], "branch")
    for low_a, high_a, low_c, high_c in rows_of(gaps, df):
        assert (low_a == high_a and 1 <= low_a <= 5) or (low_a < 1 and high_a > 5)
        assert (low_c == high_c) or (low_c < -1e300 and high_c > 1e300)
    assert all(math.isfinite(v) for pair in gaps.fills.values() for v in pair)
    assert beyond(-1.7e308, 1.7e308) != beyond(None, None) == (0.0, 0.0)


def test_gaps_that_appear_later_and_no_columns(spark):
    train = spark.createDataFrame([(1.0,), (2.0,), (6.0,)], "a double")
    later = spark.createDataFrame([(None,), (float("nan"),), (4.0,)], "a double")
    for how in ("indicator", "branch"):
        assert sorted(rows_of(Gaps.fit(train, ["a"], how), later)) == [(3.0,), (3.0,), (4.0,)]
    assert Gaps.fit(train, [], "branch").columns(train) == []
    with pytest.raises(ValueError):
        Gaps.fit(train, ["a"], "guess")


@pytest.mark.parametrize("model", ["Logistic regression", "Gradient boosting"])
def test_left_gaps_carry_what_they_say(spark, model):
    """The class is told by the gap alone, which a median hides and a left gap shows."""
    df = spark.createDataFrame([(i, None if i % 3 == 0 else float(i % 7), "high" if i % 3 == 0 else "low") for i in range(240)], "id int, x double, y string")
    variants = lab.variants_for("Missing numbers", ["Median", lab.LEFT], roles={"types": {"id": "id"}})
    r = lab.run_lab(df, "y", variants, model, folds=2, key="id")
    means = {x["variant"]: (x["mean"], x["failed_folds"]) for x in r["table"].collect()}
    assert means[lab.LEFT][1] == 0 and means[lab.LEFT][0] > 0.99


def test_variants_of_a_fold_share_their_first_steps(spark, monkeypatch):
    """The steps before the one that varies are fitted once for each fold, tasks follow the rows, and the scores stay those of a variant alone."""
    from millrace.plans import steps
    learned, plain = [], steps.TextCleanup.learn
    monkeypatch.setattr(steps.TextCleanup, "learn", lambda self, df: learned.append(df.rdd.getNumPartitions()) or plain(self, df))
    df = spark.createDataFrame([(i, None if i % 5 == 0 else float(i % 11), "high" if i % 3 == 0 else "low") for i in range(150)], "id int, x double, y string").repartition(7)
    variants = lab.variants_for("Missing numbers", ["Mean", "Drop rows"], roles={"types": {"id": "id"}})
    order = ("variant", "fold", "metric", "score")
    whole = lab.run_lab(df, "y", variants, folds=2, key="id")["folds"].orderBy(*order).collect()
    assert learned == [1, 1]
    alone = lab.run_lab(df, "y", {"Drop rows": variants["Drop rows"]}, folds=2, key="id")["folds"].orderBy(*order).collect()
    again = [r for r in whole if r["variant"] == "Drop rows"]
    assert [tuple(r)[:3] for r in again] == [tuple(r)[:3] for r in alone] and not any(r["error"] for r in whole)
    assert [r["score"] for r in again] == pytest.approx([r["score"] for r in alone], rel=1e-9)
