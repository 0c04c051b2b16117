"""The routes for tables beyond every bound, forced on small data and compared with plain computations."""
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators import association, correlation, drift, missingness, quantiles, ranks, sampling, timeline
from millrace.operators import columns as C
from millrace.plans import steps


@pytest.fixture(scope="module", autouse=True)
def many_ranges(spark):
    """Range exchanges keep all their ranges, however small, so that order is put together across borders."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.fixture(scope="module")
def skewed(spark):
    r = np.random.default_rng(1)
    x = np.exp(r.normal(size=3000))
    x[:1000] = 2.5                      # a third of the rows share one value
    y = np.round(r.normal(size=3000), 1)
    pdf = pd.DataFrame({"id": range(3000), "x": x, "y": y})
    return spark.createDataFrame(pdf).repartition(5).persist(), pdf


@pytest.mark.parametrize("cells", [50_000, 300, 3])
def test_quantiles_equal_numpy(skewed, monkeypatch, cells):
    df, pdf = skewed
    monkeypatch.setattr(quantiles, "CELLS", cells)
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    zeros = F.when(F.col("id") % 500 == 0, F.col("x")).otherwise(0.0)  # 99.8 % zeros
    got = quantiles.exact_quantiles(df, {"x": F.col("x"), "y": F.col("y"), "z": zeros, "none": F.lit(None)}, probs)
    pdf = pdf.assign(z=np.where(pdf["id"] % 500 == 0, pdf["x"], 0.0))
    for c in ("x", "y", "z"):
        assert np.allclose(got[c], np.quantile(pdf[c], probs), rtol=0, atol=1e-12)
    assert got["none"] == [None] * 7


def test_weighted_quantiles(spark):
    df = spark.createDataFrame([(1.0, 3), (5.0, 1), (9.0, 2), (float("inf"), 0), (None, 4)], "v double, w long")
    got = quantiles.exact_quantiles(df, {"v": F.col("v")}, [0.25, 0.5, 0.75], weight="w")["v"]
    assert np.allclose(got, np.quantile([1, 1, 1, 5, 9, 9], [0.25, 0.5, 0.75]))


def test_jobs_of_a_quantile_call_do_not_follow_columns(skewed, spark):
    df, _ = skewed
    tracker = spark.sparkContext.statusTracker()

    def jobs(n):
        spark.sparkContext.setJobGroup(f"columns-{n}", "")
        quantiles.exact_quantiles(df, {f"c{i}": F.col("x") + i for i in range(n)}, [0.25, 0.5, 0.75])
        return len(tracker.getJobIdsForGroup(f"columns-{n}"))
    assert jobs(6) == jobs(2)


def test_average_ranks_over_many_ranges(skewed):
    df, pdf = skewed
    got = {r["value"]: r["rank"] for r in ranks.average_ranks(df, F.col("x")).collect()}
    want = pdf["x"].rank()
    assert all(got[v] == w for v, w in zip(pdf["x"], want))


def test_row_index_splits_a_hot_value(skewed):
    df, pdf = skewed
    got = {r["id"]: r["row_index"] for r in ranks.row_index(df, F.col("x"), F.col("id")).collect()}
    want = pdf.sort_values(["x", "id"])["id"].tolist()
    assert [got[i] for i in want] == list(range(3000))


def test_previous_values_across_ranges(skewed):
    df, pdf = skewed
    table = df.groupBy(F.col("x").alias("value")).count()
    got = {r["value"]: r["previous"] for r in ranks.previous_values(table, "value").collect()}
    values = sorted(pdf["x"].unique())
    assert got[values[0]] is None
    assert all(got[b] == a for a, b in zip(values, values[1:]))


def test_text_codes_over_ranges(spark):
    words = sorted({f"Customer#{i:07d}" for i in range(0, 5000, 3)} | {"Customer#é", "Customer#", "Customer#00"})
    df = spark.createDataFrame([(w,) for w in words], "k string")
    got = {r["k"]: r["v"] for r in steps.text_codes(df).collect()}
    assert [got[w] for w in sorted(words, key=lambda w: w.encode())] == list(range(len(words)))


def test_kendall_equals_pairs(skewed):
    df, pdf = skewed
    small = pdf.iloc[900:1500]
    x, y = small["x"].to_numpy(), small["y"].to_numpy()
    a, b = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
    want = (a * b).sum() / math.sqrt((a != 0).sum() * (b != 0).sum())
    d = df.filter("id >= 900 and id < 1500")
    assert abs(correlation.kendall_tau(d, F.col("x"), F.col("y"))[0] - want) < 1e-12


def test_drift_routes_agree(skewed):
    df, pdf = skewed
    a, b = df.filter("id % 2 = 0"), df.filter("id % 2 = 1").withColumn("x", F.col("x") * 1.3)
    one = drift.paired_shapes(a, b, ["x", "y"])
    ks, psi = drift.ks_statistics(a, b, ["x", "y"]), drift.stability(a, b, ["x", "y"])
    for c in ("x", "y"):
        assert abs(one[c]["ks"] - ks[c]) < 1e-12
        assert abs(one[c]["psi"] - psi[c]) < 1e-12


def test_ks_over_ranges(skewed):
    df, pdf = skewed
    got = drift.ks_statistics(df.filter("id < 1500"), df.filter("id >= 1500"), ["x", "y"])
    for c in ("x", "y"):
        a, b, grid = np.sort(pdf[c][:1500]), np.sort(pdf[c][1500:]), pdf[c].to_numpy()
        want = np.abs(np.searchsorted(a, grid, "right") / len(a) - np.searchsorted(b, grid, "right") / len(b)).max()
        assert abs(got[c] - want) < 1e-12


def test_rank_tests_over_ranges(skewed):
    df, pdf = skewed
    d = df.withColumn("g", F.when(F.col("x") > 2, None).otherwise(F.col("y")))
    got = missingness.rank_tests(d, ["x", "y"], ["g"], missingness.flags(d, ["g"]))
    gap = pdf["x"] > 2
    for c in ("x", "y"):
        u = pdf[c].rank()[gap].sum() - gap.sum() * (gap.sum() + 1) / 2
        want = 2 * u / (gap.sum() * (~gap).sum()) - 1
        assert abs(abs(got[c, "g"]["effect"]) - abs(want)) < 1e-9


def test_spearman_equals_pandas(skewed):
    df, pdf = skewed
    got = correlation.spearman_pairs(df, ["x", "y"])[("x", "y")][0]
    assert abs(got - pdf["x"].rank().corr(pdf["y"].rank())) < 1e-12


def test_gram_matches_pandas_with_gaps(spark):
    r = np.random.default_rng(3)
    pdf = pd.DataFrame(r.normal(size=(400, 5)) + 1e6, columns=list("abcde"))
    pdf["b"] += pdf["a"]
    pdf["flat"] = 7.0
    holes = pdf.mask(r.random(pdf.shape) < 0.2)
    df = spark.createDataFrame(holes.replace({np.nan: None}).astype(object).where(holes.notna(), None).values.tolist(), ", ".join(f"{c} double" for c in holes))
    got = correlation.pair_corr(df, {c: C.as_numeric(df, c) for c in holes})
    want = holes.corr()
    for (a, b), (v, n) in got.items():
        if "flat" in (a, b):
            assert v is None
        else:
            assert abs(v - want.loc[a, b]) < 1e-9 and n == (holes[a].notna() & holes[b].notna()).sum()


def test_constant_column_has_no_correlation(spark):
    df = spark.range(50).withColumn("one", F.lit(1.0))
    assert correlation.pair_corr(df, {"id": F.col("id"), "one": F.col("one")})[("id", "one")] == (None, 50)


def test_autocorrelation_over_blocks(spark):
    n = 70_000
    series = spark.range(n).select(F.col("id").cast("double").alias("i"), F.sin(F.col("id") * 0.7).alias("y"))
    got = {r["lag"]: r["autocorrelation"] for r in timeline.autocorrelation(series, 20).collect()}
    y = np.sin(np.arange(n) * 0.7)
    e = y - np.polyval(np.polyfit(np.arange(n), y, 1), np.arange(n))
    for k in (1, 7, 20):
        assert abs(got[k] - (e[:-k] * e[k:]).sum() / (e ** 2).sum()) < 1e-9


def test_repeat_rows_spreads_heavy_rows(spark, monkeypatch):
    monkeypatch.setattr(sampling, "COPY_CHUNK", 10)
    df = spark.createDataFrame([("a", 1), ("b", 35), ("c", 0)], "k string, n long")
    got = sampling.repeat_rows(df, F.col("n"), "i").groupBy("k").agg(F.count("*").alias("n"), F.count_distinct("i").alias("u"), F.max("i").alias("m")).collect()
    assert {(r["k"], r["n"], r["u"], r["m"]) for r in got} == {("a", 1, 1, 0), ("b", 35, 35, 34)}


def test_split_joins_class_table_beyond_bound(spark, monkeypatch):
    df = spark.range(500).withColumn("y", (F.col("id") % 7).cast("string"))
    want = {r["id"]: r["_split"] for r in sampling.assign_split(df, "y", key="id").collect()}
    monkeypatch.setattr(sampling, "CLASS_BOUND", 3)
    got = {r["id"]: r["_split"] for r in sampling.assign_split(df.repartition(7), "y", key="id").collect()}
    assert got == want


def test_kruskal_and_eta_against_formulas(skewed):
    df, pdf = skewed
    d = df.withColumn("g", (F.col("id") % 3).cast("string"))
    p = pdf.assign(g=pdf.id % 3, r=pdf.x.rank())
    n = len(p)
    t = p.groupby("x").size()
    h = (12 / (n * (n + 1)) * (p.groupby("g").r.sum() ** 2 / p.groupby("g").size()).sum() - 3 * (n + 1)) / (1 - (t ** 3 - t).sum() / (n ** 3 - n))
    assert abs(association.kruskal(d, {"x": (F.col("g"), F.col("x"))})["x"]["h"] - h) < 1e-9
    within = p.groupby("g").x.apply(lambda v: ((v - v.mean()) ** 2).sum()).sum()
    eta = association.eta_squared(d, [("g", "x")])[("g", "x")]["eta2"]
    assert abs(eta - (1 - within / ((p.x - p.x.mean()) ** 2).sum())) < 1e-12


@pytest.mark.parametrize("share", [500, 2])
def test_cells_and_margins(spark, monkeypatch, share):
    """Measures off the cells equal plain sums, with frequent values broadcast and without."""
    import collections
    import math
    from millrace.operators import ranks
    monkeypatch.setattr(ranks, "HOT_SHARE", share)
    rows = [("a0" if i % 3 == 0 else f"a{i % 7}", None if i % 17 == 0 else f"b{(i * 13 % 11) % 5}", float(i * 37 % 101), f"id{i}") for i in range(900)]
    df = spark.createDataFrame(rows, "a string, b string, v double, id string")

    def plain(x, y):
        both = [(p, q) for p, q in zip(x, y) if p is not None and q is not None]
        n, rows_, cols_ = len(both), collections.Counter(p for p, _ in both), collections.Counter(q for _, q in both)
        cells = collections.Counter(both)
        chi2 = sum((cells[(p, q)] - rows_[p] * cols_[q] / n) ** 2 / (rows_[p] * cols_[q] / n) for p in rows_ for q in cols_)
        h = [-sum(k / n * math.log(k / n) for k in c.values()) for c in (rows_, cols_, cells)]
        return n, len(rows_), len(cols_), chi2, min(1.0, max(0.0, (h[0] + h[1] - h[2]) / min(h[:2])))
    a, b, v, ids = zip(*rows)
    pairs = {("a", "b"): plain(a, b), ("a", "id"): plain(a, ids), ("id", "b"): plain(ids, b)}
    found, mutual = association.cramers(df, list(pairs)), association.nmi(df, list(pairs))
    for p, (n, r, k, chi2, nmi) in pairs.items():
        assert (found[p]["n"], found[p]["r"], found[p]["k"]) == (n, r, k)
        assert abs(found[p]["chi2"] - chi2) < 1e-9 * max(1, chi2) and abs(mutual[p] - nmi) < 1e-12
    groups = collections.defaultdict(list)
    for g, x in zip(a, v):
        groups[g].append(x)
    mean = sum(v) / len(v)
    within = sum((x - sum(g) / len(g)) ** 2 for g in groups.values() for x in g)
    assert abs(association.eta_squared(df, [("a", "v")])[("a", "v")]["eta2"] - (1 - within / sum((x - mean) ** 2 for x in v))) < 1e-12
    assert association.cramers(df.filter("false"), [("a", "b")])[("a", "b")]["n"] == 0
    assert association.nmi(df.filter("false"), [("a", "b")])[("a", "b")] is None


def test_features_of_many_values(spark):
    """Features of any number of values count; a caller's limit is flagged."""
    from millrace.operators import target
    df = spark.range(600).select(F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("label"), (F.col("id") % 7).cast("double").alias("number"),
                                 F.concat(F.lit("code "), F.col("id") % 150).alias("code"))
    cat = [r["feature"] for r in target.class_features(df, "label", [], ["code"]).collect()]
    assert cat == ["code"] and [r["feature"] for r in target.number_features(df, "number", [], ["code"]).collect()] == ["code"]
    keep, out = target.within_limit(df, ["code", "label"], 100)
    assert (keep, out) == (["label"], {"code": 150})


def test_separator_from_all_lines(spark):
    from millrace.sources import readers
    lines = ["a,b;c" for _ in range(60)] + ["1;2;3" for _ in range(100)] + ["", "  "]
    assert readers.sniff_separator(spark.createDataFrame([(x,) for x in lines], "value string")) == ";"
    assert readers.sniff_separator(spark.createDataFrame([], "value string")) == ","


def test_profile_counts_wide_ids(spark):
    from millrace.operators import profile
    df = spark.range(1000).select((F.col("id") + (1 << 60)).alias("wide"), (F.col("id").cast("decimal(38,20)") / 10**9).alias("fine"))
    assert [r["unique"] for r in profile.numeric_profile(df).collect()] == [1000, 1000]


@pytest.mark.parametrize("classes", [10_000, 1])
def test_large_buckets_are_counted_deeper(spark, monkeypatch, classes):
    """Cuts found by more and more digits of the hash are those of a plain sort, also where keys repeat."""
    from millrace.operators import sampling
    rows = [(i if i % 4 else 8, "ab"[i % 3 == 0]) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, y string")
    monkeypatch.setattr(sampling, "BUCKET_ROWS", 1)
    monkeypatch.setattr(sampling, "DIGITS", 2)
    monkeypatch.setattr(sampling, "CLASS_BOUND", classes)
    hashed = df.select("id", "y", sampling.hash_order("id", 5).alias("h"))
    order = {y: sorted(r["h"] for r in hashed.collect() if r["y"] == y) for y in "ab"}
    cut = {y: h[len(h) // 3 - 1] for y, h in order.items()}
    got = sampling.bands(df, "id", 5, "y", [lambda n: F.floor(n / 3)])
    found = sorted((r["id"], r["y"], r["_band"]) for r in got.collect())
    assert found == sorted((r["id"], r["y"], int(r["h"] > cut[r["y"]])) for r in hashed.collect())
