"""Sortable keys against the bits of doubles, and plans whose shape must not follow columns or data."""
import collections
import itertools
import math
import random
import re
import struct
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import keys
from millrace.operators import association, correlation, drift, quantiles, ranks
from millrace.plans import steps


def test_double_keys_are_the_bits_in_order(spark):
    rng = random.Random(1)
    values = [0.0, -0.0, math.inf, -math.inf, math.nan, None, 5e-324, -5e-324, 1.7976931348623157e308]
    for e in range(-1074, 1024):
        v = math.ldexp(1.0, e)
        values += [v, math.nextafter(v, 0), -math.nextafter(v, math.inf)]
    values += [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0] for _ in range(5000)]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", F.col("v").alias("k"))
    for v, k in keys.with_double_keys(df, ["k"]).collect():
        if v is None or math.isnan(v):
            assert k is None
        else:
            bits = struct.unpack("<q", struct.pack("<d", abs(v)))[0]
            assert k == (-bits if v < 0 else bits) and keys.double_of(k) == v


def test_numbers_keep_their_own_type(spark):
    schema = "a decimal(38,10), b long, c decimal(9,2), d boolean, e float, f decimal(38,0)"
    rows = [(Decimal("12345678901.1234567891"), 2 ** 60 + 1, Decimal("1.25"), True, 0.5, Decimal(10) ** 37), (Decimal("12345678901.1234567890"), -2 ** 60, Decimal("-7.50"), False, -0.0, Decimal(-1)), (None,) * 6]
    numbers = keys.Numbers(spark.createDataFrame(rows, schema), [F.col(c) for c in "abcdef"])
    got = {}
    for r in numbers.rows().collect():
        got.setdefault(r["k"], set()).add(numbers.number[r["k"]](r["key"]))
    assert got == {0: {Fraction(rows[0][0]), Fraction(rows[1][0])}, 1: {2 ** 60 + 1, -2 ** 60}, 2: {Fraction(5, 4), Fraction(-15, 2)}, 3: {0, 1}, 4: {0.5, 0.0}, 5: {1e37, -1.0}}
    assert numbers.least_key(2, 1.245) == 125 and numbers.least_key(1, 7.5) == 8 and keys.double_of(numbers.least_key(4, 0.25)) == 0.25
    inside = numbers.rows({1: [(0, 2 ** 62)], 4: [(0, 0)]}).collect()
    assert sorted((r["k"], r["key"]) for r in inside) == [(1, 2 ** 60 + 1), (4, 0)]


@pytest.mark.parametrize("cells", [50_000, 2])
def test_quantiles_with_signed_zeros(spark, monkeypatch, cells):
    monkeypatch.setattr(quantiles, "CELLS", cells)
    values = [-1.0] * 501 + [-0.0] * 5 + [0.0] * 498
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    probs = [0.0, 500 / 1003, 501 / 1003, 505.5 / 1003, 1.0]
    assert quantiles.exact_quantiles(df, {"v": F.col("v")}, probs)["v"] == list(np.quantile(values, probs))
    only = df.filter("v = 0").withColumn("w", F.lit(2 ** 40))
    assert quantiles.exact_quantiles(only, {"v": F.col("v"), "n": F.lit(None).cast("double")}, [0.5], "w") == {"v": [0.0], "n": [None]}


def test_ties_of_signed_zeros_share_a_rank(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (1.0,), (-1.0,), (-0.0,)], "v double")
    assert sorted(map(tuple, ranks.average_ranks(df, F.col("v")).collect())) == [(-1.0, 1, 1.0), (0.0, 3, 3.0), (1.0, 1, 5.0)]
    assert drift.ks_statistics(df.filter("v = 0"), df.filter("v = 0"), ["v"]) == {"v": 0.0}


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_exchanges_of_ranks_do_not_follow_columns(spark):
    df = spark.range(500).select(*[((F.col("id") * (i + 3)) % 101).alias(f"c{i}") for i in range(6)])
    tracker, jobs, plans = spark.sparkContext.statusTracker(), [], []
    for n in (2, 6):
        spark.sparkContext.setJobGroup(f"ranks-{n}", "")
        out = ranks.row_ranks(df, [F.col(f"c{i}") for i in range(n)])
        out.count()
        jobs.append(len(tracker.getJobIdsForGroup(f"ranks-{n}")))
        plans.append(exchanges(out))
    assert plans[0] == plans[1] and jobs[0] == jobs[1]
    two = correlation.spearman_pairs(df, ["c0", "c1"])[("c0", "c1")][0]
    pdf = df.toPandas()
    assert abs(two - pdf["c0"].rank().corr(pdf["c1"].rank())) < 1e-12


def test_ranks_of_a_frequent_value_stay_in_place(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id").cast("double")).alias("v"), F.when(F.col("id") % 5 > 0, F.col("id") % 11).alias("w"))
    got = ranks.row_ranks(df, [F.col("v"), F.col("w")]).toPandas()
    pdf = df.toPandas()
    assert sorted(got["r0"]) == sorted(pdf["v"].rank()) and sorted(got["r1"].dropna()) == sorted(pdf["w"].dropna().rank())


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_kendall_of_all_pairs_by_inversions(spark, monkeypatch, bits):
    monkeypatch.setattr(correlation, "LEVEL_BITS", bits)
    r = np.random.default_rng(bits)
    x, y, z = r.integers(0, 40, 300), r.integers(0, 7, 300), r.normal(size=300)
    rows = [(int(a), float(b) if i % 9 else None, float(c), 1) for i, (a, b, c) in enumerate(zip(x, y, z))]
    df = spark.createDataFrame(rows, "x long, y double, z double, one int")
    got = correlation.kendall_pairs(df, {c: F.col(c) for c in ("x", "y", "z", "one")})
    pdf = df.toPandas().astype(float)
    for (a, b), (tau, n) in got.items():
        d = pdf[[a, b]].dropna().to_numpy()
        p, q = np.sign(d[:, None, 0] - d[:, 0]), np.sign(d[:, None, 1] - d[:, 1])
        both = math.sqrt((p != 0).sum() * (q != 0).sum())
        assert n == len(d) and (tau is None if not both else abs(tau - (p * q).sum() / both) < 1e-12)


def test_text_order_of_equal_beginnings_gives_even_ranges(spark):
    same = "x" * 60
    words = [f"{same}{i:06d}" for i in range(20_000)] + ["a"]
    df = spark.createDataFrame([(w,) for w in words], "k string").repartition(6)
    got = {r["k"]: r["v"] for r in steps.text_codes(df).collect()}
    assert [got[w] for w in sorted(words)] == list(range(len(words)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in ranks.placed(df, ["k"]).groupBy("part").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(sizes) < 2 * len(words) / len(sizes)


def test_gap_lattice_serves_counts_patterns_and_phi(spark):
    from millrace.operators import missingness
    rows = [(i, None if i % 3 == 0 else 1.0, "  " if i % 3 == 0 or i % 7 == 0 else "x", None if i % 11 == 0 else 2, 5) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, a double, b string, c int, d int").repartition(5)
    found = missingness.lattice(df)
    assert (found.rows, found.missing) == missingness.missing_counts(df)
    gaps = df.toPandas()
    gaps = gaps.assign(a=gaps["a"].isna(), b=gaps["b"].str.strip() == "", c=gaps["c"].isna())[["a", "b", "c"]]
    want = gaps.apply(lambda r: ", ".join(c for c in "abc" if r[c]) or "complete rows", axis=1).value_counts().to_dict()
    assert {r["pattern"]: r["rows"] for r in missingness.patterns(df, found=found).collect()} == want
    phi = {(r["column_a"], r["column_b"]): r["phi"] for r in missingness.co_missing(df, 0.0, found=found).collect()}
    assert phi.keys() == {("a", "b"), ("a", "c"), ("b", "c")} and all(abs(v - gaps[a].astype(float).corr(gaps[b].astype(float))) < 1e-12 for (a, b), v in phi.items())
    assert missingness.patterns(df.select("id", "d")).count() == 0 and missingness.lattice(df.limit(0)).rows == 0


def test_synthetic_rows_do_not_follow_partitions(spark):
    from millrace.sources.synthetic import make_dataset, normal, uniform
    one, many = (sorted(map(tuple, make_dataset(spark, 300, 6, seed=3, partitions=n).collect()), key=str) for n in (1, 7))
    assert one == many and one != sorted(map(tuple, make_dataset(spark, 300, 6, seed=4).collect()), key=str)
    r = spark.range(4000).select(uniform(1, "a").alias("u"), normal(1, "b").alias("z")).agg(F.avg("u"), F.stddev("u"), F.avg("z"), F.stddev("z"), F.corr("u", "z")).first()
    assert all(abs(a - b) < 0.05 for a, b in zip(r, (0.5, 12 ** -0.5, 0.0, 1.0, 0.0)))


def test_row_ranks_agree_on_every_route(spark, monkeypatch):
    """Ranks from a broadcast, from one join for each column and from the folded table; the first shuffles no rows."""
    from millrace.operators import ranks
    values = [(i % 3 + 0.5, None if i % 4 == 0 else i % 7, -0.0 if i % 2 else float(i % 5)) if i % 11 else (None, None, float("nan")) for i in range(200)]
    df = spark.createDataFrame(values, "a double, b int, c double")
    exprs = [F.col(c) for c in df.columns]

    def average(own, v):
        return None if v is None or v != v else sum(x < v for x in own) + (sum(x == v for x in own) + 1) / 2

    own = [[v for v in c if v is not None and v == v] for c in zip(*values)]
    want = sorted([r for r in (tuple(average(own[i], v) for i, v in enumerate(x)) for x in values) if any(v is not None for v in r)], key=repr)
    for few, alone in ((1000, 2), (0, 3), (0, 0), (3, 2)):
        monkeypatch.setattr(ranks, "FEW_RANKS", few)
        monkeypatch.setattr(ranks, "ALONE", alone)
        found = ranks.row_ranks(df, exprs)
        if few == 1000:
            assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
        assert sorted([tuple(r)[1:] for r in found.collect()], key=repr) == want
        dense = ranks.row_ranks(df, exprs, dense=True)
        assert {r["r1"] for r in dense.collect()} == {None, *map(float, range(7))}


def compiled_bytes(df, capsys) -> int:
    """The largest method that Spark generates for a plan; Java does not compile methods of over 8,000 bytes but interprets them."""
    capsys.readouterr()
    df.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df.select("*").explain("codegen")
    finally:
        df.sparkSession.conf.set("spark.sql.adaptive.enabled", "true")
    return max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)))


def test_range_search_is_no_growing_expression(spark, capsys):
    df = spark.range(0, 5000, 1, 3).select(F.col("id").alias("w"), *[(F.col("id") * (i + 1) / 4 - 300).alias(f"v{i}") for i in range(12)], (F.col("id") % 977).alias("n"))
    numbers = keys.Numbers(df, [F.when(F.col("n") != 5, F.col(c)) for c in df.columns[1:]], [F.col("w")])
    cells = {r["k"]: r["v"] for r in numbers.rows().groupBy("k").agg(F.sort_array(F.collect_set("key")).alias("v")).collect()}
    within = {k: [(v[i], v[i + 1]) for i in range(0, len(v) - 1, len(v) // 9)] for k, v in cells.items()}
    kept = numbers.rows(within)
    assert compiled_bytes(kept, capsys) < 8000
    wanted = {(k, key) for k, ranges in within.items() for pair in ranges for key in pair}
    got = kept.collect()
    assert {(r["k"], r["key"]) for r in got} == wanted
    every = numbers.rows().collect()
    assert sorted(got) == sorted(r for r in every if (r["k"], r["key"]) in wanted)


def test_cells_of_many_pairs_are_no_growing_expression(spark, monkeypatch, capsys):
    df = spark.range(400).select(*[(F.col("id") * p % 397 / 3).alias(f"v{p}") for p in (1, 5, 7)], F.when(F.col("id") % 9 > 0, F.concat(F.lit("c"), F.col("id") % 4)).alias("c"))
    pairs, seen = list(itertools.combinations(df.columns, 2)), []
    monkeypatch.setattr(association, "entropies", lambda cells: seen.append(cells) or [])
    association.nmi(df, pairs)
    assert compiled_bytes(seen[0], capsys) < 8000
    rows = df.collect()
    edges = {c: np.quantile([r[c] for r in rows], [i / 10 for i in range(1, 10)]) for c in df.columns[:-1]}
    full = {c: np.quantile([r[c] for r in rows if r["c"]], [i / 10 for i in range(1, 10)]) for c in edges}
    want = collections.Counter()
    for i, (a, b) in enumerate(pairs):
        for r in rows:
            if b != "c":
                want[(i, str(int((edges[a] < r[a]).sum())), str(int((edges[b] < r[b]).sum())))] += 1
            elif r["c"]:
                want[(i, str(int((full[a] < r[a]).sum())), r["c"])] += 1
    assert {(r["pair"], r["a"], r["b"]): r["n"] for r in seen[0].collect()} == want


def test_both_zeros_are_one_value_of_few(spark):
    zeros = spark.range(100).select(F.when(F.col("id") % 4 == 0, F.lit(0.0)).when(F.col("id") % 4 == 1, F.lit(-0.0)).otherwise(F.lit(1.0)).alias("z"), (F.col("id") % 4).cast("string").alias("g"))
    assert abs(association.nmi(zeros, [("z", "g")])[("z", "g")] - 1) < 1e-12
    halves = zeros.filter("z = 0")
    assert association.nmi(halves, [("z", "g")])[("z", "g")] == 0.0
