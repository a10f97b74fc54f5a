"""Statistics against brute force on small frames, and their edge cases."""

import math
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from usagelens.functions import numeric, stats
from usagelens.operators import distribution, ranks, significance


def values(spark, data, schema="metric string, value double"):
    return spark.createDataFrame(data, schema)


def test_distribution_matches_numpy(spark):
    rng = random.Random(1)
    data = [("a", float(rng.randint(-50, 50))) for _ in range(301)] + [("b", rng.lognormvariate(8, 2)) for _ in range(57)] + [("c", 4.0)]
    out = {r["metric"]: r for r in rows(distribution.distribution_summary(values(spark, data), by=["metric"]))}
    for name in "abc":
        x = np.array([v for m, v in data if m == name])
        r = out[name]
        assert r["n"] == len(x)
        assert r["sum"] == pytest.approx(x.sum())
        for p, q in distribution.PERCENTILES.items():
            assert r[p] == pytest.approx(np.percentile(x, q * 100), rel=1e-12)
        assert (r["min"], r["max"]) == (x.min(), x.max())
        assert r["low_confidence"] == (len(x) < 20)
    assert out["a"]["stdev"] == pytest.approx(np.std([v for m, v in data if m == "a"], ddof=1))
    assert out["c"]["stdev"] is None


def test_empty_distribution(spark):
    (r,) = rows(distribution.distribution_summary(values(spark, []).select("value")))
    assert (r["n"], r["sum"], r["mean"], r["p50"], r["stdev"]) == (0, 0.0, None, None, None)


def test_null_group_is_kept(spark):
    out = rows(distribution.distribution_summary(values(spark, [(None, 1.0), (None, 3.0), ("x", 5.0)]), by=["metric"]), "metric")
    assert {r["metric"]: r["p50"] for r in out} == {None: 2.0, "x": 5.0}


def test_order_bucket_is_monotone(spark):
    rng = random.Random(2)
    xs = sorted({rng.choice([-1, 1]) * rng.lognormvariate(0, 20) for _ in range(2000)} | {0.0, 1.0, -1.0, 2.0**40, 2.0**40 + 1})
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    buckets = [r["b"] for r in df.select("i", ranks.order_bucket(F.col("x")).alias("b")).orderBy("i").collect()]
    assert buckets == sorted(buckets)


def brute_mann_whitney(a, b):
    both = sorted(a + b)
    rank = {v: np.mean([i + 1 for i, w in enumerate(both) if w == v]) for v in set(both)}
    n1, n2 = len(a), len(b)
    u1 = sum(rank[v] for v in a) - n1 * (n1 + 1) / 2
    n = n1 + n2
    ties = sum(both.count(v) ** 3 - both.count(v) for v in set(both))
    sigma = math.sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1))))
    gap = min(u1, n1 * n2 - u1) - n1 * n2 / 2
    z = (gap + (0.5 if gap < 0 else -0.5)) / sigma if sigma else 0.0
    return u1, z


def test_mann_whitney_matches_brute_force(spark):
    rng = random.Random(3)
    a, b = [float(rng.randint(0, 30)) for _ in range(60)], [float(rng.randint(5, 35)) for _ in range(45)]
    df = spark.createDataFrame([("baseline", v) for v in a] + [("compare", v) for v in b], "side string, value double")
    (r,) = rows(significance.mann_whitney(df))
    u1, z = brute_mann_whitney(a, b)
    assert r["u1"] == pytest.approx(u1) and r["z"] == pytest.approx(z)
    assert r["p_value"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), abs=1e-6)
    assert r["direction"] == "up" and not r["skipped"]


def test_mann_whitney_all_tied_and_small(spark):
    tied = spark.createDataFrame([("baseline", 1.0)] * 12 + [("compare", 1.0)] * 12, "side string, value double")
    (r,) = rows(significance.mann_whitney(tied))
    assert (r["z"], r["p_value"], r["direction"], r["effect_size"]) == (0.0, pytest.approx(1.0, abs=1e-6), "flat", "negligible")
    small = spark.createDataFrame([("baseline", 3.0)] * 9 + [("compare", 1.0)] * 12, "side string, value double")
    (r,) = rows(significance.mann_whitney(small))
    assert r["skipped"] and r["p_value"] is None and r["direction"] == "down" and (r["n1"], r["n2"]) == (9, 12)


def test_comparison_without_new_activity(spark):
    df = spark.createDataFrame([("m", "baseline", float(i)) for i in range(30)], "metric string, side string, value double")
    (r,) = rows(significance.compare_distributions(df))
    assert (r["verdict"], r["comp_n"], r["comp_p50"], r["p50_pct_change"]) == ("no-activity", 0, None, None)


def test_two_proportion_edges(spark):
    df = spark.createDataFrame([(3, 29, 3, 100), (0, 50, 0, 50), (50, 50, 60, 60), (5, 100, 30, 100), (None, None, 1, 40)], "a int, b int, c int, d int")
    test = stats.two_proportion_test("a", "b", "c", "d")
    out = [r.asDict() for r in df.select(*[c.alias(n) for n, c in test.items()]).collect()]
    assert out[0]["skipped"] and out[0]["rate_1"] == pytest.approx(3 / 29) and out[0]["z"] is None
    assert (out[1]["z"], out[1]["p_value"], out[1]["direction"], out[1]["significant"]) == (0.0, 1.0, "flat", False)
    assert out[2]["direction"] == "flat"
    assert out[3]["significant"] and out[3]["direction"] == "up"
    z = (0.30 - 0.05) / math.sqrt(0.175 * 0.825 * 2 / 100)
    assert out[3]["z"] == pytest.approx(z) and out[3]["p_value"] == pytest.approx(math.erfc(z / math.sqrt(2)), abs=1e-6)
    assert out[4]["skipped"] and out[4]["rate_1"] is None


def test_percent_change_rules(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.0, 5.0), (None, 1.0), (-4.0, -2.0), (4.0, None)], "a double, b double")
    assert [r[0] for r in df.select(numeric.pct_change("a", "b")).collect()] == [0.0, None, None, 50.0, None]


def test_bootstrap_methods_agree(spark):
    rng = random.Random(5)
    xs = [rng.lognormvariate(5, 1) for _ in range(400)]
    df = values(spark, [("m", v) for v in xs])
    explicit = {r["statistic"]: r for r in rows(distribution.bootstrap_by_resampling(df, by=["metric"], resamples=800))}
    direct = {r["statistic"]: r for r in rows(distribution.bootstrap_by_order_statistics(df, by=["metric"], resamples=800))}
    gen = np.random.default_rng(0)
    sims = np.array([gen.choice(xs, len(xs)) for _ in range(4000)])
    for name, q in (("p50", 50), ("p85", 85)):
        want = np.percentile(np.percentile(sims, q, axis=1), [5, 95])
        width = want[1] - want[0]
        for got in (explicit[name], direct[name]):
            assert got["ci_low"] == pytest.approx(want[0], abs=0.25 * width)
            assert got["ci_high"] == pytest.approx(want[1], abs=0.25 * width)


def test_bootstrap_of_any_size(spark):
    df = values(spark, [("one", 7.0)] + [("big", float(i)) for i in range(100)])
    out = {(r["metric"], r["statistic"]): r for r in rows(distribution.bootstrap_ci(df, resamples=50))}
    assert len(out) == 4
    assert (out["one", "p50"]["ci_low"], out["one", "p50"]["ci_high"]) == (7.0, 7.0)
    assert out["big", "p50"]["ci_low"] < 50 < out["big", "p50"]["ci_high"]


def test_values_at_positions(spark):
    xs = [5.0, 1.0, 1.0, 9.0, 9.0, 9.0, -3.0, 0.0]
    df = spark.createDataFrame([(x,) for x in xs], "value double")
    running = ranks.running_counts(ranks.value_counts(df))
    positions = spark.range(len(xs)).select(F.col("id").alias("position"))
    found = rows(ranks.values_at_positions(running, positions), "position")
    assert [r["value"] for r in sorted(found, key=lambda r: r["position"])] == sorted(xs)


def test_sample_is_whole_when_small_and_mergeable(spark):
    df = spark.range(200).select(F.col("id").cast("string").alias("row_key"), (F.col("id") % 2).alias("g"))
    assert distribution.hashed_sample(df, ["row_key"], 500).count() == 200
    whole = {r["row_key"] for r in rows(distribution.hashed_sample(df, ["row_key"], 20))}
    parts = distribution.hashed_sample(df, ["row_key"], 20, ["g"])
    again = {r["row_key"] for r in rows(distribution.hashed_sample(parts, ["row_key"], 20))}
    assert whole == again and len(whole) == 20


@pytest.mark.parametrize("sizes", [[1, 1, 1], [7, 11, 13], [6000, 10, 0], [5000, 5000, 1]])
def test_quotas_sum_to_target(spark, sizes):
    df = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, n bigint")
    quotas = {r["source"]: r["quota"] for r in rows(distribution.merge_quotas(df, target=100))}
    assert sum(quotas.values()) == min(100, sum(sizes))
    assert all(quotas[f"s{i}"] <= n for i, n in enumerate(sizes) if n)


def test_merging_one_summary_passes_through(spark):
    df = values(spark, [("m", float(i * i)) for i in range(40)]).withColumn("row_key", F.col("value").cast("string")).withColumn("source", F.lit("a"))
    summary = distribution.distribution_summary(df, by=["metric", "source"]).withColumn("sampled", F.lit(False))
    (merged,) = rows(distribution.merge_summaries(summary, df, ["row_key"]))
    (one,) = rows(summary)
    for c in ("n", "sum", "mean", "stdev", "p50", "p95", "min", "max"):
        assert merged[c] == pytest.approx(one[c])
    assert not merged["sampled"]


def test_histogram_counts_everything(spark):
    data = [("a", float(i)) for i in range(100)] + [("b", 0.0), ("b", 500.0), ("c", 1.0)]
    out = rows(distribution.clipped_histogram(spark.createDataFrame(data, "series string, value double")))
    for s, n in (("a", 100), ("b", 2)):
        mine = [r for r in out if r["series"] == s]
        assert len(mine) == 44 and sum(r["n"] for r in mine) + mine[0]["clipped"] == n
    assert not [r for r in out if r["series"] == "c"]


def test_no_bucket_is_hot(spark):
    n = 60_000
    df = spark.range(n).select((F.col("id") * 7 % n + 1_700_000_000).cast("double").alias("value"))
    running = ranks.running_counts(ranks.value_counts(df))
    sizes = [r[0] for r in running.groupBy("_bucket").count().select("count").collect()]
    assert max(sizes) <= 2 * ranks.BUCKET_ROWS and sum(sizes) == n
    assert running.where(F.col("below_n") != F.col("value") - 1_700_000_000).count() == 0


def test_infinite_values(spark):
    df = spark.createDataFrame([(float("inf"),), (float("-inf"),), (0.0,), (5.0,), (float("nan"),), (None,)], "value double")
    got = {r["value"]: r["below_n"] for r in ranks.running_counts(ranks.value_counts(df)).collect()}
    assert got == {float("-inf"): 0, 0.0: 1, 5.0: 2, float("inf"): 3}
