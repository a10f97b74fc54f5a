"""Buckets are cut where their values are, however they cluster."""

import random

import pytest
from pyspark.sql import functions as F

from usagelens.operators import ranks


def parts(running):
    return [r["count"] for r in running.groupBy("_bucket").count().collect()]


@pytest.mark.parametrize("far", [0, 2])
def test_a_cluster_in_a_millionth_of_its_bucket(spark, far):
    """200,000 distinct values a thousandth apart, and two in the same bucket five million away."""
    base = 2.0**40
    df = spark.range(200_000).select((F.lit(base) + F.col("id") * 1e-3).alias("value"))
    if far:
        df = df.unionByName(spark.createDataFrame([(base + 5e6,), (base + 5.1e6,)], "value double"))
    running = ranks.running_counts(ranks.value_counts(df))
    sizes = parts(running)
    assert sum(sizes) == 200_000 + far and max(sizes) < 2 * ranks.BUCKET_ROWS and len(sizes) < 4 * 200_000 / ranks.BUCKET_ROWS
    # counts below stay exact
    assert running.where("value < 1099511728000").agg(F.max("below_n")).first()[0] == running.where("value < 1099511728000").count() - 1


def test_ranks_by_definition(spark):
    """Clusters at every scale, both signs, ties and infinities, in two groups: `below` is the count of smaller values."""
    rng = random.Random(6)
    values = [s * (10.0**e + rng.random() * 10.0 ** (e - k)) for s in (-1, 1) for e in (-3, 0, 7) for k in (1, 6, 9) for _ in range(400)]
    values += [float("inf"), float("-inf"), 0.0] + values[:500]
    rows = [(g, v) for v in values for g in ("a", None)]
    old, ranks.BUCKET_ROWS = ranks.BUCKET_ROWS, 20
    try:
        got = ranks.running_counts(ranks.value_counts(spark.createDataFrame(rows, "g string, value double"), by=["g"]), by=["g"])
        found = [(r["g"], r["value"], r["n"], r["below_n"], r["total_n"]) for r in got.collect()]
        assert max(parts(got)) < 200
    finally:
        ranks.BUCKET_ROWS = old
    below, ordered = {}, sorted(values)
    for i, v in enumerate(ordered):
        below.setdefault(v, i)
    assert sorted(found, key=str) == sorted([(g, v, ordered.count(v), b, len(values)) for v, b in below.items() for g in ("a", None)], key=str)
