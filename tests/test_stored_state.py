"""Components that grow by report, and compact summaries that merge."""

import random

import pytest
from pyspark.sql import functions as F

from usagelens.operators import identity, sketches


def labels(df):
    return {r["entry"]: r["component"] for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_reports_one_by_one_equal_a_full_run(spark, tmp_path, seed):
    """New keys, old keys, entries that come again with more keys, and reports that join components of earlier ones."""
    rng = random.Random(seed)
    rows = [(rng.randrange(60), f"k{rng.randrange(70)}") for _ in range(90)] + [(7, "hot"), (50, "hot"), (3, "hot")]
    rng.shuffle(rows)
    store = identity.ComponentStore(spark, str(tmp_path / "c"))
    assert store.components() is None
    seen = []
    for n in range(4):
        part = rows[n::4]
        seen += part
        assert store.add(spark.createDataFrame(part, "entry int, key string")) == n + 1
        assert labels(store.components()) == labels(identity.shared_key_components(spark.createDataFrame(seen, "entry int, key string")))
    # what a report writes are its new entries and keys only
    again = store.add(spark.createDataFrame([(999, "k1"), *rows[:3]], "entry int, key string"))
    assert spark.read.parquet(str(tmp_path / "c" / "labels" / f"batch={again}")).count() == 1
    assert spark.read.parquet(str(tmp_path / "c" / "keys" / f"batch={again}")).count() <= 1
    # a report that died before its forest was written is not there
    (tmp_path / "c" / "forest" / f"batch={again}" / "_SUCCESS").unlink()
    assert 999 not in labels(store.components())


def test_percentiles_of_merged_sketches_lie_within_the_bound(spark):
    rng = random.Random(4)
    rows = [(k % 3, g, rng.lognormvariate(3, 2) if g == "a" else float(rng.randrange(50))) for k in range(60_000) for g in ("a", "b")]
    df = spark.createDataFrame(rows, "source int, g string, value double")
    stored = sketches.quantile_sketches(df, by=["source", "g"])
    wanted = {"p05": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99}
    got = {r["g"]: r for r in sketches.percentiles_of(sketches.merge_quantiles(stored, ["g"]), wanted, ["g"]).collect()}
    for g in ("a", "b"):
        values = sorted(v for _, x, v in rows if x == g)
        assert got[g]["n"] == len(values)
        for name, p in wanted.items():
            below, upto = sum(v < got[g][name] for v in values), sum(v <= got[g][name] for v in values)
            assert below / len(values) - got[g]["rank_error"] <= p <= upto / len(values) + got[g]["rank_error"]
    sizes = [r["n"] for r in stored.select(F.octet_length("sketch").alias("n")).collect()]
    assert max(sizes) < 120_000  # flat: 20,000 values a group would take 160,000 bytes


def test_distinct_counts_of_overlapping_reports(spark):
    df = spark.range(30_000).select((F.col("id") % 3).alias("source"), F.concat(F.lit("s"), F.col("id") % 2_000).alias("session"))
    stored = df.groupBy("source").agg(sketches.distinct_sketch("session").alias("sessions"))
    united = sketches.merge_distinct(stored, ["sessions"]).select(sketches.distinct_count("sessions").alias("n"))
    assert united.first()["n"] == 2_000
    large = spark.range(400_000).select((F.col("id") % 4).alias("source"), (F.col("id") % 150_000).alias("session"))
    stored = large.groupBy("source").agg(sketches.distinct_sketch("session").alias("sessions"))
    n = sketches.merge_distinct(stored, ["sessions"]).select(sketches.distinct_count("sessions").alias("n")).first()["n"]
    assert abs(n - 150_000) < 0.02 * 150_000


def test_folded_repositories_keep_their_attributes(spark):
    from usagelens.operators import merging

    rows = [("a1", "a1", 5, 9, 0, 1, 1, 1, 0, "2024-01-02", "2024-02-01", "", None, ["r2"], "/x"), ("a2", "a1", 7, 8, 1, 1, 1, 1, 0, "2024-01-01", "2024-01-05", "tool", "git@h:tool", ["r1", "r2"], "/y"),
            ("b", "b", 1, 1, 0, 0, 0, 0, 0, None, None, "solo", None, None, "/z")]
    names = ["entry", "component", *merging.REPO_COUNTS, "first_commit_at", "last_commit_at", "name", "remote", "root_commits", "path"]
    schema = "entry string, component string, " + ", ".join(f"{c} bigint" for c in merging.REPO_COUNTS) + ", first_commit_at string, last_commit_at string, name string, remote string, root_commits array<string>, path string"
    assert len(names) == len(rows[0])
    got = {r["component"]: r for r in merging.fold_repos(spark.createDataFrame(rows, schema)).collect()}
    assert (got["a1"]["attributed_commits"], got["a1"]["name"], got["a1"]["remote"], got["a1"]["root_commits"], got["a1"]["path"], got["a1"]["aliases"]) == (7, "tool", "git@h:tool", ["r1", "r2"], "/x", ["/y"])
    assert (got["b"]["name"], got["b"]["root_commits"], got["b"]["aliases"]) == ("solo", [], [])
