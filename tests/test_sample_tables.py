"""Reports and merges take their samples without a task that ranks a whole distribution."""

import re

from usagelens.operators import distribution
from usagelens.plans import usage

COUNTS = "input_tokens long, output_tokens long, cache_creation_tokens long, cache_creation_5m_tokens long, cache_creation_1h_tokens long, cache_read_tokens long"


def lowest_exchange(df):
    return re.findall(r"hashpartitioning\(([^)]*), \d+\)", df._jdf.queryExecution().executedPlan().toString())[-1]


def test_samples_of_a_stored_report(spark):
    rows = [(f"m{i}", i % 9, f"2024-01-{i % 28 + 1:02d} 05:00:00", "main", None, "x", i, 1, 2, 2, 0, 3) for i in range(300)]
    df = spark.createDataFrame(rows, f"message_id string, session_id long, ts string, tier string, agent_type string, model string, {COUNTS}")
    samples = usage.usage_tables(df.withColumn("ts", df["ts"].cast("timestamp")), sample_size=20)["samples"]
    assert "_rank_part" in lowest_exchange(samples)
    assert {r["metric"]: r["count"] for r in samples.groupBy("metric").count().collect()} == {"tokens per request": 20, "tokens per session": 9, "tokens per active hour": 20}


def test_samples_behind_merged_summaries(spark):
    rows = [("m", i % 2, f"r{i}", float(i)) for i in range(900)]
    metrics = spark.createDataFrame(rows, "metric string, source int, row_key string, value double")
    summary = distribution.distribution_summary(metrics, "value", ["metric", "source"]).withColumn("sampled", distribution.F.col("n") > 100)
    sample = distribution.hashed_sample(metrics, ["row_key"], 100, ["metric", "source"])
    assert "_rank_part" in lowest_exchange(sample)
    drawn = distribution.weighted_merge_sample(summary, sample, ["row_key"], target=60)
    assert {r["source"]: r["count"] for r in drawn.groupBy("source").count().collect()} == {0: 30, 1: 30}
    (merged,) = distribution.merge_summaries(summary, sample, ["row_key"], target=60).collect()
    assert (merged["n"], merged["sum"], merged["sample_n"], merged["sampled"]) == (900, sum(range(900)), 60, True)
