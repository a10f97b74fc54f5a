"""Hashed samples: the smallest hashes of each group, with no task that ranks a whole group."""

import hashlib
import re

from usagelens.operators import distribution


def lowest_exchange(df):
    """What the first shuffle of a plan deals by."""
    return re.findall(r"hashpartitioning\(([^)]*), \d+\)", df._jdf.queryExecution().executedPlan().toString())[-1]


def smallest(rows, k):
    groups = {}
    for g, key, value in rows:
        groups.setdefault(g, []).append((hashlib.md5(f"{key}:0".encode()).hexdigest(), key, value))
    return sorted((str(g), key, value) for g, some in groups.items() for _, key, value in sorted(some)[:k])


def test_a_group_is_ranked_in_parts(spark):
    rows = [(None if i % 5 == 0 else f"g{i % 2}", f"r{i}", i) for i in range(4_000)] + [("few", f"x{i}", i) for i in range(7)]
    df = spark.createDataFrame(rows, "g string, row_key string, value long")
    found = distribution.hashed_sample(df, ["row_key"], 120, ["g"])
    assert found.columns == df.columns
    assert sorted((str(r["g"]), r["row_key"], r["value"]) for r in found.collect()) == smallest(rows, 120)
    assert "_rank_part" in lowest_exchange(found)


def test_rows_that_come_often_and_columns_that_have_no_hash(spark):
    df = spark.createDataFrame([("a", None, {"x": 1})] * 30 + [("a", "k", {"x": 2})] * 30, "g string, row_key string, m map<string,int>")
    found = distribution.hashed_sample(df, ["row_key"], 40, ["g"]).collect()
    counts = sorted([sum(r["row_key"] is None for r in found), sum(r["row_key"] == "k" for r in found)])
    assert len(found) == 40 and counts == [10, 30]  # all copies of the smaller hash, then some of the other
