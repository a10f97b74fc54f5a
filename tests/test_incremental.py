"""Totals kept up to date equal a rebuild after any order of batches."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from usagelens.operators import activity, incremental

ROWS = "message_id string, file_path string, line_no long, ts timestamp, model string, input_tokens long, output_tokens long, cache_creation_tokens long, cache_read_tokens long"


def snapshots(seed=3, n=120):
    """Snapshots that grow, tie, move to another day and another model, without key, and repeated."""
    rng = random.Random(seed)
    rows = [(rng.choice([None, *[f"m{i}" for i in range(25)]]), rng.choice("fg"), k, f"2024-01-{rng.randint(1, 5):02d} {rng.randint(0, 23):02d}:00:00", rng.choice("xyz"),
             rng.randint(0, 4), rng.randint(0, 2), rng.choice([None, 1]), 0) for k in range(n)]
    return rows + rows[:10]


def frame(spark, rows):
    df = spark.createDataFrame(rows, ROWS.replace("timestamp", "string"))
    return df.withColumn("ts", F.to_timestamp("ts"))


def plain(df):
    return sorted((str(r["date"]), r["model"], *[r[c] or 0 for c in ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "total_tokens")]) for r in df.collect())


@pytest.mark.parametrize("order", list(itertools.permutations(range(3)))[::2])
def test_any_order_of_batches(spark, tmp_path, order):
    rows = snapshots()
    parts = [rows[i::3] for i in range(3)]
    job = incremental.daily_model_totals(spark, str(tmp_path / "t"))
    assert job.totals() is None
    for n, i in enumerate(order):
        job.apply(incremental.usable_requests(frame(spark, parts[i])), n)
    want = activity.daily_model_tokens(frame(spark, [r for r in rows if r[0]]))
    assert plain(job.totals()) == plain(want)


def test_retractions_and_repeated_batches(spark, tmp_path):
    """A larger snapshot on another day moves its tokens; the same batch again, or one that died halfway, changes nothing."""
    job = incremental.daily_model_totals(spark, str(tmp_path / "t"))
    row = lambda m, line, day, n, model="x": (m, "f", line, f"2024-01-0{day} 00:00:00", model, n, 0, 0, 0)
    job.apply(frame(spark, [row("a", 1, 1, 5), row("b", 1, 1, 1)]), 0)
    later = frame(spark, [row("a", 2, 2, 9, "y"), row("b", 0, 3, 1), row("c", 1, 2, 0)])
    for _ in range(2):
        job.apply(later, 1)
        got = {(str(r["date"]), r["model"]): (r["total_tokens"], r["rows"]) for r in job.totals().collect()}
        assert got == {("2024-01-02", "y"): (9, 1), ("2024-01-03", "x"): (1, 1), ("2024-01-02", "x"): (0, 1)}  # the first day is gone
    (tmp_path / "t" / "best" / "batch=1" / "_SUCCESS").unlink()  # died between the two writes
    job.apply(later, 1)
    assert {(str(r["date"]), r["model"]): (r["total_tokens"], r["rows"]) for r in job.totals().collect()} == got
    small = job.compacted(str(tmp_path / "u"), 1)
    small.apply(frame(spark, [row("a", 3, 4, 10, "y")]), 2)
    job.apply(frame(spark, [row("a", 3, 4, 10, "y")]), 2)
    assert plain(small.totals()) == plain(job.totals()) and len(small.totals().collect()) == 3
    job.apply(frame(spark, []), 3)
    assert plain(small.totals()) == plain(job.totals())


def test_sessions_move_to_the_day_of_a_late_line(spark, tmp_path):
    job = incremental.session_starts(spark, str(tmp_path / "s"))
    lines = lambda *x: spark.createDataFrame([(s, f"2024-01-0{d} 10:00:00") for s, d in x], "session_id string, ts string").withColumn("ts", F.to_timestamp("ts"))
    job.apply(lines(("a", 3), ("a", 4), ("b", 3)), 0)
    job.apply(lines(("a", 1), ("b", 5)), 1)
    assert {str(r["date"]): r["rows"] for r in job.totals().collect()} == {"2024-01-01": 1, "2024-01-03": 1}
