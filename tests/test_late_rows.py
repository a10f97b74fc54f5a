"""Late rows reach closed windows, are counted, and are kept aside."""

from pyspark.sql import functions as F

from usagelens.streaming import jobs


def test_totals_equal_a_batch_run_and_a_repeated_batch_counts_once(spark, tmp_path):
    hour = lambda h, n, x="a": (f"2024-01-{1 + h // 24:02d} {h % 24:02d}:30:00", n, x)
    frame = lambda rows: spark.createDataFrame(rows, "ts string, n long, x string").withColumn("ts", F.to_timestamp("ts"))
    job = jobs.LateAwareWindows(str(tmp_path / "w"), {"n": F.sum("n"), "events": F.count(F.lit(1))}, late_by="2 hours", by=["x"])
    batches = [[hour(1, 1), hour(9, 2), (None, 5, "a")], [hour(2, 4), hour(8, 8), hour(30, 16)], [hour(1, 32, "b"), hour(27, 64), hour(29, 128)], []]
    for i, rows in enumerate(batches):
        job.write(frame(rows), i)
        job.write(frame(rows), i)
    got = {(str(r["start"]), r["x"]): (r["n"], r["events"], r["late_rows"]) for r in job.totals(spark).collect()}
    at = lambda h: f"2024-01-{1 + h // 24:02d} {h % 24:02d}:00:00"
    assert got == {(at(1), "a"): (1, 1, 0), (at(9), "a"): (2, 1, 0), (at(2), "a"): (4, 1, 1), (at(8), "a"): (8, 1, 0), (at(30), "a"): (16, 1, 0),
                   (at(1), "b"): (32, 1, 1), (at(27), "a"): (64, 1, 1), (at(29), "a"): (128, 1, 0)}
    assert sorted((r["n"], r["batch_id"]) for r in job.late_rows(spark).collect()) == [(4, 1), (32, 2), (64, 2)]
