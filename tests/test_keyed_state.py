"""Keyed state: equal to the batch result over late batches, silent without growth, bounded by timers."""

import pytest

from usagelens.operators import requests
from usagelens.streaming import jobs, state

SNAPSHOT = "message_id string, file_path string, line_no long, ts timestamp, input_tokens long, output_tokens long, cache_creation_tokens long, cache_read_tokens long, model string"
EVENT = "id string, event string, is_result boolean, ts timestamp"


@pytest.fixture
def stream(spark, tmp_path):
    """Append rows as one file and run the job on what is new."""

    def run(kind, build, mode, rows):
        df = spark.createDataFrame(rows, kind.replace("timestamp", "string"))
        df.selectExpr(*[f"CAST({c} AS timestamp) AS {c}" if c == "ts" else c for c in df.columns]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        with state.rocksdb_state(spark):
            jobs.run_available(build(source), jobs.batch_writer(str(tmp_path / "out")), str(tmp_path / "check"), mode)
        return jobs.read_batches(spark, str(tmp_path / "out"))

    return run


def snap(m, line, day, tokens, file="f"):
    return (m, file, line, f"2024-01-{day:02d} 00:00:00", tokens, 0, None, 0, "x")


def test_largest_snapshots_over_late_batches(spark, stream, tmp_path):
    build = lambda s: state.growing_snapshots(s, late_by="10 days", keep_for_ms=2 * 86_400_000)
    batches = [
        [snap("a", 1, 5, 5), snap("a", 2, 5, 7), snap("b", 1, 5, 1), snap(None, 1, 5, 9), snap("t", 4, 5, 3)],
        [snap("a", 3, 4, 6), snap("b", 2, 3, 9), snap("t", 2, 5, 3)],  # late rows: smaller, larger, equal at an earlier place
        [snap("a", 9, 2, 70, "e"), snap("c", 1, 6, 0)],
    ]
    seen = []
    for rows in batches:
        out = stream(SNAPSHOT, build, "update", rows)
        seen.append(out.count())
    assert seen == [3, 3 + 2, 5 + 2]  # b and t, then a and c; a smaller snapshot says nothing
    best = {r["message_id"]: (r["input_tokens"], r["file_path"], r["line_no"]) for r in jobs.latest_updates(out, ["message_id"]).collect()}
    whole = spark.createDataFrame([r for b in batches for r in b if r[0]], SNAPSHOT.replace("timestamp", "string"))
    want = {r["message_id"]: (r["input_tokens"], r["file_path"], r["line_no"]) for r in requests.keep_largest(whole, "message_id", order=("file_path", "line_no")).collect()}
    assert best == want
    # a row far ahead moves the watermark: timers clear what lies behind it
    held = lambda: {r["key"]["message_id"] for r in spark.read.format("statestore").option("stateVarName", "best").load(str(tmp_path / "check")).collect()}
    assert held() == {"a", "b", "c", "t"}
    stream(SNAPSHOT, build, "update", [snap("d", 1, 30, 1)])
    assert held() == {"d"}


def event(i, name, is_result, hour):
    return (i, name, is_result, f"2024-01-{1 + hour // 24:02d} {hour % 24:02d}:00:00")


def test_first_result_consumes_the_call(stream):
    build = lambda s: state.consuming_pairs(s, ["id"], late_by="0 seconds", keep_for_ms=5 * 3_600_000)
    found = lambda df: {(r["id"], r["kind"], r["call"], r["result"]) for r in df.collect()}
    out = stream(EVENT, build, "append", [event("x", "r0", True, 1), event("x", "c1", False, 2), event("x", "r1", True, 3), event("x", "r2", True, 4), event("y", "c2", False, 5), event("z", "c4", False, 5), event("y", "c3", False, 6)])
    first = {("x", "pair", "c1", "r1"), ("y", "orphan", "c2", None)}
    assert found(out) == first
    out = stream(EVENT, build, "append", [event("y", "r3", True, 7), event("y", "r4", True, 8)])  # c3 was pending across the edge
    assert found(out) == first | {("y", "pair", "c3", "r3")}
    # the watermark still stands at the batch before, so c4 is pending
    out = stream(EVENT, build, "append", [event("w", "c9", False, 40), event("z", "r9", True, 41)])
    assert found(out) == first | {("y", "pair", "c3", "r3"), ("z", "pair", "c4", "r9")}
    out = stream(EVENT, build, "append", [event("v", "c10", False, 90)])
    assert ("w", "orphan", "c9", None) in found(out)
    calls = [r["call"] for r in out.collect()]
    assert sorted(calls) == ["c1", "c2", "c3", "c4", "c9"]  # each comes out once
