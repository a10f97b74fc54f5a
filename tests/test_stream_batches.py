"""Micro-batches made of a table: as many as asked, rows made once, files by several tasks; state without a frame per key."""

import pytest

from usagelens.registry import q_streaming
from usagelens.registry.views import Views
from usagelens.streaming import jobs, state


@pytest.mark.parametrize("n", [4_000, 5, 0])
def test_batches_are_whole_and_in_order(spark, tmp_path, monkeypatch, n):
    monkeypatch.setattr(q_streaming, "FILE_ROWS", 100)
    rows = spark.createDataFrame([(i, i % 3 if i % 7 else None) for i in range(n)], "id long, part int")
    stream = q_streaming._in_batches(Views(spark, ""), rows, rows["part"], 3)
    seen = []
    jobs.run_available(stream, lambda b, i: seen.append((b.rdd.getNumPartitions(), sorted(r["id"] for r in b.collect()))), str(tmp_path / "check"))
    assert [ids for _, ids in seen if ids] == [ids for ids in ([i for i in range(n) if i % 7 and i % 3 == p] for p in range(3)) if ids]
    if n == 4_000:  # over a thousand rows in each batch
        assert len(seen) == 3
        files = spark.read.parquet(stream._jdf.queryExecution().analyzed().toString().split("FileSource[")[1].split("]")[0]).inputFiles()
        assert len(files) == 12  # four tasks for each batch


def test_snapshots_ask_for_their_state_once(spark, tmp_path):
    """Also with values that are null: they stay whole numbers, and positions that are null come first."""
    kind = "message_id string, file_path string, line_no long, ts timestamp, input_tokens long, output_tokens long, cache_creation_tokens long, cache_read_tokens long"
    big = (1 << 53) + 1
    rows = [("a", None, 1, "2024-01-01", big, None, None, None), ("a", "f", 1, "2024-01-01", big, None, 0, None), ("b", "f", None, "2024-01-02", 1, 2, 3, 4), ("b", "f", 2, "2024-01-02", 1, 2, 3, 4)]
    df = spark.createDataFrame(rows, kind.replace("timestamp", "string"))
    df.select(*[df[c].cast("timestamp") if c == "ts" else df[c] for c in df.columns]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
    with state.rocksdb_state(spark):
        jobs.run_available(state.growing_snapshots(stream), jobs.batch_writer(str(tmp_path / "out")), str(tmp_path / "check"), "update")
    got = {r["message_id"]: (r["file_path"], r["line_no"], r["input_tokens"], r["output_tokens"], str(r["ts"])) for r in jobs.read_batches(spark, str(tmp_path / "out")).collect()}
    assert got == {"a": (None, 1, big, None, "2024-01-01 00:00:00"), "b": ("f", None, 1, 2, "2024-01-02 00:00:00")}
