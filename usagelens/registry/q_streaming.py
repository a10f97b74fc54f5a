"""Streaming jobs over the event table, run to the end and compared with the batch result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import requests
from ..session import cut_lineage, shared_path
from ..sources import growing, transcripts
from ..streaming import jobs, state
from .core import register
from .sql_views import TOKEN_SUMS
from .views import Views


class StreamViews(Views):
    """The same views with the tables read as streams."""

    def table(self, name: str) -> DataFrame:
        schema = super().table(name).schema
        return self.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(self.sf_dir)


def _run(v: Views, build, write=None, mode: str = "append") -> str:
    out = shared_path(v.spark, "stream-out")
    stream = build(StreamViews(v.spark, v.sf_dir))
    jobs.run_available(stream, write(out) if write else jobs.batch_writer(out), shared_path(v.spark, "stream-state"), mode)
    return out


@register("st01_incremental_ingest", """
  SELECT kind, count(*) AS lines, count(DISTINCT user_id) AS files FROM v_lines GROUP BY kind""", ["v_lines"])
def _(v: Views) -> DataFrame:
    """Readable and corrupt lines land in two tables; both together are all lines."""
    build = lambda s: s.parsed.select("file_path", "line_no", "kind", "ts")
    out = _run(v, build, lambda o: jobs.split_writer(f"{o}/good", f"{o}/bad", F.col("kind") == "corrupt"))
    both = jobs.read_batches(v.spark, f"{out}/good").unionByName(jobs.read_batches(v.spark, f"{out}/bad"))
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("file_path").alias("files"))


LINE_TOKENS = """
  SELECT concat('m', event_id // 3) AS message_id, concat('model-', k % 5) AS model, line_ts AS ts, user_id, line_no, file_rank,
    k AS input_tokens, event_id % 100 AS output_tokens, 0::BIGINT AS cache_creation_tokens, NULL::BIGINT AS cache_creation_5m_tokens,
    NULL::BIGINT AS cache_creation_1h_tokens, CASE WHEN k % 4 <> 3 THEN k * 10 ELSE 0 END AS cache_read_tokens,
    k + event_id % 100 + CASE WHEN k % 4 <> 3 THEN k * 10 ELSE 0 END AS total_tokens
  FROM (SELECT *, concat('/logs/projects/p', user_id % 10, '/s', user_id, CASE user_id % 3 WHEN 0 THEN '.jsonl'
      WHEN 1 THEN concat('/subagents/agent-a', user_id, '.jsonl') ELSE concat('/subagents/workflows/wf_', user_id % 4, '/agent-a', user_id, '.jsonl') END) AS file_rank
    FROM v_lines WHERE kind = 'record')"""
BEST_LINES = f"""
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY total_tokens DESC, file_rank COLLATE C, line_no) AS rn FROM ({LINE_TOKENS})) WHERE rn = 1""".replace(" COLLATE C", "")


@register("st02_streaming_max_wins", f"SELECT model, count(*) AS requests, {TOKEN_SUMS} FROM ({BEST_LINES}) GROUP BY model", ["v_lines"])
def _(v: Views) -> DataFrame:
    out = _run(v, lambda s: transcripts.request_rows(s.parsed))
    log = jobs.read_batches(v.spark, out)
    return requests.totals_by_key(jobs.current_requests(log), "model", "model")


@register("st02_running_largest", f"SELECT message_id, model, total_tokens FROM ({BEST_LINES})", ["v_lines"])
def _(v: Views) -> DataFrame:
    columns = ["message_id", "file_path", "line_no", "model", "input_tokens", "output_tokens", "cache_creation_tokens",
               "cache_creation_5m_tokens", "cache_creation_1h_tokens", "cache_read_tokens"]
    out = _run(v, lambda s: jobs.running_largest(transcripts.request_rows(s.parsed).select(*columns)), mode="update")
    best = jobs.latest_updates(jobs.read_batches(v.spark, out), ["message_id"])
    return v.totals(best).select("message_id", "model", "total_tokens")


@register("st03_hourly_windows", """
  SELECT date_trunc('hour', ts) AS start, count(*) AS events, sum(k)::BIGINT AS tokens FROM v_events GROUP BY 1""", ["v_events"], texts=["start"])
def _(v: Views) -> DataFrame:
    build = lambda s: jobs.windowed_totals(
        s.events.withColumn("ts", F.col("ts").cast("timestamp")), {"events": F.count(F.lit(1)), "tokens": F.sum("k")})
    out = _run(v, build, mode="update")
    return jobs.latest_updates(jobs.read_batches(v.spark, out), ["start"])


@register("st03_daily_windows", """
  SELECT date_trunc('day', ts) AS start, series, count(*) AS events FROM v_series GROUP BY ALL""", ["v_series"], texts=["start"])
def _(v: Views) -> DataFrame:
    build = lambda s: jobs.windowed_totals(
        s.event_series.withColumn("ts", F.col("ts").cast("timestamp")), {"events": F.count(F.lit(1))}, width="1 day", by=["series"])
    out = _run(v, build, mode="update")
    rows = jobs.latest_updates(jobs.read_batches(v.spark, out), ["start", "series"])
    return rows.withColumn("start", F.col("start").cast("timestamp_ntz"))


@register("st04_stream_pairing", """
  SELECT c.event_id // 2 AS call_id, c.event_id AS call_event, r.event_id AS result_event FROM events c JOIN events r
    ON c.event_id // 2 = r.event_id // 2 AND c.event_type IN ('click', 'view') AND r.event_type = 'purchase' AND r.ts >= c.ts AND r.ts <= c.ts + INTERVAL 1 DAY""")
def _(v: Views) -> DataFrame:
    def build(s: StreamViews) -> DataFrame:
        e = s.events.select(F.floor(F.col("event_id") / 2).alias("call_id"), "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
        calls = e.filter(F.col("event_type").isin("click", "view")).select("call_id", F.col("event_id").alias("call_event"), F.col("ts").alias("call_ts"))
        results = e.filter(F.col("event_type") == "purchase").select("call_id", F.col("event_id").alias("result_event"), F.col("ts").alias("result_ts"))
        return jobs.pair_streams(calls, results, ["call_id"])

    out = _run(v, build)
    pairs = jobs.first_result(jobs.read_batches(v.spark, out), ["call_id"])
    return pairs.select("call_id", "call_event", "result_event")


@register("st05_repeatable_window", f"""
  SELECT model, count(*) AS requests, {TOKEN_SUMS} FROM (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY total_tokens DESC, file_rank, line_no) AS rn FROM ({LINE_TOKENS}) WHERE ts > TIMESTAMP '2024-01-15') WHERE rn = 1)
  GROUP BY model""", ["v_lines"])
def _(v: Views) -> DataFrame:
    """A batch query over the streamed table: the window is content time, so asking again consumes nothing."""
    log = jobs.read_batches(v.spark, _run(v, lambda s: transcripts.request_rows(s.parsed)))
    since = F.lit("2024-01-15").cast("timestamp_ntz").cast("timestamp")
    return requests.totals_by_key(jobs.current_requests(requests.in_window(log, "ts", since)), "model", "model")


def _write_logs(v: Views, lines: DataFrame, root: str) -> None:
    """One file of lines per project, as a producer leaves it; a file that is there is replaced."""
    out = shared_path(v.spark, "log-parts")
    dealt = lines.select("project", "ts", "line_no", F.col("line").alias("value")).repartition("project").sortWithinPartitions("project", "ts", "line_no")
    dealt.select("project", "value").write.partitionBy("project").text(out)
    hadoop = v.spark._jvm.org.apache.hadoop.fs
    base = hadoop.Path(out)
    store = base.getFileSystem(v.spark._jsc.hadoopConfiguration())
    for folder in store.globStatus(hadoop.Path(out, "project=*")):  # ten at most
        name = folder.getPath().getName().split("=")[1]
        (part,) = store.globStatus(hadoop.Path(folder.getPath(), "part-*"))
        target = hadoop.Path(f"{root}/projects/{name}/{name}.jsonl")
        store.mkdirs(target.getParent())
        store.delete(target, False)
        store.rename(part.getPath(), target)


GROW_CUT = "2024-01-16"


@register("st01_growing_files", f"""
  SELECT project, CASE project WHEN 'p9' THEN 1 ELSE 0 END AS generation,
    count(*) FILTER (WHERE ts < TIMESTAMP '{GROW_CUT}' AND project <> 'p9') AS first_run,
    count(*) FILTER (WHERE CASE project WHEN 'p8' THEN false WHEN 'p9' THEN event_id % 10 = 0 ELSE ts >= TIMESTAMP '{GROW_CUT}' END) AS second_run,
    sum(event_id) FILTER (WHERE CASE project WHEN 'p8' THEN ts < TIMESTAMP '{GROW_CUT}' WHEN 'p9' THEN event_id % 10 = 0 ELSE true END AND kind <> 'corrupt')::BIGINT AS read_ids
  FROM v_lines GROUP BY project""", ["v_lines"])
def _(v: Views) -> DataFrame:
    """Two runs over files of which most grow between them, one (p8) stays as it is and one (p9) is replaced by a smaller one."""
    root, cut = shared_path(v.spark, "logs"), F.lit(GROW_CUT).cast("timestamp_ntz")
    lines = v.lines.drop("project").join(v.events.select(F.col("event_id").alias("line_no"), "ts", F.concat(F.lit("p"), (F.col("user_id") % 10).cast("string")).alias("project")), "line_no")
    # each line says its number, so that what was read can be told from what was written
    lines = lines.withColumn("line", F.concat_ws(" ", F.col("line_no").cast("string"), "line"))
    job = growing.Ingest(v.spark, root, shared_path(v.spark, "growing"), range_bytes=1 << 18)
    _write_logs(v, lines.where(F.col("ts") < cut), root)
    job.run()
    _write_logs(v, lines.where(F.when(F.col("project") == "p8", False).when(F.col("project") == "p9", F.col("line_no") % 10 == 0).otherwise(True)), root)
    job.run()
    read = job.lines().select("project", "generation", "batch", F.split("line", " ", 2)[0].cast("bigint").alias("id"))
    kinds = v.parsed.select(F.col("line_no").alias("id"), (F.col("kind") != "corrupt").alias("whole"))
    return read.join(kinds, "id").groupBy("project", "generation").agg(
        F.count_if(F.col("batch") == 1).alias("first_run"), F.count_if(F.col("batch") == 2).alias("second_run"), F.sum(F.when(F.col("whole"), F.col("id"))).alias("read_ids"))


#: Rows of a file of a batch, at least; a smaller batch is one file, with its rows in the order they came in.
FILE_ROWS = 20_000


def _in_batches(v: Views, df: DataFrame, part: Column, parts: int) -> DataFrame:
    """A stream of `df` in `parts` micro-batches, in the order of `part` (0 to parts - 1).

    Rows are made once. A batch is that many files, written by that many tasks: a reader deals its rows out in turn, so
    none of the files is empty where one reader has as many rows as there are files.
    """
    path = shared_path(v.spark, "batches")
    rows = cut_lineage(df.withColumn("_batch", part), "batch-rows")
    sizes = {r["_batch"]: r["count"] for r in rows.groupBy("_batch").count().collect()}  # one row per batch
    least = min(sizes.get(i, 0) for i in range(parts))
    files = max(1, min(least // FILE_ROWS, least // max(1, rows.rdd.getNumPartitions()), int(v.spark.conf.get("spark.sql.shuffle.partitions"))))
    for i in range(parts):  # files are taken oldest first
        batch = rows.where(F.col("_batch") == i).drop("_batch")
        (batch.coalesce(1) if files == 1 else batch.repartition(files)).write.mode("append").parquet(path)
    return v.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


@register("st02_keyed_state", f"SELECT message_id, model, total_tokens FROM ({BEST_LINES.replace(LINE_TOKENS, LINE_TOKENS + ' WHERE line_ts IS NOT NULL')})", ["v_lines"])
def _(v: Views) -> DataFrame:
    """Three batches with late and growing snapshots; the last row of a key is its largest, and no row comes without growth."""
    columns = ["message_id", "file_path", "line_no", "ts", "model", "input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens"]
    rows = transcripts.request_rows(v.parsed).where("ts IS NOT NULL").select(*columns)
    stream = _in_batches(v, rows, F.pmod(F.xxhash64("line_no"), F.lit(3)), 3)
    out = shared_path(v.spark, "stream-out")
    with state.rocksdb_state(v.spark):
        grown = state.growing_snapshots(stream, late_by="60 days", keep_for_ms=60 * 86_400_000)
        jobs.run_available(grown, jobs.batch_writer(out), shared_path(v.spark, "stream-state"), "update")
    best = jobs.latest_updates(jobs.read_batches(v.spark, out), ["message_id"])
    return v.totals(best).select("message_id", "model", "total_tokens")


@register("st04_consuming_pairs", """
  SELECT user_id, before AS call_event, event_id AS result_event FROM (
    SELECT user_id, event_id, event_type, lag(event_id) OVER w AS before, lag(event_type) OVER w AS kind_before FROM events WHERE event_type IN ('click', 'purchase')
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_type = 'purchase', event_id::VARCHAR)) WHERE event_type = 'purchase' AND kind_before = 'click'""")
def _(v: Views) -> DataFrame:
    """Calls stay pending across two batches; each is taken by the first result after it."""
    e = v.events.where(F.col("event_type").isin("click", "purchase"))
    e = e.select("user_id", F.col("event_id").alias("event"), (F.col("event_type") == "purchase").alias("is_result"), F.col("ts").cast("timestamp").alias("ts"))
    stream = _in_batches(v, e, (F.col("ts") >= F.lit(GROW_CUT).cast("timestamp")).cast("int"), 2)
    out = shared_path(v.spark, "stream-out")
    with state.rocksdb_state(v.spark):
        paired = state.consuming_pairs(stream, ["user_id"], keep_for_ms=60 * 86_400_000)
        jobs.run_available(paired, jobs.batch_writer(out), shared_path(v.spark, "stream-state"))
    pairs = jobs.read_batches(v.spark, out).where("kind = 'pair'")
    return pairs.select("user_id", F.col("call").cast("bigint").alias("call_event"), F.col("result").cast("bigint").alias("result_event"))


@register("st03_late_rows", """
  WITH parts AS (SELECT *, event_id % 3 AS part, date_trunc('hour', ts) AS start FROM v_events),
  closed AS (SELECT max(ts) FILTER (WHERE part = 0) - INTERVAL 1 DAY AS first, max(ts) FILTER (WHERE part < 2) - INTERVAL 1 DAY AS second FROM parts)
  SELECT start, count(*) AS events, sum(k)::BIGINT AS tokens,
    count(*) FILTER (WHERE start + INTERVAL 1 HOUR <= CASE part WHEN 1 THEN first WHEN 2 THEN second END) AS late_rows FROM parts, closed GROUP BY 1""", ["v_events"], texts=["start"])
def _(v: Views) -> DataFrame:
    """Three batches over the same days: rows of the later two find most windows closed, and are counted and added."""
    rows = v.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "k")
    windows = jobs.LateAwareWindows(shared_path(v.spark, "windows"), {"events": F.count(F.lit(1)), "tokens": F.sum("k")})
    jobs.run_available(_in_batches(v, rows, F.col("event_id") % 3, 3), windows.write, shared_path(v.spark, "stream-state"))
    return windows.totals(v.spark).withColumn("start", F.col("start").cast("timestamp_ntz"))
