"""Sources and sinks over text built from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import commits, merging, requests
from ..plans import usage
from ..session import shared_path
from ..sources import reports, sidecars, transcripts
from .core import register
from .sql_views import TOKEN_SUMS
from .views import CACHE_END, Views


@register("src01_classified_paths", """
  SELECT DISTINCT tier, project, session_id AS file_session_id, CASE WHEN user_id % 3 > 0 THEN concat('a', user_id) END AS file_agent_id,
    CASE WHEN user_id % 3 = 2 THEN concat('wf_', user_id % 4) END AS run_id FROM v_lines""", ["v_lines"])
def _(v: Views) -> DataFrame:
    return transcripts.transcript_files(v.lines).drop("file_path")


@register("src02_complete_lines", """
  SELECT doc_id, line_no, line FROM (
    SELECT doc_id, unnest(parts[:-2]) AS line, unnest(range(len(parts) - 1)) AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))
  WHERE line <> ''""")
def _(v: Views) -> DataFrame:
    """Lines of every document; the tail after the last newline is not a complete line."""
    return transcripts.split_lines(v.table("documents").select("doc_id", F.col("text").alias("content")))


@register("src03_line_kinds", "SELECT kind, tier, count(*) AS lines, count(line_ts) FILTER (WHERE kind <> 'corrupt') AS dated FROM v_lines GROUP BY ALL", ["v_lines"])
def _(v: Views) -> DataFrame:
    return v.parsed.groupBy("kind", "tier").agg(F.count(F.lit(1)).alias("lines"), F.count("ts").alias("dated"))


@register("src03_prj01_request_rows", """
  SELECT concat('m', event_id // 3) AS message_id, line_ts AS ts, session_id, project, tier, CASE WHEN user_id % 3 > 0 THEN concat('a', user_id) END AS agent_id,
    concat('model-', k % 5) AS model, user_id % 3 <> 0 AS is_sidechain, k AS input_tokens, event_id % 100 AS output_tokens, 0::BIGINT AS cache_creation_tokens,
    NULL::BIGINT AS cache_creation_5m_tokens, CASE WHEN k % 4 <> 3 THEN k * 10 ELSE 0 END AS cache_read_tokens, line_no FROM v_lines WHERE kind = 'record'""",
          ["v_lines"], texts=["ts"])
def _(v: Views) -> DataFrame:
    return transcripts.request_rows(v.parsed).select(
        "message_id", "ts", "session_id", "project", "tier", "agent_id", "model", "is_sidechain", "input_tokens", "output_tokens",
        "cache_creation_tokens", "cache_creation_5m_tokens", "cache_read_tokens", "line_no")


@register("src04_side_file_lookup", """
  SELECT CASE WHEN user_id % 3 > 0 AND user_id % 5 > 0 THEN concat('type-', user_id % 5) END AS agent_type, count(*) AS requests FROM v_lines WHERE kind = 'record' GROUP BY 1""", ["v_lines"])
def _(v: Views) -> DataFrame:
    """Side files of the agent transcripts; every fifth is corrupt and counts as missing."""
    agents = transcripts.describe_path(v.lines.select("file_path").distinct()).filter(F.col("meta_path").isNotNull())
    number = F.regexp_extract("file_agent_id", r"(\d+)", 1).cast("int")
    text = F.when(number % 5 == 0, "{").otherwise(F.to_json(F.struct(F.concat(F.lit("type-"), (number % 5).cast("string")).alias("agentType"))))
    meta = sidecars.parse_agent_meta(agents.select(F.col("meta_path").alias("file_path"), text.alias("content")))
    return transcripts.request_rows(v.parsed, meta).groupBy("agent_type").agg(F.count(F.lit(1)).alias("requests"))


@register("src05_workflow_definitions", """
  SELECT doc_id, strlen(text)::BIGINT AS script_bytes, substr(text, 1, 200) AS script_preview, lang FROM documents""")
def _(v: Views) -> DataFrame:
    d = v.table("documents")
    texts = d.select("doc_id", F.to_json(F.struct("lang", F.col("text").alias("script"))).alias("content"))
    parsed = sidecars.parse_workflow_definitions(texts, path="doc_id")
    return parsed.select("doc_id", "script_bytes", "script_preview", F.get_json_object("fields", "$.lang").alias("lang"))


@register("ag38_workflow_totals", "SELECT count(*) AS definitions, sum(strlen(text))::BIGINT AS script_bytes FROM documents")
def _(v: Views) -> DataFrame:
    texts = v.table("documents").select("doc_id", F.to_json(F.struct(F.col("text").alias("script"))).alias("content"))
    return sidecars.workflow_totals(sidecars.parse_workflow_definitions(texts, path="doc_id"))


def _cache_text(v: Views) -> DataFrame:
    """Cached days and models as one JSON document (days and models only, so its size does not grow with rows)."""
    daily = v.cached_daily.agg(F.collect_list(F.struct(
        F.col("date").cast("string").alias("date"), F.col("message_count").alias("messageCount"),
        F.col("session_count").alias("sessionCount"), F.col("tool_call_count").alias("toolCallCount"))).alias("dailyActivity"))
    models = v.event_model_daily.groupBy("model").agg(F.sum("input_tokens").alias("i"), F.sum("cache_read_tokens").alias("c")).agg(
        F.map_from_entries(F.collect_list(F.struct("model", F.struct(F.col("i").alias("inputTokens"), F.col("c").alias("cacheReadInputTokens"))))).alias("modelUsage"))
    return daily.withColumn("modelUsage", models.scalar()).select(F.to_json(F.struct(
        F.lit(CACHE_END).alias("lastComputedDate"), "dailyActivity", "modelUsage")).alias("content"))


@register("src06_cached_daily", f"""
  SELECT ts::DATE AS date, count(*) AS message_count, count(DISTINCT user_id) AS session_count, count(*) FILTER (WHERE event_type = 'click') AS tool_call_count
  FROM events WHERE ts::DATE <= DATE '{CACHE_END}' GROUP BY 1""", texts=["date"])
def _(v: Views) -> DataFrame:
    return sidecars.cached_daily(sidecars.parse_usage_cache(_cache_text(v)))


@register("src06_cached_models", """
  SELECT event_type AS model, sum(k)::BIGINT AS input_tokens, 0::BIGINT AS output_tokens, 0::BIGINT AS cache_creation_tokens, sum(k * 20)::BIGINT AS cache_read_tokens
  FROM v_events GROUP BY 1""", ["v_events"])
def _(v: Views) -> DataFrame:
    return sidecars.cached_model_usage(sidecars.parse_usage_cache(_cache_text(v)))


@register("src07_prompt_log", """
  SELECT CASE WHEN event_type = 'error' OR k % 9 = 0 THEN NULL ELSE epoch_us(ts) // 1000 END AS ms, session_id, slash_command, count(*) AS entries FROM (
    SELECT *, CASE WHEN event_type <> 'error' THEN user_id::VARCHAR END AS session_id, CASE WHEN event_type <> 'error' THEN k % 4 = 0 END AS slash_command FROM v_events) GROUP BY ALL""", ["v_events"])
def _(v: Views) -> DataFrame:
    """Every event as a prompt line; errors are no JSON, some timestamps are text."""
    k, ms = F.col("k"), F.unix_millis(F.col("ts").cast("timestamp"))
    common = [F.when(k % 4 == 0, "/clear").otherwise("x").alias("display"), F.col("user_id").cast("string").alias("sessionId")]
    line = (
        F.when(F.col("event_type") == "error", "{oops")
        .when(k % 9 == 0, F.to_json(F.struct(ms.cast("string").alias("timestamp"), *common)))
        .otherwise(F.to_json(F.struct(ms.alias("timestamp"), *common)))
    )
    parsed = sidecars.parse_prompt_log(v.events.select(line.alias("line")))
    return parsed.groupBy(F.unix_millis("ts").alias("ms"), "session_id", "slash_command").agg(F.count(F.lit(1)).alias("entries"))


@register("src08_numstat_log", """
  SELECT l_orderkey::VARCHAR AS hash, coalesce(sum(l_quantity::BIGINT) FILTER (WHERE l_returnflag <> 'R'), 0)::BIGINT AS insertions,
    coalesce(sum(l_linenumber) FILTER (WHERE l_returnflag <> 'R'), 0)::BIGINT AS deletions, count(*) AS files_changed, count(*) FILTER (WHERE l_returnflag = 'R') AS binary_files
  FROM lineitem GROUP BY l_orderkey""")
def _(v: Views) -> DataFrame:
    """Log records written from the changed files and parsed back into rows.

    One record per file rather than per commit: nothing is gathered, and counts per commit stay the same.
    """
    entry = F.concat_ws("\t", "added", "removed", F.col("path").cast("string"))
    head = F.concat_ws(sidecars.FIELD_SEPARATOR, F.col("hash").cast("string"), F.lit("2024-01-01T00:00:00+02:00"), F.lit("A@b.example"))
    record = F.concat(F.lit(sidecars.RECORD_SEPARATOR), head, F.lit("\n\n"), entry, F.lit("\n"))
    logs = v.commit_files.select("repo", record.alias("value"))
    _, files = sidecars.parse_numstat_log(logs)
    return commits.numstat(files, ["hash"])


# -- report tables -----------------------------------------------------------------------


def _saved(v: Views) -> str:
    """Two baselines and a compare report in one store, each a window of the requests."""
    root = shared_path(v.spark, "reports")
    older, newer = v.sided.filter(F.col("side") == "baseline"), v.sided.filter(F.col("side") == "compare")
    for report, mode, rows, at in (
        ("baseline-1", "baseline", older, "1998-07-01T00:00:00Z"),
        ("baseline-2", "baseline", v.dedup, "2001-12-01T00:00:00Z"),
        ("compare-1", "compare", newer, "2002-01-01T00:00:00Z"),
    ):
        reports.save_report({"models": requests.totals_by_key(rows, "model", "model")}, root, report, mode, at)
    return root


@register("snk01_snk02_latest_baseline", "SELECT *, 'baseline-2' AS report_id FROM v_model_totals", ["v_model_totals"])
def _(v: Views) -> DataFrame:
    """The table of the latest explicit baseline: a later compare does not move the pointer."""
    root = _saved(v)
    return reports.load_table(v.spark, root, "models", [reports.latest_baseline(v.spark, root)])


@register("src09_merge_loaded_reports", f"""
  SELECT model, count(*) AS requests, {TOKEN_SUMS} FROM v_sided GROUP BY model""", ["v_sided"])
def _(v: Views) -> DataFrame:
    root = _saved(v)
    chosen = ["baseline-1", "compare-1"]
    reports.check_mergeable(v.spark, root, chosen)
    return merging.merge_keyed_totals(reports.load_table(v.spark, root, "models", chosen), "model")


@register("src09_report_of_a_window", """
  SELECT 'models' AS report_table, count(*) AS rows FROM (SELECT DISTINCT model FROM v_dedup)
  UNION ALL SELECT 'agents', count(DISTINCT coalesce(agent_type, tier)) FROM v_dedup WHERE tier <> 'main'
  UNION ALL SELECT 'tiers', 3 UNION ALL SELECT 'totals', 1 UNION ALL SELECT 'distributions', 3 UNION ALL SELECT 'intervals', 6
  UNION ALL SELECT 'counts', count(*) FROM (SELECT DISTINCT metric, value FROM v_metrics)
  UNION ALL SELECT 'samples', sum(least(n, 5000))::BIGINT FROM (SELECT metric, count(*) AS n FROM v_metrics GROUP BY metric)""", ["v_dedup", "v_metrics"])
def _(v: Views) -> DataFrame:
    """The whole baseline report saved and read back: row count of every table."""
    root = shared_path(v.spark, "reports")
    tables = usage.usage_tables(v.dedup)
    reports.save_report(tables, root, "baseline-1", "baseline", "2002-01-01T00:00:00Z")
    counted = [reports.load_table(v.spark, root, name).agg(F.lit(name).alias("report_table"), F.count(F.lit(1)).alias("rows")) for name in tables]
    out = counted[0]
    for df in counted[1:]:
        out = out.unionByName(df)
    return out
