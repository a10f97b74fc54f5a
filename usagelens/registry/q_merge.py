"""Merging saved summaries of three sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import activity, distribution, merging, requests, sketches, tools
from ..plans import usage
from ..session import cut_lineage
from .core import register
from .q_compare import COST, DECOMPOSITION_SQL, FACT_VIEWS, FACTS
from .sql_views import TOKEN_SUMS, priced
from .views import Views


def _by_source(v: Views, key: str) -> DataFrame:
    """Saved totals of each source."""
    return cut_lineage(requests.totals_by_key(v.request_sources, key, key, ["source"]), "saved")


@register("mg01_merge_models", "SELECT * FROM v_model_totals", ["v_model_totals"])
def _(v: Views) -> DataFrame:
    return merging.merge_keyed_totals(_by_source(v, "model"), "model")


@register("mg01_merge_tiers", f"SELECT tier, count(*) AS requests, {TOKEN_SUMS} FROM v_dedup GROUP BY tier", ["v_dedup"])
def _(v: Views) -> DataFrame:
    return merging.merge_tier_totals(_by_source(v, "tier"))


@register("mg05_merge_totals", f"""
  SELECT *, input_tokens::DOUBLE / total_tokens * 100 AS input_pct, output_tokens::DOUBLE / total_tokens * 100 AS output_pct,
    cache_creation_tokens::DOUBLE / total_tokens * 100 AS cache_write_pct, cache_read_tokens::DOUBLE / total_tokens * 100 AS cache_read_pct
  FROM (SELECT count(*) AS requests, {TOKEN_SUMS} FROM v_dedup)""", ["v_dedup"], doubles=["input_pct", "output_pct", "cache_write_pct", "cache_read_pct"])
def _(v: Views) -> DataFrame:
    return merging.merge_totals(cut_lineage(requests.request_totals(v.request_sources, ["source"]), "saved"))


COUNTERS = ["files_scanned", "new_files", "lines_read", "record_lines", "corrupt_lines", "out_of_window_lines", "undated_lines"]


@register("mg05_merge_scan_counters", """
  SELECT count(DISTINCT user_id) AS files_scanned, count(DISTINCT user_id) AS new_files, count(*) AS lines_read, count(*) FILTER (WHERE kind = 'record') AS record_lines,
    count(*) FILTER (WHERE kind = 'corrupt') AS corrupt_lines, 0::BIGINT AS out_of_window_lines, 0::BIGINT AS undated_lines FROM v_lines""", ["v_lines"])
def _(v: Views) -> DataFrame:
    return merging.merge_counters(requests.scan_quality(v.parsed, by=["tier"]), COUNTERS)


@register("mg02_merge_compactions", """
  SELECT count(*) AS compactions, count(*) FILTER (WHERE trigger = 'manual') AS manual, count(*) FILTER (WHERE trigger = 'auto') AS auto,
    count(*) FILTER (WHERE trigger IS NULL) AS other, sum(dropped_tokens)::BIGINT AS dropped_tokens, sum(pre_tokens)::BIGINT AS pre_sum,
    sum(post_tokens)::BIGINT AS post_sum, sum(duration_ms)::BIGINT AS duration_sum, count(duration_ms) AS duration_count,
    sum(pre_tokens)::DOUBLE / count(*) AS avg_pre_tokens, sum(post_tokens)::DOUBLE / count(*) AS avg_post_tokens, avg(duration_ms) AS avg_duration_ms
  FROM v_compactions""", ["v_compactions"], doubles=["avg_pre_tokens", "avg_post_tokens", "avg_duration_ms"])
def _(v: Views) -> DataFrame:
    saved = tools.compaction_summary(v.compaction_events.withColumn("source", F.col("user_id") % 3), ["source"])
    return merging.merge_compactions(saved)


@register("mg02_merge_average", """
  SELECT sum(a * n) / sum(n) AS avg_pre_tokens, sum(n)::BIGINT AS compactions FROM (
    SELECT user_id % 3 AS source, avg(pre_tokens) AS a, count(*)::DOUBLE AS n FROM v_compactions GROUP BY 1)""", ["v_compactions"], doubles=["avg_pre_tokens"])
def _(v: Views) -> DataFrame:
    saved = tools.compaction_summary(v.compaction_events.withColumn("source", F.col("user_id") % 3), ["source"])
    return merging.merge_average(saved, "avg_pre_tokens", "compactions")


@register("mg03_merge_tool_payload", """
  SELECT tool, count(*) AS calls, sum(bytes)::BIGINT AS total_bytes, avg(bytes) AS mean_bytes, max(bytes) AS max_bytes,
    count(*) FILTER (WHERE is_error) AS errors FROM v_calls GROUP BY tool""", ["v_calls"], doubles=["mean_bytes"])
def _(v: Views) -> DataFrame:
    saved = tools.tool_payload_table(v.paired_turns.withColumn("source", F.col("conv_id") % 3), ["source"])
    return merging.merge_tool_payload(saved)


@register("mg04_merge_top_by_bytes", """
  SELECT source AS key, count(*) AS count, sum(n_chars)::BIGINT AS total_bytes FROM documents GROUP BY 1 ORDER BY total_bytes DESC, key LIMIT 15""")
def _(v: Views) -> DataFrame:
    """Full tables of three machines, cut after the merge."""
    documents = v.table("documents").withColumn("machine", F.col("doc_id") % 3)
    saved = documents.groupBy("machine", F.col("source").alias("key")).agg(
        F.count(F.lit(1)).alias("count"), F.sum("n_chars").alias("total_bytes")
    )
    return merging.merge_top_by_bytes(saved)


def _saved_reports(v: Views) -> dict[str, DataFrame]:
    """Totals of three machines for both windows, saved as reports are."""
    rows = v.sided.withColumn("report_id", F.col("supp_key") % 3)
    payload = v.paired_turns.withColumns({
        "side": F.when(F.col("conv_id") % 2 == 0, "baseline").otherwise("compare"), "report_id": F.col("conv_id") % 3,
    })
    compactions = v.compaction_events.withColumns({
        "side": F.when(F.col("user_id") % 3 == 0, "compare").otherwise("baseline"), "report_id": F.col("user_id") % 5,
    })
    by = ["report_id", "side"]
    cube, counted = cut_lineage(requests.usage_cube(rows, by), "cube"), F.col("requests")
    tables = {
        "models": requests.totals_by_key(cube, "model", "model", by, requests=counted),
        "agents": requests.totals_by_agent_type(cube, by=by, requests=counted),
        "tool_payload": tools.tool_payload_table(payload, by),
        "compactions": tools.compaction_summary(compactions, by),
    }
    return {name: cut_lineage(df, "saved") for name, df in tables.items()}


@register("mg06_merged_decomposition", DECOMPOSITION_SQL, ["v_models"],
          doubles=["context_reread", "fresh_context", "output_length", "start", '"end"', "change", "efficiency", "model_mix"])
def _(v: Views) -> DataFrame:
    return usage.merge_and_compare(_saved_reports(v), v.prices)["decomposition"]


@register("mg06_merged_verdict", f"""
  WITH facts AS ({FACTS}), d AS (SELECT *, {COST} AS c, coalesce(NOT skipped AND significant AND direction = 'up', false) AS up, coalesce(overlap_pct < 60, false) AS other FROM facts)
  SELECT c AS cost_change_pct, CASE WHEN c IS NULL OR abs(c) < 2 THEN 'neutral' WHEN c < 0 THEN CASE WHEN up OR other THEN 'warn' ELSE 'good' END ELSE 'bad' END AS direction,
    CASE WHEN c IS NULL THEN 'not-enough-data' WHEN c < -2 THEN CASE WHEN up THEN 'cheaper-not-better' WHEN other THEN 'cheaper-different-work' ELSE 'cheaper' END
      WHEN c > 2 THEN 'dearer' ELSE 'unchanged' END AS answer FROM d""", FACT_VIEWS, doubles=["cost_change_pct"])
def _(v: Views) -> DataFrame:
    return usage.merge_and_compare(_saved_reports(v), v.prices)["verdict"]


@register("mg07_source_table", """
  SELECT concat('r', source) AS id, mode, role, requests, CASE WHEN mode = 'baseline' THEN 'everything scanned' ELSE 'since baseline 1998-06-30' END AS window
  FROM (SELECT supp_key % 3 AS source, side AS mode, concat(side, '-side') AS role, count(*) AS requests FROM v_sided GROUP BY ALL)""", ["v_sided"])
def _(v: Views) -> DataFrame:
    """Reports of both windows, one machine's pair already merged once."""
    rows = v.sided.groupBy((F.col("supp_key") % 3).alias("m"), F.col("side").alias("mode")).agg(F.count(F.lit(1)).alias("requests"))
    described = rows.select(
        F.concat(F.lit("r"), F.col("m").cast("string")).alias("id"), "mode", F.concat("mode", F.lit("-side")).alias("role"), "requests",
        F.when(F.col("mode") == "compare", "since-baseline").alias("window_mode"), F.lit("1998-06-30").alias("window_start"), "m",
    )
    flat = merging.source_table(described.withColumn("sources", F.lit(None).cast(
        "array<struct<id:string,mode:string,role:string,requests:bigint,window:string>>")))
    nested = described.filter(F.col("m") == 2).join(flat, ["id", "mode", "role", "requests"]).groupBy("m").agg(
        F.collect_list(F.struct("id", "mode", "role", "requests", "window")).alias("sources")  # two reports
    ).select(F.lit("merged").alias("id"), F.lit("baseline").alias("mode"), F.lit("snapshot").alias("role"),
             F.lit(0).cast("bigint").alias("requests"), F.lit(None).cast("string").alias("window_mode"), F.lit("").alias("window_start"), "m", "sources")
    single = described.filter(F.col("m") != 2).withColumn("sources", F.lit(None).cast(
        "array<struct<id:string,mode:string,role:string,requests:bigint,window:string>>"))
    return merging.source_table(single.unionByName(nested))


# -- activity ------------------------------------------------------------------------------


@register("mg08_merge_daily_coverage", """
  SELECT min(d) AS first_date, max(d) AS last_date, (max(d) - min(d) + 1)::BIGINT AS calendar_days, count(*) AS active_days,
    count(*)::DOUBLE / (max(d) - min(d) + 1) * 100 AS coverage_pct, count(*) AS longest_streak, 0::BIGINT AS longest_gap
  FROM (SELECT DISTINCT ts::DATE AS d FROM events)""", doubles=["coverage_pct"], texts=["first_date", "last_date"])
def _(v: Views) -> DataFrame:
    live = v.event_series.groupBy((F.col("session_id") % 3).alias("source"), F.to_date("ts").alias("date")).agg(
        F.count_if(F.col("series") == "working").alias("working_events"), F.count_if(F.col("series") == "prompt").alias("human_prompts"))
    merged_live = merging.merge_daily(live, ["working_events", "human_prompts"])
    merged_cache = merging.merge_daily(v.cached_daily, ["message_count", "session_count", "tool_call_count"])
    return activity.calendar_coverage(activity.active_dates(merged_cache, merged_live))


@register("mg08_merge_daily", """
  SELECT ts::DATE AS date, count(*) FILTER (WHERE event_type <> 'signup') AS working_events, count(*) FILTER (WHERE event_type = 'signup') AS human_prompts FROM events GROUP BY 1""", texts=["date"])
def _(v: Views) -> DataFrame:
    live = v.event_series.groupBy((F.col("session_id") % 3).alias("source"), F.to_date("ts").alias("date")).agg(
        F.count_if(F.col("series") == "working").alias("working_events"), F.count_if(F.col("series") == "prompt").alias("human_prompts"))
    return merging.merge_daily(live, ["working_events", "human_prompts"])


@register("mg09_merge_hours", """
  SELECT r.h AS hour, count(e.h) FILTER (WHERE e.series = 'working') AS working, count(e.h) FILTER (WHERE e.series = 'prompt') AS prompt
  FROM range(24) r(h) LEFT JOIN (SELECT hour(ts) AS h, series FROM v_series) e ON e.h = r.h GROUP BY r.h""", ["v_series"], ints=["hour"])
def _(v: Views) -> DataFrame:
    parts = [activity.hour_counts(v.event_series.filter(F.col("session_id") % 3 == i)) for i in range(3)]
    merged = merging.merge_slots(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    return activity.hour_profile(merged).select("hour", "working", "prompt")


@register("mg09_merge_weekdays", """
  SELECT series, slot, n, occurrences FROM (
    SELECT series, dayofweek(ts) AS slot, count(*) AS n FROM v_series GROUP BY ALL)
  JOIN (SELECT series, dayofweek(x) AS slot, count(*) AS occurrences FROM (SELECT series, unnest(generate_series(min(ts::DATE), max(ts::DATE), INTERVAL 1 DAY)) AS x FROM v_series GROUP BY series) GROUP BY ALL)
    USING (series, slot)""", ["v_series"], ints=["slot"])
def _(v: Views) -> DataFrame:
    sources = [v.event_series.filter(F.col("session_id") % 3 == i) for i in range(3)]
    counts, spans = [activity.weekday_counts(s) for s in sources], [activity.series_spans(s) for s in sources]
    merged = merging.merge_slots(counts[0].unionByName(counts[1]).unionByName(counts[2]))
    span = merging.merge_spans(spans[0].unionByName(spans[1]).unionByName(spans[2]))
    return merged.join(activity.weekday_occurrences(span), ["series", "slot"])


@register("mg09_merge_months", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS prompts FROM orders GROUP BY 1")
def _(v: Views) -> DataFrame:
    saved = v.table("orders").groupBy((F.col("o_custkey") % 3).alias("source"), F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("prompts"))
    return merging.merge_months(saved)


@register("mg09_prompt_source", "SELECT 'transcripts' AS prompt_source, count(DISTINCT user_id % 3) AS sources FROM events")
def _(v: Views) -> DataFrame:
    sources = v.table("events").select((F.col("user_id") % 3).alias("source")).distinct().withColumn(
        "prompt_source", F.when(F.col("source") < 2, "history").otherwise("transcripts"))
    return merging.merge_prompt_source(sources).join(sources.groupBy(F.lit("transcripts").alias("prompt_source")).agg(
        F.count(F.lit(1)).alias("sources")), "prompt_source")


@register("mg10_merge_scalars", """
  SELECT count(*) AS prompts, NULL::BIGINT AS unknown_total, min(ts) AS first_ts, max(ts) AS last_ts, true AS has_cache,
    first(session_id ORDER BY seconds DESC, session_id DESC) AS longest_id, max(seconds) AS seconds
  FROM (SELECT *, epoch_us(max(ts) OVER (PARTITION BY user_id)) // 1000000 - epoch_us(min(ts) OVER (PARTITION BY user_id)) // 1000000 AS seconds, user_id AS session_id FROM events)""",
          texts=["first_ts", "last_ts"])
def _(v: Views) -> DataFrame:
    per_user = v.table("events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    second = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    per_source = per_user.withColumn("seconds", second("b") - second("a")).groupBy((F.col("user_id") % 3).alias("source")).agg(
        F.sum("n").alias("prompts"), F.min("a").alias("first_ts"), F.max("b").alias("last_ts"),
        F.max_by("user_id", F.struct("seconds", "user_id")).alias("longest_id"), F.max("seconds").alias("seconds"),
    ).withColumns({"unknown_total": F.lit(None).cast("bigint"), "has_cache": F.col("source") == 1})
    return merging.merge_scalars(per_source, ["prompts"], ["unknown_total"], ["first_ts"], ["last_ts"], ["has_cache"], ("longest_id", "seconds"))


@register("so02_union_of_lists", """
  SELECT DISTINCT bucket, label AS labels FROM (SELECT c_nationkey % 3 AS bucket, unnest([c_mktsegment, concat('n', c_nationkey)]) AS label FROM customer)""")
def _(v: Views) -> DataFrame:
    rows = v.table("customer").select((F.col("c_nationkey") % 3).alias("bucket"),
                                      F.array("c_mktsegment", F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))).alias("labels"))
    return merging.union_distinct(rows, "labels", ["bucket"])


@register("mg11_identity_count", "SELECT count(DISTINCT o_custkey) AS identities FROM orders")
def _(v: Views) -> DataFrame:
    rows = v.table("orders").select(F.array(F.sha2(F.col("o_custkey").cast("string"), 256)).alias("identity_keys"), F.lit(5).alias("identity_count"))
    return merging.identity_count(rows)


# -- distribution summaries --------------------------------------------------------------------


def _source_metrics(v: Views) -> tuple[DataFrame, DataFrame]:
    """Summary and stored sample (5,000 at most) per source and metric."""
    metrics = v._metrics(v.request_sources, ["source"])
    summary = distribution.distribution_summary(metrics, "value", ["metric", "source"]).withColumn("sampled", F.col("n") > 5000)
    return summary, distribution.hashed_sample(metrics, ["row_key"], 5000, ["metric", "source"])


SOURCE_METRICS = """
  WITH src AS (SELECT *, supp_key % 3 AS source FROM v_dedup), metrics AS (
    SELECT source, 'tokens per request' AS metric, message_id AS row_key, total_tokens::DOUBLE AS value FROM src
    UNION ALL SELECT source, 'tokens per session', session_id::VARCHAR, sum(total_tokens)::DOUBLE FROM src GROUP BY source, session_id
    UNION ALL SELECT source, 'tokens per active hour', strftime(date_trunc('hour', ts), '%Y-%m-%d %H'), sum(total_tokens)::DOUBLE FROM src GROUP BY source, 3),
  summary AS (SELECT metric, source, count(*) AS n, sum(value) AS sum, min(value) AS min, max(value) AS max FROM metrics GROUP BY ALL),
  raw AS (SELECT *, n::DOUBLE / total * target AS share FROM (SELECT *, sum(n) OVER (PARTITION BY metric) AS total, least(5000, sum(n) OVER (PARTITION BY metric)) AS target FROM summary)),
  quotas AS (SELECT *, floor(share)::BIGINT + CASE WHEN row_number() OVER (PARTITION BY metric ORDER BY share - floor(share) DESC, source) <= target - sum(floor(share)) OVER (PARTITION BY metric) THEN 1 ELSE 0 END AS quota FROM raw),
  drawn AS (SELECT m.* FROM (SELECT *, row_number() OVER (PARTITION BY metric, source ORDER BY md5(concat(row_key, ':', '0')), row_key) AS turn FROM metrics) m
    JOIN quotas q USING (metric, source) WHERE turn <= least(q.quota, 5000))"""


@register("ag12_merge_quotas", SOURCE_METRICS + " SELECT metric, source, n, quota FROM quotas", ["v_dedup"], ints=["quota"])
def _(v: Views) -> DataFrame:
    return distribution.merge_quotas(_source_metrics(v)[0], by=["metric"])


@register("ag12_weighted_merge_sample", SOURCE_METRICS + " SELECT metric, source, row_key, value FROM drawn", ["v_dedup"], doubles=["value"])
def _(v: Views) -> DataFrame:
    summary, sample = _source_metrics(v)
    return distribution.weighted_merge_sample(summary, sample, ["row_key"])


@register("ag11_merge_summaries", SOURCE_METRICS + """
  SELECT e.*, s.* EXCLUDE (metric), s.sample_n < e.n OR a.any_sampled AS sampled, e.n < 20 OR s.sample_n < 20 AS low_confidence FROM (
    SELECT metric, sum(n)::BIGINT AS n, sum(sum) AS sum, sum(sum) / sum(n) AS mean, min(min) AS min, max(max) AS max FROM summary GROUP BY metric) e
  JOIN (SELECT metric, count(*) AS sample_n, stddev_samp(value) AS stdev, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75,
    quantile_cont(value, 0.85) AS p85, quantile_cont(value, 0.95) AS p95 FROM drawn GROUP BY metric) s USING (metric)
  JOIN (SELECT metric, bool_or(n > 5000) AS any_sampled FROM summary GROUP BY metric) a USING (metric)""", ["v_dedup"],
          doubles=["sum", "mean", "stdev", "p50", "p75", "p85", "p95", "min", "max"])
def _(v: Views) -> DataFrame:
    summary, sample = _source_metrics(v)
    return distribution.merge_summaries(summary, sample, ["row_key"])


@register("ag11_merged_sketches", """
  SELECT metric, percentile, n, true AS within FROM (SELECT metric, count(*) AS n FROM v_metrics GROUP BY metric), (VALUES ('p05'), ('p50'), ('p75'), ('p95')) p(percentile)""", ["v_metrics"])
def _(v: Views) -> DataFrame:
    """Percentiles of merged sketches of three sources, held against the ranks of all values."""
    wanted = {"p05": 0.05, "p50": 0.5, "p75": 0.75, "p95": 0.95}
    values = cut_lineage(v.metrics.select("metric", "row_key", "value"), "metric-values")
    stored = sketches.quantile_sketches(values.withColumn("source", F.pmod(F.xxhash64("row_key"), F.lit(3))), by=["source", "metric"])
    merged = sketches.percentiles_of(sketches.merge_quantiles(stored, ["metric"]), wanted, ["metric"])
    long = cut_lineage(merged.select("metric", "n", "rank_error", F.inline(F.array(*[F.struct(F.lit(k).alias("percentile"), F.lit(p).alias("p"), F.col(k).alias("at")) for k, p in wanted.items()]))), "sketch-percentiles")
    both = values.join(long, "metric").groupBy("metric", "percentile", "n", "rank_error", "p").agg((F.count_if(F.col("value") < F.col("at")) / F.col("n")).alias("below"), (F.count_if(F.col("value") <= F.col("at")) / F.col("n")).alias("upto"))
    return both.select("metric", "percentile", "n", ((F.col("below") - F.col("rank_error") <= F.col("p")) & (F.col("p") <= F.col("upto") + F.col("rank_error"))).alias("within"))


@register("mg10_united_distinct", "SELECT tier, count(DISTINCT session_id) AS sessions, count(DISTINCT model) AS models FROM v_dedup GROUP BY tier", ["v_dedup"])
def _(v: Views) -> DataFrame:
    """Sessions and models of three sources that overlap, counted once each."""
    stored = v.request_sources.groupBy("source", "tier").agg(sketches.distinct_sketch("session_id").alias("sessions"), sketches.distinct_sketch("model").alias("models"))
    united = sketches.merge_distinct(cut_lineage(stored, "distinct"), ["sessions", "models"], ["tier"])
    return united.select("tier", *[sketches.distinct_count(c).cast("bigint").alias(c) for c in ("sessions", "models")])


@register("mg05_merged_cost_and_scan", f"""
  WITH p AS ({priced("v_model_totals")}), l AS (SELECT * FROM v_lines)
  SELECT 'cost' AS figure, sum(cost) AS value FROM p UNION ALL SELECT 'unpriced_requests', coalesce(sum(requests) FILTER (WHERE NOT priced), 0)::DOUBLE FROM p
  UNION ALL SELECT 'tokens_per_request', sum(total_tokens)::DOUBLE / sum(requests) FROM p
  UNION ALL SELECT 'standing_spend', sum(cost) FROM p
  UNION ALL SELECT 'input_pct', sum(input_tokens)::DOUBLE / sum(total_tokens) * 100 FROM p
  UNION ALL SELECT 'lines_read', count(*)::DOUBLE FROM l UNION ALL SELECT 'corrupt_lines', count(*) FILTER (WHERE kind = 'corrupt')::DOUBLE FROM l""",
          ["v_model_totals", "v_prices", "v_lines"], doubles=["value"])
def _(v: Views) -> DataFrame:
    """Saved totals and scans of three machines: cost, profile, standing, shares and scan counters of the merged window."""
    rows = v.request_sources.withColumnRenamed("source", "report_id")
    # one pass over the deduplicated rows; the totals of a report come from it
    cube, counted = cut_lineage(requests.usage_cube(rows, ["report_id"]), "cube"), F.col("requests")
    tables = {
        "models": requests.totals_by_key(cube, "model", "model", ["report_id"], requests=counted),
        "agents": requests.totals_by_agent_type(cube, by=["report_id"], requests=counted),
        "totals": requests.request_totals(cube, ["report_id"], requests=counted),
        "scan": requests.scan_quality(v.parsed.withColumn("report_id", F.pmod(F.xxhash64("file_path"), F.lit(3))), by=["report_id"]),
    }
    merged = usage.merge_usage_tables({n: cut_lineage(df, "saved") for n, df in tables.items()}, prices=v.prices)
    one = lambda name, column, figure: merged[name].select(F.lit(figure).alias("figure"), F.col(column).cast("double").alias("value"))
    spend = merged["standing"].where("metric = 'spend'").select(F.lit("standing_spend").alias("figure"), F.col("value").cast("double").alias("value"))
    return reduce(DataFrame.unionByName, [
        one("cost", "cost", "cost"), one("cost", "unpriced_requests", "unpriced_requests"), one("profile", "tokens_per_request", "tokens_per_request"), spend,
        one("shares", "input_pct", "input_pct"), one("scan", "lines_read", "lines_read"), one("scan", "corrupt_lines", "corrupt_lines")])
