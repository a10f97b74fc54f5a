"""Activity profiles, prompts, sessions, days and coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators import activity, findings, incremental, pricing, requests
from ..plans import activity as plan
from ..session import cut_lineage, shared_path
from .core import register
from .sql_views import cost
from .views import CACHE_END, Views

TZ = "America/New_York"
LOCAL = "CAST(timezone('America/New_York', timezone('UTC', ts)) AS TIMESTAMP)"


def _hours(counts: str) -> str:
    return f"""
  SELECT h AS hour, w AS working, p AS prompt, coalesce(w::DOUBLE / nullif(sum(w) OVER (), 0) * 100, 0) AS working_pct,
    coalesce(p::DOUBLE / nullif(sum(p) OVER (), 0) * 100, 0) AS prompt_pct, h >= 9 AND h < 17 AS business_hours, h >= 22 OR h < 6 AS late_night
  FROM (SELECT r.h, coalesce(max(n) FILTER (WHERE series = 'working'), 0)::BIGINT AS w, coalesce(max(n) FILTER (WHERE series = 'prompt'), 0)::BIGINT AS p
    FROM range(24) r(h) LEFT JOIN ({counts}) c ON c.slot = r.h GROUP BY r.h)"""


LOCAL_HOURS = f"SELECT series, hour({LOCAL}) AS slot, count(*) AS n FROM v_series GROUP BY ALL"
LINE_HOURS = "SELECT series, hour(line_ts) AS slot, count(*) AS n FROM v_lines WHERE series IS NOT NULL GROUP BY ALL"
PCTS = ["working_pct", "prompt_pct"]


@register("ag20_hour_of_day_local", _hours(LOCAL_HOURS), ["v_series"], doubles=PCTS, ints=["hour"])
def _(v: Views) -> DataFrame:
    return activity.hour_profile(activity.hour_counts(v.event_series, "ts", TZ))


@register("flt03_ag20_hours_of_lines", _hours(LINE_HOURS), ["v_lines"], doubles=PCTS, ints=["hour"])
def _(v: Views) -> DataFrame:
    rows = v.activity.filter(F.col("series").isNotNull())
    return activity.hour_profile(activity.hour_counts(rows))


@register("ag20_hour_summary", f"""
  SELECT *, hours_with_activity / 24.0::DOUBLE * 100 AS hour_spread_pct,
    CASE WHEN hours_with_activity / 24.0 * 100 >= 90 THEN 'around-the-clock' WHEN hours_with_activity / 24.0 * 100 >= 60 THEN 'wide' ELSE 'concentrated' END AS spread
  FROM (SELECT sum(working)::BIGINT AS total_working, sum(prompt)::BIGINT AS total_prompts, count(*) FILTER (WHERE working > 0) AS hours_with_activity,
    sum(working) FILTER (WHERE business_hours)::DOUBLE / sum(working) * 100 AS business_hours_pct FROM ({_hours(LOCAL_HOURS)}))""", ["v_series"],
          doubles=["business_hours_pct", "hour_spread_pct"])
def _(v: Views) -> DataFrame:
    return activity.hour_summary(activity.hour_profile(activity.hour_counts(v.event_series, "ts", TZ)))


@register("flt03_04_line_series", """
  SELECT series, tier, count(*) AS lines, count(DISTINCT session_id) AS sessions FROM v_lines WHERE kind <> 'corrupt' GROUP BY ALL""", ["v_lines"])
def _(v: Views) -> DataFrame:
    return v.activity.groupBy("series", "tier").agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("session_id").alias("sessions"))


WEEK = f"""
  SELECT d AS day, d IN (0, 6) AS weekend, w AS working, p AS prompt, coalesce(w::DOUBLE / nullif(sum(w) OVER (), 0) * 100, 0) AS working_pct,
    coalesce(p::DOUBLE / nullif(sum(p) OVER (), 0) * 100, 0) AS prompt_pct, working_days, prompt_days,
    w::DOUBLE / working_days AS working_per_day, p::DOUBLE / prompt_days AS prompt_per_day, 100.0 / 7 AS even_pct
  FROM (SELECT r.d, coalesce(max(n) FILTER (WHERE series = 'working'), 0)::BIGINT AS w, coalesce(max(n) FILTER (WHERE series = 'prompt'), 0)::BIGINT AS p
    FROM range(7) r(d) LEFT JOIN (SELECT series, dayofweek({LOCAL}) AS slot, count(*) AS n FROM v_series GROUP BY ALL) c ON c.slot = r.d GROUP BY r.d)
  LEFT JOIN (SELECT dayofweek(x) AS d2, count(*) FILTER (WHERE series = 'working') AS working_days, count(*) FILTER (WHERE series = 'prompt') AS prompt_days
    FROM (SELECT series, unnest(generate_series(a, b, INTERVAL 1 DAY)) AS x FROM (
      SELECT series, min(date_trunc('day', {LOCAL})) AS a, max(date_trunc('day', {LOCAL})) AS b FROM v_series GROUP BY series)) GROUP BY 1) o ON o.d2 = d"""
WEEK_DOUBLES = ["working_pct", "prompt_pct", "working_per_day", "prompt_per_day", "even_pct"]


def _week(v: Views) -> DataFrame:
    return activity.weekday_profile(activity.weekday_counts(v.event_series, "ts", TZ), activity.series_spans(v.event_series, "ts", TZ))


@register("ag21_jn11_day_of_week", WEEK, ["v_series"], doubles=WEEK_DOUBLES, ints=["day"])
def _(v: Views) -> DataFrame:
    return _week(v)


@register("ag22_weekday_split", f"""
  SELECT *, CASE WHEN weekend_intensity_pct >= 85 THEN 'no-weekend' WHEN weekend_intensity_pct >= 50 THEN 'slower' WHEN weekend_intensity_pct >= 20 THEN 'lighter'
      WHEN weekend_intensity_pct > 0 THEN 'nearly-off' WHEN weekend_intensity_pct IS NOT NULL THEN 'off' END AS weekend
  FROM (SELECT series, total, weekday_total, weekend_total, weekday_total::DOUBLE / total * 100 AS weekday_pct, weekend_total::DOUBLE / total * 100 AS weekend_pct,
    weekday_days, weekend_days, weekday_total::DOUBLE / weekday_days AS weekday_per_day, weekend_total::DOUBLE / weekend_days AS weekend_per_day,
    (weekend_total::DOUBLE / weekend_days) / (weekday_total::DOUBLE / weekday_days) * 100 AS weekend_intensity_pct,
    busiest_day, busiest_n, busiest_n::DOUBLE / total * 100 AS busiest_pct, quietest_day, quietest_n, days_with_activity
  FROM (SELECT series, sum(n)::BIGINT AS total, sum(n) FILTER (WHERE NOT wk)::BIGINT AS weekday_total, sum(n) FILTER (WHERE wk)::BIGINT AS weekend_total,
      sum(days) FILTER (WHERE NOT wk)::BIGINT AS weekday_days, sum(days) FILTER (WHERE wk)::BIGINT AS weekend_days,
      first(day ORDER BY n DESC, day) AS busiest_day, max(n) AS busiest_n, first(day ORDER BY n, day DESC) AS quietest_day, min(n) AS quietest_n,
      count(*) FILTER (WHERE n > 0) AS days_with_activity
    FROM (SELECT 'working' AS series, day, weekend AS wk, working AS n, working_days AS days FROM ({WEEK}) UNION ALL SELECT 'prompt', day, weekend, prompt, prompt_days FROM ({WEEK}))
    GROUP BY series))""", ["v_series"], doubles=["weekday_pct", "weekend_pct", "weekday_per_day", "weekend_per_day", "weekend_intensity_pct", "busiest_pct"],
          ints=["busiest_day", "quietest_day"])
def _(v: Views) -> DataFrame:
    return activity.weekday_split(_week(v))


@register("jn10_prompt_source_preference", """
  SELECT series, slot, n, CASE WHEN series = 'prompt' THEN 'history' ELSE 'transcripts' END AS source FROM (
    SELECT 'working' AS series, hour(line_ts) AS slot, count(*) AS n FROM v_lines WHERE series = 'working' GROUP BY 2
    UNION ALL SELECT 'prompt', hour(ts), count(*) FROM v_prompts GROUP BY 2)""", ["v_lines", "v_prompts"], ints=["slot"])
def _(v: Views) -> DataFrame:
    from_lines = activity.hour_counts(v.activity.filter(F.col("series").isNotNull()))
    from_log = activity.hour_counts(v.prompts.withColumn("series", F.lit("prompt")))
    return activity.prefer_prompt_log(from_lines, from_log)


# -- prompts -----------------------------------------------------------------------------

PROMPT_HOURS = """
  SELECT r.h AS hour, count(p.h) AS prompts, count(p.h)::DOUBLE / (SELECT count(*) FROM v_prompts) * 100 AS pct, r.h >= 9 AND r.h < 17 AS business_hours, r.h >= 22 OR r.h < 6 AS late_night
  FROM range(24) r(h) LEFT JOIN (SELECT hour(ts) AS h FROM v_prompts) p ON p.h = r.h GROUP BY r.h"""


@register("ag23_prompt_hours", PROMPT_HOURS, ["v_prompts"], doubles=["pct"], ints=["hour"])
def _(v: Views) -> DataFrame:
    return activity.prompt_hours(v.prompts)


@register("ag23_sc12_prompt_summary", f"""
  SELECT *, hours_with_activity / 24.0::DOUBLE * 100 AS hour_spread_pct,
    CASE WHEN late_night_pct >= 10 THEN 'substantial' WHEN late_night_pct >= 3 THEN 'recurring' ELSE 'rare' END AS late_night
  FROM (SELECT sum(prompts)::BIGINT AS total, first(hour ORDER BY prompts DESC, hour) AS peak_hour, max(prompts) AS peak_prompts, max(prompts)::DOUBLE / sum(prompts) * 100 AS peak_pct,
    count(*) FILTER (WHERE prompts > 0) AS hours_with_activity, coalesce(sum(prompts) FILTER (WHERE late_night), 0)::BIGINT AS late_night_prompts,
    coalesce(sum(prompts) FILTER (WHERE late_night), 0)::DOUBLE / sum(prompts) * 100 AS late_night_pct, coalesce(sum(prompts) FILTER (WHERE business_hours), 0)::BIGINT AS business_prompts,
    coalesce(sum(prompts) FILTER (WHERE business_hours), 0)::DOUBLE / sum(prompts) * 100 AS business_pct FROM ({PROMPT_HOURS}))""", ["v_prompts"],
          doubles=["peak_pct", "late_night_pct", "business_pct", "hour_spread_pct"], ints=["peak_hour"])
def _(v: Views) -> DataFrame:
    return activity.prompt_hour_summary(activity.prompt_hours(v.prompts))


@register("ag23_prompt_scalars", """
  SELECT count(*) AS entries, count(*) FILTER (WHERE display LIKE '/%') AS slash_commands, count(DISTINCT session_id) AS sessions, count(DISTINCT project) AS projects,
    min(ts) AS first_ts, max(ts) AS last_ts, greatest(1, floor(epoch(max(ts) - min(ts)) / 86400 + 0.5))::BIGINT AS span_days FROM v_prompts""", ["v_prompts"],
          texts=["first_ts", "last_ts"])
def _(v: Views) -> DataFrame:
    return activity.prompt_scalars(v.prompts)


@register("ag24_prompts_by_month", "SELECT strftime(ts, '%Y-%m') AS month, count(*) AS prompts FROM v_prompts GROUP BY 1", ["v_prompts"])
def _(v: Views) -> DataFrame:
    return activity.prompts_by_month(v.prompts)


# -- days, sessions ------------------------------------------------------------------------


@register("ag25_daily_activity", """
  SELECT c.date, working_events, human_prompts, coalesce(sessions_started, 0) AS sessions_started FROM (
    SELECT line_ts::DATE AS date, count(*) FILTER (WHERE series = 'working') AS working_events, count(*) FILTER (WHERE series = 'prompt') AS human_prompts
    FROM v_lines WHERE series IS NOT NULL GROUP BY 1) c
  LEFT JOIN (SELECT s::DATE AS date, count(*) AS sessions_started FROM (
    SELECT session_id, min(line_ts) AS s FROM v_lines WHERE tier = 'main' AND kind <> 'corrupt' AND line_ts IS NOT NULL GROUP BY 1) GROUP BY 1) s USING (date)""",
          ["v_lines"], texts=["date"])
def _(v: Views) -> DataFrame:
    return activity.daily_activity(v.activity)


SESSIONS = """
  SELECT session_id, min(line_ts) AS first_ts, max(line_ts) AS last_ts, count(*) AS lines, count(*) FILTER (WHERE event_type = 'click') AS tool_calls,
    epoch_us(max(line_ts))::DOUBLE / 1e6 - epoch_us(min(line_ts))::DOUBLE / 1e6 AS approx, (epoch_us(max(line_ts)) - epoch_us(min(line_ts)))::DOUBLE / 1e6 AS duration_seconds
  FROM v_lines WHERE tier = 'main' AND kind <> 'corrupt' GROUP BY session_id"""


@register("ag26_session_rollup", f"SELECT * EXCLUDE (approx) FROM ({SESSIONS})", ["v_lines"], doubles=["duration_seconds"], texts=["first_ts", "last_ts"])
def _(v: Views) -> DataFrame:
    return activity.session_rollup(v.activity)


@register("ag26_session_summary", f"""
  SELECT count(*) AS sessions, sum(duration_seconds) AS total_seconds, sum(duration_seconds) / count(*) AS average_seconds,
    first(session_id ORDER BY duration_seconds DESC, session_id) AS longest_session, max(duration_seconds) AS longest_seconds FROM ({SESSIONS}) WHERE duration_seconds IS NOT NULL""",
          ["v_lines"], doubles=["total_seconds", "average_seconds", "longest_seconds"])
def _(v: Views) -> DataFrame:
    summary = activity.session_summary(activity.session_rollup(v.activity))
    return summary


AG27_SQL = """
  SELECT ts::DATE AS date, model, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(cache_creation_tokens)::BIGINT AS cache_creation_tokens,
    sum(cache_read_tokens)::BIGINT AS cache_read_tokens, sum(total_tokens)::BIGINT AS total_tokens FROM v_dedup GROUP BY ALL"""


@register("ag27_daily_model_tokens", AG27_SQL, ["v_dedup"], texts=["date"])
def _(v: Views) -> DataFrame:
    return activity.daily_model_tokens(v.requests, order=("ts", "part_key", "supp_key"))


MODEL_DAYS = """
  SELECT ts::DATE AS date, event_type AS model, sum(k)::BIGINT AS input_tokens, sum(event_id % 50)::BIGINT AS output_tokens, sum(user_id % 7)::BIGINT AS cache_creation_tokens,
    sum(k * 20)::BIGINT AS cache_read_tokens FROM v_events GROUP BY ALL"""
ALL_TIME = f"""
  SELECT model, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(cache_creation_tokens)::BIGINT AS cache_creation_tokens,
    sum(cache_read_tokens)::BIGINT AS cache_read_tokens, sum(t)::BIGINT AS total_tokens, coalesce(sum(t) FILTER (WHERE date > DATE '{CACHE_END}'), 0)::BIGINT AS live_tokens,
    grouping(model)::BIGINT AS is_total
  FROM (SELECT *, input_tokens + output_tokens + cache_creation_tokens + cache_read_tokens AS t FROM ({MODEL_DAYS})) GROUP BY ROLLUP (model)"""


def _all_time(v: Views) -> DataFrame:
    """Cached days up to the end of the cache, live days for the whole window: the overlap counts once."""
    daily = v.event_model_daily
    end = F.lit(CACHE_END).cast("date")
    cached = daily.filter(F.col("date") <= end).drop("date")
    covered = daily.filter(F.col("date") <= end).agg(F.max("date").alias("last_computed_date"))
    return activity.all_time_model_totals(cached, daily, covered)


@register("ag28_all_time_totals", ALL_TIME, ["v_events"])
def _(v: Views) -> DataFrame:
    return _all_time(v)


@register("flt07_uncovered_days", f"SELECT ts::DATE AS date, count(*) AS events FROM v_events WHERE ts::DATE > DATE '{CACHE_END}' GROUP BY 1", ["v_events"], texts=["date"])
def _(v: Views) -> DataFrame:
    live = v.events.groupBy(F.to_date("ts").alias("date")).agg(F.count(F.lit(1)).alias("events"))
    return activity.uncovered(live, v.cached_daily.agg(F.max("date").alias("last_computed_date")))


@register("ag40_cache_staleness", """
  SELECT last_computed_date, oldest_live_date, days_since_computed, greatest(0, oldest_live_date - last_computed_date + 1 - 2)::BIGINT AS unrecoverable_days, days_since_computed > 2 AS too_stale
  FROM (SELECT max(ts::DATE) FILTER (WHERE ts::DATE <= DATE '2024-01-10') AS last_computed_date, min(ts::DATE) FILTER (WHERE ts::DATE >= DATE '2024-01-15') AS oldest_live_date,
    (DATE '2024-02-01' - max(ts::DATE) FILTER (WHERE ts::DATE <= DATE '2024-01-10'))::BIGINT AS days_since_computed FROM events)""",
          texts=["last_computed_date", "oldest_live_date"])
def _(v: Views) -> DataFrame:
    last = v.cached_daily.agg(F.max("date").alias("last_computed_date"))
    live = v.event_daily.filter(F.col("date") >= F.lit("2024-01-15").cast("date"))
    return activity.cache_staleness(last, live, F.lit("2024-02-01").cast("date"))


# -- coverage --------------------------------------------------------------------------------


def _coverage(days: str, by: str = "") -> str:
    lead, part = (f"{by}, ", f"PARTITION BY {by}") if by else ("", "")
    group = f"GROUP BY {by}" if by else ""
    return f"""
  SELECT {lead} min(f) AS first_date, max(t) AS last_date, (max(t) - min(f) + 1)::BIGINT AS calendar_days, sum(len)::BIGINT AS active_days,
    sum(len)::DOUBLE / (max(t) - min(f) + 1) * 100 AS coverage_pct, max(len) AS longest_streak, coalesce(max(gap), 0)::BIGINT AS longest_gap
  FROM (SELECT {lead} island, count(*) AS len, min(d) AS f, max(d) AS t, max(gap) AS gap FROM (
    SELECT {lead} d, d - (row_number() OVER ({part} ORDER BY d))::INTEGER AS island, d - lag(d) OVER ({part} ORDER BY d) - 1 AS gap FROM ({days}))
    GROUP BY {lead} island) {group}"""


@register("wn01_calendar_coverage", _coverage("SELECT DISTINCT user_id, ts::DATE AS d FROM v_prompts", "user_id"), ["v_prompts"],
          doubles=["coverage_pct"], texts=["first_date", "last_date"])
def _(v: Views) -> DataFrame:
    return activity.calendar_coverage(v.prompts.select("user_id", F.to_date("ts").alias("date")), by=["user_id"])


@register("wn01_coverage_of_orders", _coverage("SELECT DISTINCT o_custkey, o_orderdate::DATE AS d FROM orders", "o_custkey"),
          doubles=["coverage_pct"], texts=["first_date", "last_date"])
def _(v: Views) -> DataFrame:
    """Customers order rarely, so there are long gaps to find."""
    return activity.calendar_coverage(v.table("orders").select("o_custkey", F.to_date("o_orderdate").alias("date")), by=["o_custkey"])


@register("so01_flt09_active_dates", f"""
  SELECT DISTINCT d AS date FROM (SELECT ts::DATE AS d FROM v_events WHERE ts::DATE <= DATE '{CACHE_END}' UNION ALL SELECT ts::DATE FROM v_series)""",
          ["v_events", "v_series"], texts=["date"])
def _(v: Views) -> DataFrame:
    return activity.active_dates(v.cached_daily, v.event_daily)


# -- scan quality, scoreboard, calendar functions --------------------------------------------


@register("ag30_scan_quality", """
  SELECT count(DISTINCT user_id) AS files_scanned, count(DISTINCT user_id) FILTER (WHERE user_id >= 20) AS new_files, count(*) AS lines_read,
    count(*) FILTER (WHERE kind = 'record') AS record_lines, count(*) FILTER (WHERE kind = 'corrupt') AS corrupt_lines,
    count(*) FILTER (WHERE kind NOT IN ('corrupt', 'synthetic') AND line_ts <= TIMESTAMP '2024-01-15') AS out_of_window_lines,
    count(*) FILTER (WHERE kind NOT IN ('corrupt', 'synthetic') AND line_ts IS NULL) AS undated_lines FROM v_lines""", ["v_lines"])
def _(v: Views) -> DataFrame:
    known = v.lines.filter(F.regexp_extract("file_session_id", r"(\d+)", 1).cast("int") < 20).select("file_path")
    return requests.scan_quality(v.parsed, since=F.lit("2024-01-15").cast("timestamp_ntz").cast("timestamp"), known_files=known)


@register("sc04_calendar_keys", f"""
  SELECT event_id, hour({LOCAL}) AS local_hour, dayofweek({LOCAL}) AS local_weekday, ts::DATE AS utc_date, strftime(ts, '%Y-%m') AS utc_month FROM events""",
          ints=["local_hour", "local_weekday"], texts=["utc_date"])
def _(v: Views) -> DataFrame:
    return v.table("events").select(
        "event_id", cal.local_hour("ts", TZ).alias("local_hour"), cal.local_weekday("ts", TZ).alias("local_weekday"),
        cal.utc_date("ts").alias("utc_date"), cal.utc_month("ts").alias("utc_month"),
    )


@register("sc10_spans", """
  SELECT o_custkey, (max(o_orderdate)::DATE - min(o_orderdate)::DATE + 1)::BIGINT AS inclusive_days,
    greatest(1, floor(epoch(max(o_orderdate) - min(o_orderdate)) / 86400 + 0.5))::BIGINT AS span_days FROM orders GROUP BY o_custkey""")
def _(v: Views) -> DataFrame:
    spans = v.table("orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    return spans.select("o_custkey", cal.inclusive_days("a", "b").cast("bigint").alias("inclusive_days"), cal.span_days("a", "b").alias("span_days"))


@register("rl08_scoreboard", f"""
  WITH t AS (SELECT * FROM ({ALL_TIME}) WHERE is_total = 0), p AS (
    SELECT t.*, 5.0::DOUBLE AS input_rate, 25.0::DOUBLE AS output_rate, 0.1::DOUBLE AS cache_read_multiplier, NULL::BIGINT AS cache_creation_5m_tokens, NULL::BIGINT AS cache_creation_1h_tokens FROM t)
  SELECT 'sessions' AS metric, count(DISTINCT user_id)::DOUBLE AS value FROM events
  UNION ALL SELECT 'messages', count(*)::DOUBLE FROM events
  UNION ALL SELECT 'longest_session_seconds', max(duration_seconds) FROM ({SESSIONS})
  UNION ALL SELECT 'tokens', sum(total_tokens)::DOUBLE FROM t
  UNION ALL SELECT 'spend', sum({cost('false')}) FROM p
  UNION ALL SELECT 'prompts', count(*)::DOUBLE FROM v_prompts""", ["v_events", "v_prompts", "v_lines"], doubles=["value"])
def _(v: Views) -> DataFrame:
    totals = cut_lineage(_all_time(v).filter(F.col("is_total") == 0).select(
        "*", F.lit(0).cast("bigint").alias("requests"),
        *[F.lit(None).cast("bigint").alias(c) for c in ("cache_creation_5m_tokens", "cache_creation_1h_tokens")],
    ), "all-time")
    spend = pricing.cost_totals(pricing.price_models(totals, v.prices))
    everything = v.events.agg(F.countDistinct("user_id").alias("sessions"), F.count(F.lit(1)).alias("messages"))
    return findings.scoreboard({
        "sessions": (everything, "sessions"),
        "messages": (everything, "messages"),
        "longest_session_seconds": (activity.session_summary(activity.session_rollup(v.activity)), "longest_seconds"),
        "tokens": (totals.agg(F.sum("total_tokens").alias("tokens")), "tokens"),
        "spend": (spend, "cost"),
        "prompts": (activity.prompt_scalars(v.prompts), "entries"),
    })


#: Tables of the dashboard and a column whose sum stands for each (None: rows only).
PLAN_SUMS = {
    "hours": "working", "weekday_counts": "n", "spans": None, "weekdays": "working", "live_daily": "working_events", "coverage": "active_days", "sessions": "lines",
    "session_summary": "sessions", "models": "total_tokens", "tools": "calls", "tool_counters": "edit_lines_removed", "corpus": "subagent_files", "projects": None,
    "worktree_list": None, "prompt_hours": "prompts", "prompt_summary": "late_night_prompts", "prompt_scalars": "entries", "prompt_months": "prompts", "prompt_source": None,
    "scan": None, "hour_summary": "total_working", "weekday_split": "total", "cost": None,
}
_LINES = "SELECT * FROM v_lines WHERE kind <> 'corrupt'"
_KEPT = """SELECT model, total_tokens FROM (SELECT concat('model-', k % 5) AS model, k + event_id % 100 + CASE WHEN k % 4 <> 3 THEN k * 10 ELSE 0 END AS total_tokens,
    row_number() OVER (PARTITION BY event_id // 3 ORDER BY k + event_id % 100 + CASE WHEN k % 4 <> 3 THEN k * 10 ELSE 0 END DESC,
      concat('/logs/projects/p', user_id % 10, '/s', user_id, CASE user_id % 3 WHEN 0 THEN '.jsonl' WHEN 1 THEN concat('/subagents/agent-a', user_id, '.jsonl')
        ELSE concat('/subagents/workflows/wf_', user_id % 4, '/agent-a', user_id, '.jsonl') END), line_no) AS rn
    FROM v_lines WHERE kind = 'record' AND line_ts IS NOT NULL) WHERE rn = 1"""


def _plan_sql(times: int, merged: bool) -> str:
    """Rows and sums of the tables; counters are `times` those of one machine, lists and dates are united."""
    part = lambda name, n, total="0": f"SELECT '{name}' AS table_name, ({n})::BIGINT AS n_rows, ({total})::BIGINT AS total"
    main, working = f"FROM ({_LINES}) WHERE tier = 'main'", "(SELECT count(*) FROM v_lines WHERE series = 'working')"
    prompts, days = "(SELECT count(*) FROM v_prompts)", "(SELECT count(DISTINCT line_ts::DATE) FROM v_lines WHERE series IS NOT NULL)"
    dated = f"(SELECT count(*) FROM (SELECT session_id {main} GROUP BY session_id HAVING max(line_ts) IS NOT NULL))"
    slots = "(SELECT count(DISTINCT dayofweek(line_ts)) FROM v_lines WHERE series = 'working') + (SELECT count(DISTINCT dayofweek(ts)) FROM v_prompts)"
    out = [
        part("hours", 24, f"{times} * {working}"), part("hour_summary", 1, f"{times} * {working}"), part("weekdays", 7, f"{times} * {working}"),
        part("weekday_split", 2, f"{times} * ({working} + {prompts})"),
        part("coverage", 1, days), part("sessions", f"{times} * (SELECT count(DISTINCT session_id) {main})", f"{times} * (SELECT count(*) {main})"),
        part("session_summary", 1, f"{times} * {dated}"),
        part("models", f"SELECT count(DISTINCT model) FROM ({_KEPT})", f"{times} * (SELECT sum(total_tokens) FROM ({_KEPT}))"),
        part("tools", "SELECT count(DISTINCT k % 4) FROM v_lines WHERE event_type = 'click'", f"{times} * (SELECT count(*) FROM v_lines WHERE event_type = 'click')"),
        part("tool_counters", 1, f"{times} * (SELECT count(*) FROM v_lines WHERE event_type = 'click' AND k % 4 = 2)"),
        part("corpus", 1, f"{times} * (SELECT count(DISTINCT user_id) FROM ({_LINES}) WHERE tier = 'subagent')"),
        part("projects", f"SELECT count(DISTINCT project) FROM ({_LINES})"), part("worktree_list", 0),
        part("prompt_hours", 24, f"{times} * {prompts}"),
        part("prompt_summary", 1, f"{times} * (SELECT count(*) FROM v_prompts WHERE hour(ts) >= 22 OR hour(ts) < 6)"),
        part("prompt_scalars", 1, f"{times} * {prompts}"), part("prompt_months", "SELECT count(DISTINCT date_trunc('month', ts)) FROM v_prompts", f"{times} * {prompts}"),
        part("prompt_source", 1), part("scan", 1),
    ]
    if merged:
        out.append(part("daily", days, f"{times} * {working}"))
    else:
        out += [part("weekday_counts", slots, f"{working} + {prompts}"), part("spans", 2), part("live_daily", days, working), part("cost", 1)]
    return " UNION ALL ".join(out)


def _digest(tables: dict[str, DataFrame], sums: dict[str, str | None]) -> DataFrame:
    parts = []
    for name, column in sums.items():
        total = F.coalesce(F.sum(column), F.lit(0)) if column else F.lit(0)
        parts.append(tables[name].agg(F.count(F.lit(1)).alias("n_rows"), total.cast("bigint").alias("total")).select(F.lit(name).alias("table_name"), "n_rows", "total"))
    return reduce(DataFrame.unionByName, parts)


def _dashboard(v: Views) -> dict[str, DataFrame]:
    return plan.activity_tables(v.parsed, v.prices, v.prompts)


@register("activity_plan_tables", _plan_sql(1, False), ["v_lines", "v_prompts"])
def _(v: Views) -> DataFrame:
    """Every table of the dashboard is built."""
    return _digest(_dashboard(v), PLAN_SUMS)


@register("merged_activity_plan", _plan_sql(2, True), ["v_lines", "v_prompts"])
def _(v: Views) -> DataFrame:
    """The dashboard of two machines with the same logs: counters are twice those of one, names and days count once."""
    one = {name: cut_lineage(df, f"plan-{name}") for name, df in _dashboard(v).items()}
    stored = {name: df.withColumn("report_id", F.explode(F.array(F.lit("a"), F.lit("b")))) for name, df in one.items()}
    merged = plan.merge_activity_tables(stored)
    sums = {n: c for n, c in PLAN_SUMS.items() if n not in ("weekday_counts", "spans", "live_daily", "cost")}
    return _digest(merged, {**sums, "daily": "working_events"})


@register("ag27_incremental_totals", AG27_SQL, ["v_dedup"], texts=["date"])
def _(v: Views) -> DataFrame:
    """Three batches, of which later ones hold larger snapshots of earlier ids: old days are taken back."""
    job = incremental.daily_model_totals(v.spark, shared_path(v.spark, "daily-models"), order=("ts", "part_key", "supp_key"))
    for n, part in enumerate((2, 0, 1)):
        job.apply(incremental.usable_requests(v.requests.where(F.col("supp_key") % 3 == part)), n)
    return job.totals().drop("rows")


@register("ag25_incremental_sessions", """
  SELECT s::DATE AS date, count(*) AS sessions_started FROM (SELECT session_id, min(line_ts) AS s FROM v_lines
    WHERE tier = 'main' AND kind <> 'corrupt' AND line_ts IS NOT NULL GROUP BY 1) GROUP BY 1""", ["v_lines"], texts=["date"])
def _(v: Views) -> DataFrame:
    """Lines come latest first, so every batch moves sessions to an earlier day."""
    job = incremental.session_starts(v.spark, shared_path(v.spark, "session-days"))
    lines = v.activity.where((F.col("tier") == "main") & F.col("ts").isNotNull())
    for n, (since, until) in enumerate((("2024-01-20", "2100-01-01"), ("2024-01-08", "2024-01-20"), ("1970-01-01", "2024-01-08"))):
        job.apply(lines.where((F.col("ts") >= F.lit(since).cast("timestamp")) & (F.col("ts") < F.lit(until).cast("timestamp"))), n)
    return job.totals().withColumnRenamed("rows", "sessions_started")
