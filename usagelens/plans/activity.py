"""The activity dashboard and merges of saved activity reports, as sets of tidy tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators import activity, commits, merging, pricing, requests, tools
from ..session import cut_lineage
from ..sources import transcripts


class StaleCacheError(RuntimeError):
    """The usage cache is older than allowed."""


def check_cache_age(staleness: DataFrame, allow_stale: bool = False) -> None:
    """Refuse a cache that is too old, unless that is allowed. Reads one row."""
    row = staleness.first()
    if row is not None and row["too_stale"] and not allow_stale:
        raise StaleCacheError(f"the usage cache was computed {row['days_since_computed']} days ago")


def activity_tables(
    parsed: DataFrame,
    prices: DataFrame,
    prompts: DataFrame | None = None,
    cached_daily: DataFrame | None = None,
    cached_models: DataFrame | None = None,
    last_computed: DataFrame | None = None,
    classified_commits: DataFrame | None = None,
    as_of: Column | None = None,
    tz: str = "UTC",
) -> dict[str, DataFrame]:
    """All tables of the dashboard from parsed lines and the optional sources.

    Parsed rows are written once as narrow tables (activity, calls, requests); every table below reads one of
    them. The prompt series prefers the prompt log, and each series keeps its own span.
    """
    lines = cut_lineage(transcripts.activity_rows(parsed), "activity")
    calls = cut_lineage(transcripts.tool_calls(transcripts.block_rows(parsed, synthetic=True), None), "tool-calls")
    rows = cut_lineage(transcripts.request_rows(parsed), "requests")
    counted = lines.filter(F.col("series").isNotNull())

    hours, days = activity.hour_counts(counted, tz=tz), activity.weekday_counts(counted, tz=tz)
    # both series have the span of all lines: found once, then named twice
    span = activity.series_spans(lines.filter(F.col("ts").isNotNull()).withColumn("series", F.lit("all")), tz=tz)
    spans = span.withColumn("series", F.explode(F.array(F.lit(activity.WORKING), F.lit(activity.PROMPT))))
    daily = activity.daily_activity(lines)
    tables: dict[str, DataFrame] = {}
    if prompts is not None:
        prompt_rows = prompts.withColumn("series", F.lit(activity.PROMPT))
        hours = activity.prefer_prompt_log(hours, activity.hour_counts(prompt_rows, tz=tz))
        days = activity.prefer_prompt_log(days, activity.weekday_counts(prompt_rows, tz=tz))
        log_span = activity.series_spans(prompt_rows, tz=tz)
        without_log = spans.join(log_span.select("series"), "series", "left_anti")
        spans = without_log.unionByName(log_span)
        prompt_hours = activity.prompt_hours(prompts, tz=tz)
        tables |= {
            "prompt_hours": prompt_hours,
            "prompt_summary": activity.prompt_hour_summary(prompt_hours),
            "prompt_scalars": activity.prompt_scalars(prompts),
            "prompt_months": activity.prompts_by_month(prompts),
        }
    hour_profile, week = activity.hour_profile(hours), activity.weekday_profile(days, spans)

    model_days = activity.daily_model_tokens(rows)
    uncovered = daily if last_computed is None else activity.uncovered(daily, last_computed)
    if cached_models is None or last_computed is None:
        totals = model_days.groupBy("model").agg(*[F.sum(c).alias(c) for c in (
            "input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "total_tokens")])
    else:
        totals = activity.all_time_model_totals(cached_models, model_days, last_computed).filter("is_total = 0")
    unknown = F.lit(None).cast("bigint")  # neither source counts requests or the cache-write split per model
    priced = pricing.price_models(cut_lineage(totals.withColumns({
        "requests": F.lit(0).cast("bigint"), "cache_creation_5m_tokens": unknown, "cache_creation_1h_tokens": unknown,
    }), "all-time"), prices)
    sessions = activity.session_rollup(lines)
    files = transcripts.transcript_files(lines.withColumnRenamed("session_id", "file_session_id"))
    tables |= {
        "hours": hour_profile,
        "hour_summary": activity.hour_summary(hour_profile),
        "weekday_counts": days,
        "spans": spans,
        "weekdays": week,
        "weekday_split": activity.weekday_split(week),
        "daily": uncovered,
        "live_daily": daily,
        "coverage": activity.calendar_coverage(activity.active_dates(cached_daily, uncovered)),
        "sessions": sessions,
        "session_summary": activity.session_summary(sessions),
        "models": priced,
        "cost": pricing.cost_totals(priced),
        "tools": tools.tool_use_counts(calls),
        "tool_counters": tools.tool_use_counters(calls),
        "corpus": activity.corpus_counters(files).withColumn(
            "skills_injected", transcripts.injected_skills(transcripts.attachment_rows(parsed)).scalar()),
        # the names behind two of the counts, so that a merge can unite them
        "projects": activity.project_list(files),
        "worktree_list": activity.worktree_list(files),
        "prompt_source": lines.sparkSession.range(1).select(F.lit("transcripts" if prompts is None else "history").alias("prompt_source")),
        "scan": requests.scan_quality(parsed),
    }
    if cached_daily is not None:
        tables["cached_daily"] = cached_daily
    if last_computed is not None and as_of is not None:
        tables["staleness"] = activity.cache_staleness(last_computed, daily, as_of)
    if classified_commits is not None:
        rollup = commits.commit_rollup(classified_commits)
        commit_days = commits.commit_daily(classified_commits)
        tables |= {
            "repos": commits.contributing(rollup),
            "commit_totals": commits.overall_rollup(rollup),
            "commit_daily": commit_days,
            "commit_monthly": commits.commit_monthly(commit_days),
        }
    return tables


def merge_activity_tables(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Saved activity tables of several machines (`report_id`) as one report: counts are summed and every
    share, rate, streak and gap is built again from them."""
    hours = tables["hours"].select(F.inline(F.array(*[
        F.struct(F.lit(s).alias("series"), F.col("hour").alias("slot"), F.col(s).alias("n"))
        for s in (activity.WORKING, activity.PROMPT)
    ])))
    profile = activity.hour_profile(merging.merge_slots(hours))
    # cached and live days are merged apart; a day is covered if either has it
    live = tables["live_daily"] if "live_daily" in tables else tables["daily"]
    daily = merging.merge_daily(live, ["working_events", "human_prompts", "sessions_started"])
    cached = None
    if "cached_daily" in tables:
        cached = merging.merge_daily(tables["cached_daily"], ["message_count", "session_count", "tool_call_count"])
    merged = {
        "hours": profile,
        "hour_summary": activity.hour_summary(profile),
        "daily": daily,
        "coverage": activity.calendar_coverage(activity.active_dates(cached, daily)),
        "tools": merging.merge_counters(tables["tools"], ["calls"], ["tool"]),
        "models": merging.merge_keyed_totals(tables["models"], "model"),
    }
    if cached is not None:
        merged["cached_daily"] = cached
    if "weekday_counts" in tables:
        week = activity.weekday_profile(merging.merge_slots(tables["weekday_counts"]), merging.merge_spans(tables["spans"]))
        merged |= {"weekdays": week, "weekday_split": activity.weekday_split(week)}
    if "prompt_months" in tables:
        merged["prompt_months"] = merging.merge_months(tables["prompt_months"])
    if "sessions" in tables:
        merged["sessions"] = tables["sessions"].drop("report_id")  # a session is of one machine
        merged["session_summary"] = activity.session_summary(merged["sessions"])
    if "prompt_hours" in tables:
        merged["prompt_hours"] = activity.prompt_profile(merging.merge_counters(tables["prompt_hours"], ["prompts"], ["hour"]))
        merged["prompt_summary"] = activity.prompt_hour_summary(merged["prompt_hours"])
    if "prompt_scalars" in tables:
        span = merging.merge_scalars(tables["prompt_scalars"], ["entries", "slash_commands", "sessions"], minima=["first_ts"], maxima=["last_ts"])
        merged["prompt_scalars"] = span.withColumn("span_days", cal.span_days("first_ts", "last_ts"))
    if "prompt_source" in tables:
        merged["prompt_source"] = merging.merge_prompt_source(tables["prompt_source"])
    for name in ("tool_counters", "corpus", "scan"):
        if name in tables:
            counters = [c for c, kind in tables[name].dtypes if kind in ("bigint", "int") and c != "report_id"]
            merged[name] = merging.merge_counters(tables[name], counters)
    # a project or label on two machines counts once: the lists are united, and counted again
    for name, column in (("projects", "project"), ("worktree_list", "label")):
        if name in tables:
            merged[name] = tables[name].select(column).distinct()
    if "projects" in tables and "corpus" in merged:
        merged["corpus"] = merged["corpus"].withColumn("projects", merged["projects"].agg(F.count(F.lit(1))).scalar())
    if "worktree_list" in tables and "corpus" in merged:
        merged["corpus"] = merged["corpus"].withColumn("worktree_labels", merged["worktree_list"].agg(F.count(F.lit(1))).scalar())
    if "commit_daily" in tables:
        merged["commit_daily"] = merging.merge_commit_daily(tables["commit_daily"], "report_id")
        merged["commit_monthly"] = commits.commit_monthly(merged["commit_daily"].drop("report_id"))
    return merged
