"""Activity over time: hour and weekday profiles, prompts, sessions, daily series and coverage.

Two series run through this module: `working` (assistant lines and tool results) and `prompt` (lines a
person typed). Slot profiles take `(series, slot, n)` counts, so stored counts of several sources can be
summed and profiled again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import calendar as cal
from ..functions.numeric import pct, pct_or_zero, ratio
from ..functions.text import worktree_label
from ..functions.tokens import TOKENS, TokenColumns, total_tokens
from .requests import keep_largest

WORKING, PROMPT = "working", "prompt"


# ---------------------------------------------------------------------------
# slots


def slot_counts(events: DataFrame, slot: Column, series: str = "series") -> DataFrame:
    """Events per series and slot."""
    return events.filter(slot.isNotNull()).groupBy(series, slot.cast("int").alias("slot")).agg(
        F.count(F.lit(1)).alias("n")
    )


def hour_counts(events: DataFrame, ts: str = "ts", tz: str = "UTC", series: str = "series") -> DataFrame:
    return slot_counts(events, cal.local_hour(ts, tz), series)


def weekday_counts(events: DataFrame, ts: str = "ts", tz: str = "UTC", series: str = "series") -> DataFrame:
    return slot_counts(events, cal.local_weekday(ts, tz), series)


def prefer_prompt_log(transcript_counts: DataFrame, prompt_counts: DataFrame) -> DataFrame:
    """Prompt series from the prompt log when that has any row, otherwise from the transcripts.

    Adds `source` ('history' or 'transcripts') to the prompt rows.
    """
    has_log = prompt_counts.agg(F.count(F.lit(1)) > 0).scalar()
    from_log = prompt_counts.select(F.lit(PROMPT).alias("series"), "slot", "n", F.lit("history").alias("source"))
    rest = transcript_counts.withColumn("_log", has_log).filter(
        (F.col("series") != PROMPT) | ~F.col("_log")
    ).select("series", "slot", "n", F.lit("transcripts").alias("source"))
    return rest.unionByName(from_log)


def _slots(counts: DataFrame, slots: int) -> DataFrame:
    """All slots with both series, zero where absent."""
    wide = counts.groupBy("slot").agg(
        F.sum(F.when(F.col("series") == WORKING, F.col("n"))).alias(WORKING),
        F.sum(F.when(F.col("series") == PROMPT, F.col("n"))).alias(PROMPT),
    )
    spine = counts.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot"))
    return spine.join(wide, "slot", "left").fillna(0, [WORKING, PROMPT])


def hour_profile(counts: DataFrame) -> DataFrame:
    """24 rows: both series with their share of their own total, and the calendar bands."""
    every = Window.partitionBy()  # 24 rows
    return _slots(counts, 24).select(
        F.col("slot").alias("hour"), WORKING, PROMPT,
        pct_or_zero(WORKING, F.sum(WORKING).over(every)).alias("working_pct"),
        pct_or_zero(PROMPT, F.sum(PROMPT).over(every)).alias("prompt_pct"),
        cal.is_business_hour("slot").alias("business_hours"),
        cal.is_late_night("slot").alias("late_night"),
    )


def hour_summary(profile: DataFrame) -> DataFrame:
    """Totals, hours used, spread over the day and the business-hours share of the working series."""
    business = F.coalesce(F.sum(F.when(F.col("business_hours"), F.col(WORKING))), F.lit(0))
    return profile.agg(
        F.sum(WORKING).alias("total_working"),
        F.sum(PROMPT).alias("total_prompts"),
        F.count_if(F.col(WORKING) > 0).alias("hours_with_activity"),
        pct(business, F.sum(WORKING)).alias("business_hours_pct"),
    ).withColumn("hour_spread_pct", F.col("hours_with_activity") / 24 * 100).withColumn(
        "spread", cal.hour_spread_band("hour_spread_pct")
    )


def series_spans(events: DataFrame, ts: str = "ts", tz: str = "UTC", series: str = "series") -> DataFrame:
    """First and last local calendar date of each series."""
    day = F.to_date(cal.local_timestamp(ts, tz))
    return events.groupBy(series).agg(F.min(day).alias("first_date"), F.max(day).alias("last_date"))


def weekday_occurrences(spans: DataFrame, by: Sequence[str] = ("series",)) -> DataFrame:
    """How often each weekday occurred in the span of each row; nothing for inverted spans.

    Counted arithmetically: full weeks plus the days of the remainder, so a span is never expanded.
    """
    days = cal.inclusive_days("first_date", "last_date")
    first_day = F.dayofweek("first_date") - 1
    weekday = F.explode(F.sequence(F.lit(0), F.lit(6))).alias("slot")
    usable = spans.filter(F.col("last_date") >= F.col("first_date"))
    offset = F.pmod(F.col("slot") - F.col("_start"), F.lit(7))
    return usable.select(*by, days.alias("_days"), first_day.alias("_start"), weekday).select(
        *by, "slot",
        (F.floor(F.col("_days") / 7) + F.when(offset < F.col("_days") % 7, 1).otherwise(0)).cast("bigint")
        .alias("occurrences"),
    )


def weekday_profile(counts: DataFrame, spans: DataFrame) -> DataFrame:
    """7 rows: both series, shares of own total, and events per calendar day of that weekday.

    The denominators count calendar days of each series' own span, not active days.
    """
    every = Window.partitionBy()  # 7 rows
    occurrences = weekday_occurrences(spans).groupBy("slot").agg(
        F.max(F.when(F.col("series") == WORKING, F.col("occurrences"))).alias("working_days"),
        F.max(F.when(F.col("series") == PROMPT, F.col("occurrences"))).alias("prompt_days"),
    )
    return _slots(counts, 7).join(occurrences, "slot", "left").select(
        F.col("slot").alias("day"), cal.is_weekend("slot").alias("weekend"), WORKING, PROMPT,
        pct_or_zero(WORKING, F.sum(WORKING).over(every)).alias("working_pct"),
        pct_or_zero(PROMPT, F.sum(PROMPT).over(every)).alias("prompt_pct"),
        "working_days", "prompt_days",
        ratio(WORKING, "working_days").alias("working_per_day"),
        ratio(PROMPT, "prompt_days").alias("prompt_per_day"),
        F.lit(100 / 7).alias("even_pct"),
    )


def weekday_split(profile: DataFrame) -> DataFrame:
    """Weekday against weekend for each series.

    `weekend_intensity_pct` is the rate of a weekend day in percent of the rate of a weekday. Busiest ties
    go to the lowest day, quietest ties to the highest.
    """
    long = profile.select("day", "weekend", F.inline(F.array(
        F.struct(F.lit(WORKING).alias("series"), F.col(WORKING).alias("n"), F.col("working_days").alias("days")),
        F.struct(F.lit(PROMPT).alias("series"), F.col(PROMPT).alias("n"), F.col("prompt_days").alias("days")),
    )))
    on = lambda c, weekend: F.sum(F.when(F.col("weekend") == weekend, F.col(c)))
    sums = long.groupBy("series").agg(
        F.sum("n").alias("total"),
        on("n", False).alias("weekday_total"),
        on("n", True).alias("weekend_total"),
        on("days", False).alias("weekday_days"),
        on("days", True).alias("weekend_days"),
        F.max_by("day", F.struct("n", -F.col("day"))).alias("busiest_day"),
        F.max("n").alias("busiest_n"),
        F.min_by("day", F.struct("n", -F.col("day"))).alias("quietest_day"),
        F.min("n").alias("quietest_n"),
        F.count_if(F.col("n") > 0).alias("days_with_activity"),
    )
    weekday_rate, weekend_rate = ratio("weekday_total", "weekday_days"), ratio("weekend_total", "weekend_days")
    return sums.select(
        "series", "total", "weekday_total", "weekend_total",
        pct("weekday_total", "total").alias("weekday_pct"),
        pct("weekend_total", "total").alias("weekend_pct"),
        "weekday_days", "weekend_days",
        weekday_rate.alias("weekday_per_day"), weekend_rate.alias("weekend_per_day"),
        (ratio(weekend_rate, weekday_rate) * 100).alias("weekend_intensity_pct"),
        "busiest_day", "busiest_n", pct("busiest_n", "total").alias("busiest_pct"),
        "quietest_day", "quietest_n", "days_with_activity",
    ).withColumn("weekend", cal.weekend_band("weekend_intensity_pct"))


# ---------------------------------------------------------------------------
# prompts


def prompt_hours(prompts: DataFrame, ts: str = "ts", tz: str = "UTC") -> DataFrame:
    """24 rows of prompts per local hour with share and bands."""
    counts = slot_counts(prompts.withColumn("series", F.lit(PROMPT)), cal.local_hour(ts, tz))
    return prompt_profile(counts.select(F.col("slot").alias("hour"), F.col("n").alias("prompts")))


def prompt_profile(counts: DataFrame) -> DataFrame:
    """The same 24 rows from counts `(hour, prompts)` that were stored or merged."""
    slots = counts.select(F.lit(PROMPT).alias("series"), F.col("hour").alias("slot"), F.col("prompts").alias("n"))
    return hour_profile(slots).select("hour", F.col(PROMPT).alias("prompts"), F.col("prompt_pct").alias("pct"), "business_hours", "late_night")


def prompt_hour_summary(hours: DataFrame) -> DataFrame:
    """Peak hour (ties to the earliest), late-night and business shares, hours used."""
    total = F.sum("prompts")
    when = lambda flag: F.coalesce(F.sum(F.when(F.col(flag), F.col("prompts"))), F.lit(0))
    return hours.agg(
        total.alias("total"),
        F.max_by("hour", F.struct("prompts", -F.col("hour"))).alias("peak_hour"),
        F.max("prompts").alias("peak_prompts"),
        pct(F.max("prompts"), total).alias("peak_pct"),
        F.count_if(F.col("prompts") > 0).alias("hours_with_activity"),
        when("late_night").alias("late_night_prompts"),
        pct(when("late_night"), total).alias("late_night_pct"),
        when("business_hours").alias("business_prompts"),
        pct(when("business_hours"), total).alias("business_pct"),
    ).filter(F.col("total") > 0).withColumn(
        "hour_spread_pct", F.col("hours_with_activity") / 24 * 100
    ).withColumn("late_night", cal.late_night_band("late_night_pct"))


def prompt_scalars(prompts: DataFrame, ts: str = "ts", display: str = "display", session: str = "session_id",
                   project: str = "project") -> DataFrame:
    """Entries, slash commands, distinct sessions and projects, and the span."""
    present = lambda c: F.when(F.col(c) != "", F.col(c))
    return prompts.agg(
        F.count(F.lit(1)).alias("entries"),
        F.count_if(F.startswith(F.col(display), F.lit("/"))).alias("slash_commands"),
        F.countDistinct(present(session)).alias("sessions"),
        F.countDistinct(present(project)).alias("projects"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
    ).withColumn("span_days", cal.span_days("first_ts", "last_ts"))


def prompts_by_month(prompts: DataFrame, ts: str = "ts") -> DataFrame:
    return prompts.groupBy(cal.utc_month(ts).alias("month")).agg(F.count(F.lit(1)).alias("prompts"))


# ---------------------------------------------------------------------------
# days and sessions


def daily_activity(events: DataFrame, ts: str = "ts", series: str = "series", session: str = "session_id",
                   tier: str = "tier") -> DataFrame:
    """Working events, prompts and main sessions started per UTC date, for dates with a counted event.

    A session starts on the date of its smallest timestamp over all its lines, whatever their series.
    """
    counts = events.filter(F.col(series).isin(WORKING, PROMPT)).groupBy(cal.utc_date(ts).alias("date")).agg(
        F.count_if(F.col(series) == WORKING).alias("working_events"),
        F.count_if(F.col(series) == PROMPT).alias("human_prompts"),
    ).filter(F.col("date").isNotNull())
    started = (
        events.filter((F.col(tier) == "main") & F.col(ts).isNotNull())
        .groupBy(session).agg(F.min(ts).alias("_start"))
        .groupBy(cal.utc_date("_start").alias("date")).agg(F.count(F.lit(1)).alias("sessions_started"))
    )
    return counts.join(started, "date", "left").fillna(0, ["sessions_started"])


def session_rollup(lines: DataFrame, session: str = "session_id", ts: str = "ts", tier: str = "tier",
                   tool_calls: str = "tool_calls") -> DataFrame:
    """First and last time, duration, lines and tool calls of every main session."""
    return lines.filter(F.col(tier) == "main").groupBy(session).agg(
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
        F.count(F.lit(1)).alias("lines"),
        F.coalesce(F.sum(tool_calls), F.lit(0)).alias("tool_calls"),
    ).withColumn("duration_seconds", cal.seconds_between("first_ts", "last_ts"))


def session_summary(sessions: DataFrame, session: str = "session_id") -> DataFrame:
    """Dated sessions: count, total and average duration, and the longest (ties to the lowest id)."""
    dated = sessions.filter(F.col("duration_seconds").isNotNull())
    return dated.agg(
        F.count(F.lit(1)).alias("sessions"),
        F.coalesce(F.sum("duration_seconds"), F.lit(0.0)).alias("total_seconds"),
        F.max("duration_seconds").alias("longest_seconds"),
        F.min(F.struct(-F.col("duration_seconds"), F.col(session).alias("id"))).alias("_longest"),
    ).select(
        "sessions", "total_seconds", ratio("total_seconds", "sessions").alias("average_seconds"),
        F.col("_longest.id").alias("longest_session"), "longest_seconds",
    )


def daily_model_tokens(requests: DataFrame, ts: str = "ts", model: str = "model", key: str = "message_id",
                       order: Sequence[str] = ("file_path", "line_no"), tokens: TokenColumns = TOKENS) -> DataFrame:
    """Token sums per UTC date and model after max-wins deduplication, on the date of the winning row."""
    usable = requests.filter(F.col(ts).isNotNull() & F.col(model).isNotNull())
    kept = keep_largest(usable, key, order=order, tokens=tokens)
    return kept.groupBy(cal.utc_date(ts).alias("date"), model).agg(
        *[F.sum(c).alias(c) for c in tokens.counts], F.sum(total_tokens(tokens)).alias("total_tokens")
    )


def uncovered(daily: DataFrame, last_covered: DataFrame, date: str = "date", column: str = "last_computed_date") -> DataFrame:
    """Rows of days the cache does not cover; all rows without a cache."""
    last = last_covered.agg(F.max(column)).scalar()
    return daily.withColumn("_last", last).filter(F.col("_last").isNull() | (F.col(date) > F.col("_last"))).drop("_last")


def all_time_model_totals(cached: DataFrame, live_daily: DataFrame, last_covered: DataFrame, model: str = "model",
                          tokens: TokenColumns = TOKENS) -> DataFrame:
    """Cached totals plus live days the cache does not cover, per model with a grand-total row (null model)."""
    live = uncovered(live_daily, last_covered).select(model, *tokens.counts, F.lit(True).alias("_live"))
    both = cached.select(model, *tokens.counts, F.lit(False).alias("_live")).unionByName(live)
    total = total_tokens(tokens)
    return both.rollup(model).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in tokens.counts],
        F.coalesce(F.sum(total), F.lit(0)).alias("total_tokens"),
        F.coalesce(F.sum(F.when(F.col("_live"), total)), F.lit(0)).alias("live_tokens"),
        F.grouping(model).alias("is_total"),
    )


def cache_staleness(last_computed: DataFrame, live_dates: DataFrame, as_of: Column, date: str = "date",
                    column: str = "last_computed_date", max_age_days: int = 2) -> DataFrame:
    """Age of the cache and the days neither it nor the live data can cover."""
    oldest = live_dates.agg(F.min(date)).scalar()
    return last_computed.agg(F.max(column).alias(column)).withColumn("oldest_live_date", oldest).filter(
        F.col(column).isNotNull()
    ).withColumn("days_since_computed", F.datediff(as_of, F.col(column))).withColumn(
        "unrecoverable_days",
        F.greatest(F.lit(0), cal.inclusive_days(column, "oldest_live_date") - 2),
    ).withColumn("too_stale", F.col("days_since_computed") > max_age_days)


def active_dates(cached_daily: DataFrame | None = None, live_daily: DataFrame | None = None,
                 by: Sequence[str] = ()) -> DataFrame:
    """Distinct dates with activity, of a cached series, a live one, or both."""
    parts = []
    if cached_daily is not None:
        parts.append(cached_daily.filter((F.col("message_count") > 0) | (F.col("session_count") > 0)).select(*by, "date"))
    if live_daily is not None:
        parts.append(live_daily.filter((F.col("working_events") > 0) | (F.col("human_prompts") > 0)).select(*by, "date"))
    dates = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return dates.distinct()


def calendar_coverage(dates: DataFrame, date: str = "date", by: Sequence[str] = ()) -> DataFrame:
    """First and last day, calendar and active days, coverage, longest streak and longest silent gap.

    Runs of consecutive days share `date - row_number`. A partition holds distinct dates, so at most the
    days of the calendar span, even without `by`.
    """
    distinct = dates.select(*by, F.col(date).alias("_day")).filter(F.col("_day").isNotNull()).distinct()
    window = Window.partitionBy(*by).orderBy("_day")
    marked = distinct.select(
        *by, "_day",
        F.date_sub("_day", F.row_number().over(window)).alias("_island"),
        (F.datediff("_day", F.lag("_day").over(window)) - 1).alias("_gap"),
    )
    islands = marked.groupBy(*by, "_island").agg(
        F.count(F.lit(1)).alias("_length"), F.min("_day").alias("_from"), F.max("_day").alias("_to"),
        F.max("_gap").alias("_gap"),
    )
    covered = islands.groupBy(*by).agg(
        F.min("_from").alias("first_date"), F.max("_to").alias("last_date"), F.sum("_length").alias("active_days"),
        F.max("_length").alias("longest_streak"), F.coalesce(F.max("_gap"), F.lit(0)).alias("longest_gap"),
    ).filter(F.col("first_date").isNotNull())
    calendar = cal.inclusive_days("first_date", "last_date")
    return covered.select(
        *by, "first_date", "last_date", calendar.cast("bigint").alias("calendar_days"), "active_days",
        pct("active_days", calendar).alias("coverage_pct"), "longest_streak", "longest_gap",
    )


def corpus_counters(files: DataFrame, project: str = "project", tier: str = "tier", run: str = "run_id",
                    file: str = "file_path") -> DataFrame:
    """Distinct projects, working-copy labels, workflow runs and agent files of a corpus."""
    of = lambda t, c: F.countDistinct(F.when(F.col(tier) == t, F.col(c)))
    # lines of a file say the same: one row per file before the distinct counts multiply the rows
    return files.select(project, tier, run, file).distinct().agg(
        F.countDistinct(project).alias("projects"),
        F.countDistinct(worktree_label(project)).alias("worktree_labels"),
        of("workflow-agent", run).alias("workflow_runs"),
        of("subagent", file).alias("subagent_files"),
        of("workflow-agent", file).alias("workflow_agent_files"),
    )


def project_list(files: DataFrame, project: str = "project") -> DataFrame:
    """Distinct projects, one row each."""
    return files.select(F.col(project).alias("project")).where("project is not null").distinct()


def worktree_list(files: DataFrame, project: str = "project") -> DataFrame:
    """Distinct working-copy labels, one row each."""
    return files.select(worktree_label(project).alias("label")).where("label is not null").distinct()
