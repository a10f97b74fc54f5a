"""Merging saved summaries of several sources without averaging averages or counting twice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import pct, ratio
from ..functions.tokens import TOKENS, TokenColumns, token_share
from .commits import derive_commit_figures
from .identity import shared_key_components
from .ranks import null_safe_join
from .requests import TIERS, request_totals, totals_by_key, totals_by_tier
from .tools import top_by_bytes, with_compaction_averages

# ---------------------------------------------------------------------------
# request reports


def merge_keyed_totals(rows: DataFrame, key: str = "model", by: Sequence[str] = (), tokens: TokenColumns = TOKENS) -> DataFrame:
    """Rows `(source, key, requests, tokens...)` of all sources summed per key; an incomplete split stays null."""
    return totals_by_key(rows, key, key, by, tokens, F.col("requests"))


def merge_tier_totals(rows: DataFrame, tiers: Sequence[str] = TIERS, tokens: TokenColumns = TOKENS) -> DataFrame:
    return totals_by_tier(rows, "tier", tiers, tokens, F.col("requests"))


def merge_totals(rows: DataFrame, by: Sequence[str] = (), tokens: TokenColumns = TOKENS) -> DataFrame:
    """Totals over all sources with the token-class shares derived again from the sums."""
    totals = request_totals(rows, by, tokens, F.col("requests"))
    return totals.withColumns({
        "input_pct": token_share(tokens.input, "total_tokens"),
        "output_pct": token_share(tokens.output, "total_tokens"),
        "cache_write_pct": token_share(tokens.cache_write, "total_tokens"),
        "cache_read_pct": token_share(tokens.cache_read, "total_tokens"),
    })


def merge_counters(rows: DataFrame, counters: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Plain sums of scan counters; missing counts as 0."""
    return rows.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters])


COMPACTION_SUMS = ("compactions", "manual", "auto", "other", "dropped_tokens",
                   "pre_sum", "post_sum", "duration_sum", "duration_count")


def merge_compactions(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Exact merge of `compaction_summary` rows, from their sums and counts."""
    return with_compaction_averages(merge_counters(rows, COMPACTION_SUMS, by))


def merge_average(rows: DataFrame, average: str, weight: str, by: Sequence[str] = ()) -> DataFrame:
    """Weighted average of saved averages, for summaries that kept no sums; null averages are skipped."""
    usable = rows.filter(F.col(average).isNotNull() & (F.col(weight) > 0))
    return usable.groupBy(*by).agg(
        ratio(F.sum(F.col(average) * F.col(weight)), F.sum(weight)).alias(average), F.sum(weight).alias(weight)
    )


def merge_tool_payload(rows: DataFrame, tool: str = "tool", by: Sequence[str] = ()) -> DataFrame:
    """Sums, the largest of the largest, and the mean derived again."""
    merged = rows.groupBy(*by, tool).agg(
        F.sum("calls").alias("calls"), F.sum("total_bytes").alias("total_bytes"),
        F.max("max_bytes").alias("max_bytes"), F.sum("errors").alias("errors"),
    )
    return merged.withColumn("mean_bytes", F.coalesce(ratio("total_bytes", "calls"), F.lit(0.0)))


def merge_top_by_bytes(rows: DataFrame, limit: int | None = 15) -> DataFrame:
    """Merged top list. Exact when the sources kept full tables, a lower bound when they were cut."""
    return top_by_bytes(rows, "key", "total_bytes", limit, F.col("count"))


def source_table(reports: DataFrame, window_mode: str = "window_mode", start: str = "window_start",
                 nested: str = "sources") -> DataFrame:
    """Provenance: one row per original source, merges of merges flattened.

    `reports(id, mode, role, requests, window_mode, window_start, sources)`; `sources` is an array of
    structs with the same fields as a row of the result, empty or null for an unmerged report.
    """
    description = (
        F.when(F.col("mode") == "baseline", "everything scanned")
        .when(F.col(window_mode) == "since-baseline", F.concat(F.lit("since baseline "), F.col(start).cast("string")))
        .when(F.col(window_mode) == "since-last-scan", F.concat(F.lit("since last scan "), F.col(start).cast("string")))
        .otherwise("unknown window")
    )
    own = F.array(F.struct(
        F.col("id").alias("id"), F.col("mode").alias("mode"), F.col("role").alias("role"),
        F.col("requests").cast("bigint").alias("requests"), description.alias("window"),
    ))
    return reports.select(F.inline(F.when(F.size(nested) > 0, F.col(nested)).otherwise(own)))


# ---------------------------------------------------------------------------
# activity reports


def merge_daily(rows: DataFrame, counters: Sequence[str], date: str = "date") -> DataFrame:
    """One daily series of all sources, summed by date. Cached and live series are merged apart."""
    return merge_counters(rows, counters, [date])


def merge_slots(rows: DataFrame) -> DataFrame:
    """Raw `(source, series, slot, n)` counts summed; shares are built from the result."""
    return rows.groupBy("series", "slot").agg(F.sum("n").alias("n"))


def merge_spans(rows: DataFrame, by: Sequence[str] = ("series",)) -> DataFrame:
    """Union of spans: a calendar day seen by two sources counts once."""
    return rows.groupBy(*by).agg(F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"))


def merge_prompt_source(rows: DataFrame, source: str = "prompt_source") -> DataFrame:
    """'history' only when every source says so."""
    return rows.agg(F.when(F.bool_and(F.col(source) == "history"), "history").otherwise("transcripts").alias(source))


def merge_months(rows: DataFrame, count: str = "prompts", month: str = "month") -> DataFrame:
    return merge_counters(rows, [count], [month])


def merge_scalars(
    rows: DataFrame,
    sums: Sequence[str] = (),
    sums_or_null: Sequence[str] = (),
    minima: Sequence[str] = (),
    maxima: Sequence[str] = (),
    any_true: Sequence[str] = (),
    longest: tuple[str, str] | None = None,
) -> DataFrame:
    """Scalars of several reports by the rule of each: sum, sum that stays null when nobody knows, min, max,
    any, and the id with the longest duration (`longest = (id, duration)`)."""
    aggregates: list[Column] = [
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums],
        *[F.sum(c).alias(c) for c in sums_or_null],
        *[F.min(c).alias(c) for c in minima],
        *[F.max(c).alias(c) for c in maxima],
        *[F.bool_or(c).alias(c) for c in any_true],
    ]
    if longest:
        ident, duration = longest
        aggregates += [F.max_by(ident, F.struct(duration, ident)).alias(ident), F.max(duration).alias(duration)]
    return rows.agg(*aggregates)


def union_distinct(rows: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct members of an array column over all sources, as rows."""
    return rows.select(*by, F.explode(column).alias(column)).distinct()


# ---------------------------------------------------------------------------
# commit reports

REPO_COUNTS = ("attributed_commits", "authored_commits", "attributed_merges",
               "insertions", "deletions", "files_changed", "binary_files")


def label_repos(repos: DataFrame, keyed: DataFrame, entry: str = "entry") -> DataFrame:
    """`repos` with the component of each entry; `keyed(entry, key)` as from `repo_keys`."""
    labels = shared_key_components(keyed, entry, "key")
    return repos.join(labels, entry, "left").withColumn("component", F.coalesce("component", entry))


def fold_repos(labelled: DataFrame, component: str = "component") -> DataFrame:
    """One row per repository: the larger view of each figure wins, dates widen, the share is derived again.

    Figures describe the repository and not the machine that read it, so copies are never added up. Where the entries
    have them, the name and remote of the first entry that has one (in order of `entry`) stand for all, and root commits
    and paths are united, sorted; paths beside the first are aliases.
    """
    has = set(labelled.columns)
    order = "entry" if "entry" in has else component
    first = [F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.col(order))).alias(c) for c in ("name", "remote") if c in has]
    roots = [F.array_sort(F.array_distinct(F.flatten(F.collect_set("root_commits")))).alias("root_commits")] if "root_commits" in has else []
    paths = [F.array_sort(F.collect_set("path")).alias("_paths"), F.min_by("path", order).alias("path")] if "path" in has else []
    folded = labelled.groupBy(component).agg(
        *[F.max(c).alias(c) for c in REPO_COUNTS],
        F.min("first_commit_at").alias("first_commit_at"),
        F.max("last_commit_at").alias("last_commit_at"),
        F.count(F.lit(1)).alias("entries"),
        *first, *roots, *paths,
    )
    if paths:
        folded = folded.withColumn("aliases", F.array_remove("_paths", F.col("path"))).drop("_paths")
    return derive_commit_figures(folded)


def repo_members(labelled: DataFrame, column: str, component: str = "component") -> DataFrame:
    """Union of a list column (root commits, alias paths) per repository, as rows."""
    return union_distinct(labelled, column, [component])


def identity_count(rows: DataFrame, keys: str = "identity_keys", fallback: str = "identity_count") -> DataFrame:
    """Distinct hashed identities; sources without hashes give the largest of their counts when none has any."""
    no_keys = F.size(F.coalesce(F.col(keys), F.array().cast("array<string>"))) == 0
    counts = rows.agg(F.coalesce(F.max(F.when(no_keys, F.col(fallback))), F.lit(0)).cast("bigint").alias("_fallback"))
    distinct = union_distinct(rows, keys).agg(F.count(F.lit(1)).alias("n")).scalar()
    return counts.withColumn("_keys", distinct).select(
        F.when(F.col("_keys") > 0, F.col("_keys")).otherwise(F.col("_fallback")).alias("identities")
    )


def merge_commit_daily(rows: DataFrame, source: str = "source", date: str = "date") -> DataFrame:
    """Saved daily series without a repository column: per date the row of the source with most commits."""
    window = Window.partitionBy(date).orderBy(F.col("commits").desc(), F.col(source))
    return rows.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") == 1).drop("_rank")


def merge_commit_daily_by_repo(rows: DataFrame, component: str = "component", date: str = "date") -> DataFrame:
    """Exact form for series kept per repository: the larger view per repository and date, then the sum."""
    per_repo = rows.groupBy(component, date).agg(
        F.max(F.struct("commits", "insertions", "deletions")).alias("_row")
    ).select(date, "_row.*")
    return per_repo.groupBy(date).agg(*[F.sum(c).alias(c) for c in ("commits", "insertions", "deletions")])


def share_of_total(rows: DataFrame, part: str, alias: str, by: Sequence[str] = ()) -> DataFrame:
    """A share-of-own-total column. Totals are summed first and come back by scalar subquery or join: any size of `rows`."""
    if not by:
        return rows.withColumn(alias, pct(part, rows.agg(F.sum(part)).scalar()))
    totals = rows.groupBy(*by).agg(F.sum(part).alias("_total"))
    return null_safe_join(rows, totals, list(by)).withColumn(alias, pct(part, F.col("_total"))).drop("_total")
