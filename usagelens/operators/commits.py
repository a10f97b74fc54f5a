"""Commit logs: attribution, roll-ups and series."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import span_days
from ..functions.numeric import pct


def classify_commits(
    commits: DataFrame,
    identities: DataFrame,
    markers: Sequence[str],
    message: str = "message",
    email: str = "email",
    parents: str = "parents",
) -> DataFrame:
    """Commits by the given authors with `attributed` (message carries a marker) and `is_merge`.

    Markers match literally and case-insensitively; authors by equal lower-cased address.
    """
    authors = identities.select(F.lower(F.trim(F.col(email))).alias("_author")).distinct()
    own = commits.join(authors, F.lower(F.trim(F.col(email))) == F.col("_author"), "left_semi")
    text = F.lower(F.coalesce(F.col(message), F.lit("")))
    marked = reduce(or_, [F.contains(text, F.lit(m.lower())) for m in markers])
    return own.withColumns({"attributed": marked, "is_merge": F.size(parents) >= 2})


def numstat(files: DataFrame, by: Sequence[str] = ("repo", "hash"), added: str = "added", removed: str = "removed") -> DataFrame:
    """Line and file counts per commit; a `-` count marks a binary file, which adds a file but no lines."""
    binary = (F.col(added) == "-") | (F.col(removed) == "-")
    lines = lambda c: F.coalesce(F.sum(F.when(~binary, F.expr(f"try_cast({c} AS BIGINT)"))), F.lit(0))
    return files.groupBy(*by).agg(
        lines(added).alias("insertions"), lines(removed).alias("deletions"),
        F.count(F.lit(1)).alias("files_changed"), F.count_if(binary).alias("binary_files"),
    )


def with_numstat(classified: DataFrame, files: DataFrame, keys: Sequence[str] = ("repo", "hash")) -> DataFrame:
    """Attributed non-merge commits carry their line counts; the others are not looked up."""
    counted = classified.filter(F.col("attributed") & ~F.col("is_merge"))
    stats = numstat(files.join(counted.select(*keys), list(keys), "left_semi"), keys)
    zero = {"insertions": 0, "deletions": 0, "files_changed": 0, "binary_files": 0}
    return classified.join(stats, list(keys), "left").fillna(zero)


def commit_rollup(commits: DataFrame, by: Sequence[str] = ("repo",), date: str = "author_date") -> DataFrame:
    """Commits, merges, lines, files, first and last date and the attributed share per repository.

    `by=()` gives the overall row. Dates are ISO strings and compare as such.
    """
    counted = F.col("attributed") & ~F.col("is_merge")
    total = lambda c: F.coalesce(F.sum(F.when(counted, F.col(c))), F.lit(0))
    grouped = commits.groupBy(*by).agg(
        F.count_if(counted).alias("attributed_commits"),
        F.count_if(~F.col("is_merge")).alias("authored_commits"),
        F.count_if(F.col("attributed") & F.col("is_merge")).alias("attributed_merges"),
        *[total(c).alias(c) for c in ("insertions", "deletions", "files_changed", "binary_files")],
        F.min(F.when(counted, F.col(date))).alias("first_commit_at"),
        F.max(F.when(counted, F.col(date))).alias("last_commit_at"),
    )
    return derive_commit_figures(grouped)


def derive_commit_figures(totals: DataFrame) -> DataFrame:
    as_time = lambda c: F.try_to_timestamp(F.col(c))
    return totals.withColumns({
        "net_lines": F.col("insertions") - F.col("deletions"),
        "attributed_pct": pct("attributed_commits", "authored_commits"),
        "span_days": span_days(as_time("first_commit_at"), as_time("last_commit_at")),
    })


def contributing(rollup: DataFrame) -> DataFrame:
    """Repositories with at least one attributed commit."""
    return rollup.filter(F.col("attributed_commits") > 0)


def overall_rollup(rollup: DataFrame) -> DataFrame:
    """All repositories together, from the rows of `commit_rollup`."""
    summed = ("attributed_commits", "authored_commits", "attributed_merges",
              "insertions", "deletions", "files_changed", "binary_files")
    totals = rollup.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in summed],
        F.min("first_commit_at").alias("first_commit_at"),
        F.max("last_commit_at").alias("last_commit_at"),
        F.count(F.lit(1)).alias("repos"),
        F.count_if(F.col("attributed_commits") > 0).alias("contributing_repos"),
    )
    return derive_commit_figures(totals)


def commit_daily(commits: DataFrame, by: Sequence[str] = (), date: str = "author_date") -> DataFrame:
    """Attributed commits and lines per author-local date (the date part of the offset timestamp)."""
    counted = commits.filter(F.col("attributed") & ~F.col("is_merge") & F.col(date).isNotNull())
    return counted.groupBy(*by, F.substring(date, 1, 10).alias("date")).agg(
        F.count(F.lit(1)).alias("commits"), F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions")
    )


def commit_monthly(daily: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return daily.groupBy(*by, F.substring("date", 1, 7).alias("month")).agg(
        *[F.sum(c).alias(c) for c in ("commits", "insertions", "deletions")]
    )


def collapse_candidates(candidates: DataFrame, history_key: str = "root_key", shared_dir: str = "common_dir",
                        path: str = "path", name: str = "name") -> DataFrame:
    """One owner per shared history: the lowest path of its group, and how many other paths it stands for."""
    keyed = candidates.withColumn("history", F.coalesce(history_key, shared_dir))
    return keyed.groupBy("history", path).agg(F.min(name).alias(name)).groupBy("history").agg(
        F.min(path).alias("owner_path"),
        F.min_by(name, path).alias("name"),
        (F.count(F.lit(1)) - 1).alias("aliases"),
    )


def candidate_aliases(candidates: DataFrame, collapsed: DataFrame, history_key: str = "root_key",
                      shared_dir: str = "common_dir", path: str = "path") -> DataFrame:
    """The other paths of each history as rows `(history, owner_path, alias_path)`."""
    keyed = candidates.select(F.coalesce(history_key, shared_dir).alias("history"), F.col(path).alias("alias_path"))
    return keyed.distinct().join(collapsed.select("history", "owner_path"), "history").filter(
        F.col("alias_path") != F.col("owner_path")
    )


def skip_reasons(candidates: DataFrame, aliases: DataFrame, path: str = "path", reason: str = "skip_reason") -> DataFrame:
    """Candidates left out, counted by reason: their own `skip_reason`, or a history kept under another path."""
    early = candidates.filter(F.col(reason).isNotNull()).select(path, F.col(reason).alias("reason"))
    folded = aliases.select(F.col("alias_path").alias(path), F.lit("shares history with another path").alias("reason"))
    return early.unionByName(folded).groupBy("reason").agg(F.count(F.lit(1)).alias("candidates"))
