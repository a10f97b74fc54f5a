"""Calls paired with their results, payload tables, injected attachments and compactions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import ratio
from ..functions.text import line_count

# Tools whose result size is tracked.
TRACKED_TOOLS = ("Read", "Bash", "Grep", "Edit", "Write", "Glob", "Task", "LSP")

# Command patterns that are counted, case-insensitive.
COMMAND_PATTERNS = {
    "git_commit": r"(?i)\bgit\s+(?:-\S+\s+)*commit\b",
    "git_push": r"(?i)\bgit\s+(?:-\S+\s+)*push\b",
    "git_worktree_add": r"(?i)\bgit\s+worktree\s+add\b",
    "git_worktree_remove": r"(?i)\bgit\s+worktree\s+remove\b",
}


def pair_calls(
    calls: DataFrame,
    results: DataFrame,
    keys: Sequence[str] = ("file_path", "tool_use_id"),
    order: str = "line_no",
    chunk: int = 100_000,
) -> DataFrame:
    """Every call with the first result that follows it under the same key.

    A call is consumed by its result; a repeated call replaces a pending one. So a result pairs exactly when
    the row before it (calls and results in line order, a call first within a line) is a call.
    Calls carry any columns, results carry any columns; both need `keys` and `order`.

    The previous row is found inside chunks of `chunk` lines first and across chunk edges second, so one
    key holding a large part of all rows is spread over many tasks.
    """
    keys = list(keys)
    call_cols = [c for c in calls.columns if c not in (*keys, order)]
    result_cols = [c for c in results.columns if c not in (*keys, order)]
    call_side = calls.select(*keys, order, F.lit(0).alias("_kind"), F.struct(order, *call_cols).alias("_call"))
    result_side = results.select(*keys, order, F.lit(1).alias("_kind"), F.struct(order, *result_cols).alias("_result"))
    rows = call_side.unionByName(result_side, allowMissingColumns=True).withColumn(
        "_chunk", F.floor(F.col(order) / chunk)
    )
    state = F.when(F.col("_kind") == 0, F.col("_call"))  # what is pending after this row
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order, "_kind")
    chunked = rows.withColumns({
        "_first": F.row_number().over(inside) == 1,
        "_before": F.lag(state).over(inside),
    })
    edges = rows.groupBy(*keys, "_chunk").agg(
        F.max_by(F.struct(state.alias("pending")), F.struct(order, "_kind")).alias("_state")
    )
    across = Window.partitionBy(*keys).orderBy("_chunk")
    carried = edges.select(*keys, "_chunk", F.lag("_state.pending").over(across).alias("_carried"))
    pending = F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_before"))
    paired = (
        chunked.filter(F.col("_kind") == 1)
        .join(carried, [*keys, "_chunk"], "left")
        .withColumn("_pending", pending)
        .filter(F.col("_pending").isNotNull())
    )
    return paired.select(
        *keys,
        F.col(f"_pending.{order}").alias(f"call_{order}"),
        F.col(f"_result.{order}").alias(f"result_{order}"),
        *[F.col(f"_pending.{c}").alias(c) for c in call_cols],
        *[F.col(f"_result.{c}").alias(c) for c in result_cols],
    )


def tool_payload_table(paired: DataFrame, by: Sequence[str] = (), tool: str = "tool", size: str = "bytes",
                       error: str = "is_error") -> DataFrame:
    """Calls, total, mean and largest result, and errors per tool."""
    grouped = paired.groupBy(*by, tool).agg(
        F.count(F.lit(1)).alias("calls"),
        F.coalesce(F.sum(size), F.lit(0)).alias("total_bytes"),
        F.max(size).alias("max_bytes"),
        F.count_if(F.col(error)).alias("errors"),
    )
    return grouped.withColumn("mean_bytes", F.coalesce(ratio("total_bytes", "calls"), F.lit(0.0)))


def top_by_bytes(rows: DataFrame, key: str, size: str = "bytes", limit: int | None = 15,
                 count: Column | None = None) -> DataFrame:
    """Injected bytes and count per key, null keys as 'unknown', the largest `limit` keys.

    `limit=None` keeps the whole table, which is what should be stored when summaries will be merged.
    """
    n = F.count(F.lit(1)) if count is None else F.sum(count)
    grouped = rows.groupBy(F.coalesce(F.col(key), F.lit("unknown")).alias("key")).agg(
        n.alias("count"), F.coalesce(F.sum(size), F.lit(0)).alias("total_bytes")
    )
    return grouped if limit is None else grouped.orderBy(F.col("total_bytes").desc(), "key").limit(limit)


def compaction_summary(events: DataFrame, by: Sequence[str] = (), trigger: str = "trigger", pre: str = "pre_tokens",
                       post: str = "post_tokens", dropped: str = "dropped_tokens",
                       duration: str = "duration_ms") -> DataFrame:
    """Compactions in total and by trigger, dropped tokens, and averages.

    Sizes are averaged over all events (missing counts as 0), durations over the events that have one. The
    sums stay in the row, so summaries can be merged exactly.
    """
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    kind = F.coalesce(F.col(trigger), F.lit("unknown"))
    sums = events.groupBy(*by).agg(
        F.count(F.lit(1)).alias("compactions"),
        F.count_if(kind == "manual").alias("manual"),
        F.count_if(kind == "auto").alias("auto"),
        F.count_if(~kind.isin("manual", "auto")).alias("other"),
        zero(dropped).alias("dropped_tokens"),
        zero(pre).alias("pre_sum"),
        zero(post).alias("post_sum"),
        zero(duration).alias("duration_sum"),
        F.count(duration).alias("duration_count"),
    )
    return with_compaction_averages(sums)


def with_compaction_averages(sums: DataFrame) -> DataFrame:
    return sums.withColumns({
        "avg_pre_tokens": ratio("pre_sum", "compactions"),
        "avg_post_tokens": ratio("post_sum", "compactions"),
        "avg_duration_ms": ratio("duration_sum", "duration_count"),
    })


def tool_use_counts(blocks: DataFrame, by: Sequence[str] = (), tool: str = "tool") -> DataFrame:
    """Calls per tool, without deduplication."""
    return blocks.groupBy(*by, tool).agg(F.count(F.lit(1)).alias("calls"))


def tool_use_counters(
    blocks: DataFrame,
    by: Sequence[str] = (),
    tool: str = "tool",
    command: str = "command",
    content: str = "content",
    new_text: str = "new_text",
    old_text: str = "old_text",
    name: str = "worktree_name",
    path: str = "worktree_path",
    patterns: dict[str, str] = COMMAND_PATTERNS,
) -> DataFrame:
    """Commands by pattern (one per command and pattern), lines written and edited, worktrees."""
    is_tool = lambda t: F.col(tool) == t
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    lines = lambda t, c: F.coalesce(F.sum(F.when(is_tool(t), line_count(c))), F.lit(0))
    return blocks.groupBy(*by).agg(
        *[F.count_if(is_tool("Bash") & F.rlike(F.col(command), F.lit(p))).alias(n) for n, p in patterns.items()],
        lines("Write", content).alias("lines_written"),
        lines("Edit", new_text).alias("edit_lines_added"),
        lines("Edit", old_text).alias("edit_lines_removed"),
        F.count_if(is_tool("EnterWorktree") & has(name)).alias("worktrees_created"),
        F.count_if(is_tool("EnterWorktree") & ~has(name) & has(path)).alias("worktrees_entered"),
        F.countDistinct(F.when(is_tool("EnterWorktree") & has(name), F.col(name))).alias("worktree_names"),
    )
