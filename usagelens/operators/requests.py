"""Request rows: deduplication, windows and token totals."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import ColumnOrName, col
from ..functions.tokens import TOKENS, TokenColumns, has_ttl_split, total_tokens

TIERS = ("main", "subagent", "workflow-agent")


def keep_largest(
    df: DataFrame,
    key: str | Sequence[str] = "message_id",
    size: Column | None = None,
    order: Sequence[str] = ("file_path", "line_no"),
    tokens: TokenColumns = TOKENS,
) -> DataFrame:
    """One row per key: the one with the largest `size` (total tokens), ties to the first in `order`.

    Usage snapshots of one id grow over several lines, so the largest is the final one. `row_number = 1`
    is planned with a partial group limit before the shuffle, so a key that holds a third of all rows
    reaches its reducer as one row per map task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    size = total_tokens(tokens) if size is None else size
    window = Window.partitionBy(*keys).orderBy(size.desc(), *[F.col(c).asc() for c in order])
    return df.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") == 1).drop("_rank")


# ---------------------------------------------------------------------------
# windows over content time


def in_window(df: DataFrame, ts: str, since: ColumnOrName | None = None, until: ColumnOrName | None = None) -> DataFrame:
    """Rows with `since < ts <= until`; undated rows never belong to a bounded window."""
    if since is not None:
        df = df.filter(F.col(ts) > col(since))
    if until is not None:
        df = df.filter(F.col(ts) <= col(until))
    return df


def scan_quality(
    lines: DataFrame,
    ts: str = "ts",
    kind: str = "kind",
    file: str = "file_path",
    since: Column | None = None,
    known_files: DataFrame | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Counters of one scan: files, new files, corrupt, undated and out-of-window lines.

    Corrupt lines and synthetic-model lines are not part of the window counters.
    """
    readable = ~F.col(kind).isin("corrupt", "synthetic")
    windowed = F.lit(since is not None)
    outside = F.coalesce(F.col(ts) <= since, F.lit(False)) if since is not None else F.lit(False)
    per_file = lines.groupBy(*by, file).agg(
        F.count_if(F.col(kind) == "corrupt").alias("corrupt"),
        F.count_if(readable & windowed & outside).alias("outside"),
        F.count_if(readable & windowed & F.col(ts).isNull()).alias("undated"),
        F.count_if(F.col(kind) == "record").alias("records"),
        F.count(F.lit(1)).alias("lines"),
    )
    new_file = F.lit(1)
    if known_files is not None:
        per_file = per_file.join(known_files.select(file).distinct().withColumn("_known", F.lit(1)), file, "left")
        new_file = F.when(F.col("_known").isNull(), 1).otherwise(0)
    return per_file.groupBy(*by).agg(
        F.count(F.lit(1)).alias("files_scanned"),
        F.coalesce(F.sum(new_file), F.lit(0)).alias("new_files"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(name) for c, name in (
            ("lines", "lines_read"),
            ("records", "record_lines"),
            ("corrupt", "corrupt_lines"),
            ("outside", "out_of_window_lines"),
            ("undated", "undated_lines"),
        )],
    )


def exclude_attributed(requests: DataFrame, attributed: DataFrame, key: str = "message_id") -> DataFrame:
    """Rows whose id was not already counted in an earlier period."""
    return requests.join(attributed.select(key).distinct(), key, "left_anti")


def boundary_reconciliations(requests: DataFrame, attributed: DataFrame, key: str = "message_id") -> DataFrame:
    """How many rows and ids `exclude_attributed` leaves out.

    Counts per id first, so a hot id crosses the join as one row.
    """
    per_id = requests.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per_id.join(attributed.select(key).distinct(), key, "left_semi").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("reconciled_rows"),
        F.count(F.lit(1)).alias("reconciled_ids"),
    )


def recent_ids(
    requests: DataFrame,
    file: str = "file_path",
    order: str = "line_no",
    key: str = "message_id",
    keep: int = 20,
    tokens: TokenColumns = TOKENS,
) -> DataFrame:
    """The last `keep` request lines of each file with their totals (the batch form of a resume memory)."""
    window = Window.partitionBy(file).orderBy(F.col(order).desc())
    return (
        requests.select(file, order, key, total_tokens(tokens).alias("total_tokens"))
        .withColumn("recency", F.row_number().over(window))
        .filter(F.col("recency") <= keep)
    )


# ---------------------------------------------------------------------------
# totals


def token_sums(tokens: TokenColumns = TOKENS) -> list[Column]:
    """Aggregates for a token bundle.

    The sums of the cache-write split are null unless every member row carried it: a partial sum would
    under-bill the rows without one. The rule also holds when bundles that are sums themselves are summed.
    """
    complete = F.bool_and(has_ttl_split(tokens))
    return [
        *[F.coalesce(F.sum(F.col(c)), F.lit(0)).alias(c) for c in tokens.counts],
        *[F.when(complete, F.sum(F.col(c))).alias(c) for c in tokens.split],
        F.coalesce(F.sum(total_tokens(tokens)), F.lit(0)).alias("total_tokens"),
    ]


def request_totals(df: DataFrame, by: Sequence[str] = (), tokens: TokenColumns = TOKENS,
                   requests: Column | None = None) -> DataFrame:
    """Requests and token sums per group. `requests` replaces the row count when rows are already totals."""
    n = F.count(F.lit(1)) if requests is None else F.coalesce(F.sum(requests), F.lit(0))
    return df.groupBy(*by).agg(n.alias("requests"), *token_sums(tokens))


def totals_by_key(df: DataFrame, key: ColumnOrName, alias: str = "key", by: Sequence[str] = (),
                  tokens: TokenColumns = TOKENS, requests: Column | None = None) -> DataFrame:
    """Totals per key, null keys as 'unknown'."""
    keyed = df.withColumn(alias, F.coalesce(col(key), F.lit("unknown")))
    return request_totals(keyed, [*by, alias], tokens, requests)


def totals_by_agent_type(df: DataFrame, tier: str = "tier", agent_type: str = "agent_type", by: Sequence[str] = (),
                         tokens: TokenColumns = TOKENS, requests: Column | None = None) -> DataFrame:
    """Totals of everything outside the main tier, keyed by agent type, else by tier."""
    agents = df.filter(~F.col(tier).eqNullSafe("main"))
    return totals_by_key(agents, F.coalesce(F.col(agent_type), F.col(tier)), agent_type, by, tokens, requests)


def usage_cube(df: DataFrame, by: Sequence[str] = (), keys: Sequence[str] = ("tier", "agent_type", "model"),
               tokens: TokenColumns = TOKENS) -> DataFrame:
    """Totals per tier, agent type and model: one pass over the rows, from which every other total follows.

    Hand it to the `totals_by_*` functions with `requests=F.col("requests")`.
    """
    return request_totals(df, [*by, *keys], tokens)


def totals_by_tier(df: DataFrame, tier: str = "tier", tiers: Sequence[str] = TIERS,
                   tokens: TokenColumns = TOKENS, requests: Column | None = None) -> DataFrame:
    """Totals for a fixed list of tiers, zero where a tier has no rows."""
    grouped = request_totals(df.filter(F.col(tier).isin(*tiers)), [tier], tokens, requests)
    spine = df.sparkSession.createDataFrame([(t,) for t in tiers], f"{tier} string")
    zeros = {c: 0 for c in ("requests", *tokens.counts, "total_tokens")}
    return spine.join(grouped, tier, "left").fillna(zeros)


def tokens_per_request(df: DataFrame, by: Sequence[str] = (), key: str = "message_id",
                       tokens: TokenColumns = TOKENS) -> DataFrame:
    """One value per request."""
    return df.select(*by, F.col(key).cast("string").alias("row_key"), total_tokens(tokens).alias("value"))


def tokens_per_session(df: DataFrame, session: str = "session_id", by: Sequence[str] = (),
                       tokens: TokenColumns = TOKENS) -> DataFrame:
    """One value per session."""
    return df.groupBy(*by, F.col(session).cast("string").alias("row_key")).agg(
        F.sum(total_tokens(tokens)).alias("value")
    )


def tokens_per_active_hour(df: DataFrame, ts: str = "ts", by: Sequence[str] = (),
                           tokens: TokenColumns = TOKENS) -> DataFrame:
    """One value per UTC hour that has a request; undated rows are left out."""
    hour = F.date_format(F.date_trunc("HOUR", F.col(ts)), "yyyy-MM-dd HH")
    return df.filter(F.col(ts).isNotNull()).groupBy(*by, hour.alias("row_key")).agg(
        F.sum(total_tokens(tokens)).alias("value")
    )


def request_metrics(df: DataFrame, by: Sequence[str] = (), key: str = "message_id", session: str = "session_id",
                    ts: str = "ts", tokens: TokenColumns = TOKENS) -> DataFrame:
    """The three distributions a report keeps, as rows `(by..., metric, row_key, value)`."""
    parts = (
        ("tokens per request", tokens_per_request(df, by, key, tokens)),
        ("tokens per session", tokens_per_session(df, session, by, tokens)),
        ("tokens per active hour", tokens_per_active_hour(df, ts, by, tokens)),
    )
    labelled = [p.select(*by, F.lit(name).alias("metric"), "row_key", F.col("value").cast("double")) for name, p in parts]
    return reduce(DataFrame.unionByName, labelled)
