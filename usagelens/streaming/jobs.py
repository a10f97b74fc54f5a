"""Incremental ingest, growing snapshots, windowed series and pairing over streams.

Every job runs with `Trigger.AvailableNow` and a checkpoint: one run takes what is new and ends, the next
run continues. Batches are written to their own `batch_id=<n>` folder and a repeated batch replaces it, so a
lost executor or a restarted run never counts a row twice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.tokens import TOKENS, TokenColumns, total_tokens
from ..operators.requests import keep_largest
from ..sources.transcripts import decoded_path, describe_path


def stream_lines(spark: SparkSession, root: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """New transcript chunks below `root` as lines with path columns.

    The file source reads a file once: producers land closed, immutable chunks, and a chunk that is still
    being written must carry another name until it is complete. A stream has no row numbers, so `line_no` is a hash
    of the line: ties of the largest-wins rule are decided by content, in every run alike.
    """
    reader = spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").option("lineSep", "\n")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    lines = reader.text(root).select(
        decoded_path(F.col("_metadata.file_path")).alias("file_path"), F.xxhash64("value").alias("line_no"), F.col("value").alias("line")
    )
    return describe_path(lines.filter(F.col("line") != ""))


def run_available(
    stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, output_mode: str = "append"
) -> None:
    """Process what is available now, batch by batch, and return when done."""
    query = (
        stream.writeStream.foreachBatch(write).outputMode(output_mode)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """Write each batch to its own folder, replacing it when the batch is repeated."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def split_writer(good: str, bad: str, is_bad: Column) -> Callable[[DataFrame, int], None]:
    """Write readable lines to one table and unreadable ones to another, from one read of the batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            batch.filter(~is_bad).write.mode("overwrite").parquet(f"{good}/batch_id={batch_id}")
            batch.filter(is_bad).write.mode("overwrite").parquet(f"{bad}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return write


def read_batches(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("basePath", path)
    return (reader.schema(schema) if schema else reader).parquet(path)


# -- growing snapshots -------------------------------------------------------------------


def current_requests(log: DataFrame, key: str = "message_id", order: Sequence[str] = ("file_path", "line_no"),
                     tokens: TokenColumns = TOKENS) -> DataFrame:
    """The largest snapshot per id of an append-only log.

    The rule does not depend on arrival order, so appending and reducing on read is exact: a late, larger
    snapshot wins whenever it comes.
    """
    return keep_largest(log, key, order=order, tokens=tokens)


def compact_log(log: DataFrame, target: str, key: str = "message_id", order: Sequence[str] = ("file_path", "line_no")) -> None:
    """Write the reduced log to a new table, so that old snapshots are not read again."""
    current_requests(log, key, order).write.mode("overwrite").parquet(target)


def running_largest(stream: DataFrame, key: str = "message_id", order: Sequence[str] = ("file_path", "line_no"),
                    tokens: TokenColumns = TOKENS, ts: str | None = None, keep_for: str = "2 days") -> DataFrame:
    """Low-latency form: state per id, updates out (use output mode `update`).

    With `ts` the state of an id goes once its day is `keep_for` behind the newest time seen, so state is bounded by
    the ids of that span; snapshots that come later are left out of the updates (the append-only log keeps them), and
    Spark counts them in the query's progress as rows dropped by watermark.

    The smallest struct starting with the negated size is the largest snapshot with the first position.
    """
    rest = [c for c in stream.columns if c not in (key, *order)]
    best = F.min(F.struct((-total_tokens(tokens)).alias("_size"), *order, *rest)).alias("_best")
    if ts is not None:
        dated = stream.withWatermark(ts, keep_for)
        return dated.groupBy(key, F.window(ts, "1 day")).agg(best).select(key, *[F.col(f"_best.{c}").alias(c) for c in (*order, *rest)])
    return stream.groupBy(key).agg(best).select(key, *[F.col(f"_best.{c}").alias(c) for c in (*order, *rest)])


def latest_updates(batches: DataFrame, keys: Sequence[str], batch: str = "batch_id") -> DataFrame:
    """The last update of every key of an update-mode output."""
    window = Window.partitionBy(*keys).orderBy(F.col(batch).desc())
    return batches.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") == 1).drop("_rank", batch)


# -- windows ------------------------------------------------------------------------------


def windowed_totals(stream: DataFrame, measures: dict[str, Column], ts: str = "ts", width: str = "1 hour",
                    late_by: str = "1 day", by: Sequence[str] = ()) -> DataFrame:
    """Tumbling windows with a bound on late data: `(start, by..., measures...)`."""
    grouped = stream.withWatermark(ts, late_by).groupBy(F.window(ts, width), *by).agg(
        *[c.alias(name) for name, c in measures.items()]
    )
    return grouped.select(F.col("window.start").alias("start"), *by, *measures)


class LateAwareWindows:
    """Tumbling windows that late rows still reach, and that say how many came late.

    A window is closed once it ends `late_by` before the newest time of earlier batches. Rows of closed windows are not
    dropped: they go to a side table as they are, and their sums are added to the closed windows. Every batch writes net
    sums in a folder of its own, so a repeated batch replaces them, and totals equal those of a batch run over all rows.
    `measures` are sums or counts, which add up over batches. Rows without a time are in no window.
    """

    def __init__(self, path: str, measures: dict[str, Column], ts: str = "ts", width: str = "1 hour", late_by: str = "1 day", by: Sequence[str] = ()) -> None:
        self.path, self.measures, self.ts, self.width, self.late_by, self.by = path.rstrip("/"), measures, ts, width, late_by, list(by)

    def _newest(self, spark: SparkSession, batch_id: int) -> Column:
        """Newest time of the batches before this one: a row per batch is read."""
        if batch_id == 0:
            return F.lit(None).cast("timestamp")
        seen = spark.read.option("basePath", f"{self.path}/seen").schema("newest timestamp, batch_id long").parquet(f"{self.path}/seen")
        return F.lit(seen.where(F.col("batch_id") < batch_id).agg(F.max("newest")).first()[0]).cast("timestamp")

    def write(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        dated = batch.where(F.col(self.ts).isNotNull()).withColumn("_window", F.window(self.ts, self.width))
        closed = F.col("_window.end") <= self._newest(spark, batch_id) - F.expr(f"INTERVAL {self.late_by}")
        rows = dated.withColumn("_late", F.coalesce(closed, F.lit(False)))
        sums = rows.groupBy(F.col("_window.start").alias("start"), *self.by).agg(*[c.alias(n) for n, c in self.measures.items()], F.count_if("_late").alias("late_rows"))
        sums.write.mode("overwrite").parquet(f"{self.path}/sums/batch_id={batch_id}")
        rows.where("_late").drop("_window", "_late").write.mode("overwrite").parquet(f"{self.path}/late/batch_id={batch_id}")
        dated.agg(F.max(F.col(self.ts).cast("timestamp")).alias("newest")).write.mode("overwrite").parquet(f"{self.path}/seen/batch_id={batch_id}")

    def totals(self, spark: SparkSession) -> DataFrame:
        """`(start, by..., measures..., late_rows)` over all batches."""
        return read_batches(spark, f"{self.path}/sums").groupBy("start", *self.by).agg(*[F.sum(c).alias(c) for c in (*self.measures, "late_rows")])

    def late_rows(self, spark: SparkSession, schema: str | None = None) -> DataFrame:
        """The late rows themselves, with their batch."""
        return read_batches(spark, f"{self.path}/late", schema)


# -- pairing ------------------------------------------------------------------------------


def pair_streams(calls: DataFrame, results: DataFrame, keys: Sequence[str], call_ts: str = "call_ts", result_ts: str = "result_ts",
                 within: str = "1 day", late_by: str = "1 day") -> DataFrame:
    """Calls joined with results of the same key that follow within a bound.

    A call stays pending across batches until the watermark passes its bound. Where ids can repeat, reduce
    the stored pairs with `first_result`.
    """
    left = calls.withWatermark(call_ts, late_by)
    right = results.select(*[F.col(k).alias(f"_result_{k}") for k in keys], *[c for c in results.columns if c not in keys])
    right = right.withWatermark(result_ts, late_by)
    same = [F.col(k) == F.col(f"_result_{k}") for k in keys]
    condition = (F.col(result_ts) >= F.col(call_ts)) & (F.col(result_ts) <= F.col(call_ts) + F.expr(f"INTERVAL {within}"))
    for c in same:
        condition = condition & c
    return left.join(right, condition, "inner").drop(*[f"_result_{k}" for k in keys])


def first_result(pairs: DataFrame, keys: Sequence[str], call_ts: str = "call_ts", result_ts: str = "result_ts") -> DataFrame:
    window = Window.partitionBy(*keys, call_ts).orderBy(result_ts)
    return pairs.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") == 1).drop("_rank")
