"""Keyed state with timers: largest snapshots that tell only of growth, and calls that their first result consumes.

Both processors run on `transformWithState` (snapshots by rows, pairs by pandas), whose state store is RocksDB: state lies on the executors' disks with
its change log in the checkpoint, so it is not bound by memory, and an executor's loss costs nothing. One key is in state
with one row (or its pending calls) and goes by an event-time timer, so state holds the keys of `keep_for` behind the
watermark and no more.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.tokens import TOKENS, TokenColumns

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed state needs, for queries started inside."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def _millis(value: Any) -> int:
    return int(pd.Timestamp(value).value // 1_000_000)


class LargestSnapshot(StatefulProcessor):
    """Per key the largest snapshot seen: more tokens, then the smaller position. A row comes out only when it wins.

    Most keys come with a row or two, so what a key costs decides: rows come as they are, without a data frame for each
    key, and a new key asks its state once (it has no timer to look for).
    """

    def __init__(self, columns: Sequence[str], kinds: Sequence[str], order: Sequence[str], counts: Sequence[str], ts: str, keep_ms: int) -> None:
        self.columns, self.kinds, self.order, self.counts, self.ts, self.keep_ms = columns, kinds, order, counts, ts, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", ", ".join(f"`{c}` {k}" for c, k in zip(self.columns, self.kinds, strict=True)))

    def rank(self, row: dict[str, Any]) -> tuple:
        return (-sum(row[c] or 0 for c in self.counts), *((row[c] is not None, row[c]) for c in self.order))  # nulls first

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        values = self.best.get()
        held = None if values is None else dict(zip(self.columns, values, strict=True))
        best, least = held, None if held is None else self.rank(held)
        for row in rows:
            rank = self.rank(row)
            if least is None or rank < least:
                best, least = row, rank
        if best is held:
            return
        self.best.update(tuple(best[c] for c in self.columns))
        if held is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
        # undated snapshots are kept as if they came at the watermark
        at = _millis(best[self.ts]) if best[self.ts] is not None else timerValues.getCurrentWatermarkInMs()
        self.handle.registerTimer(max(at, timerValues.getCurrentWatermarkInMs()) + self.keep_ms)
        yield Row(**{c: best[c] for c in self.columns})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.best.clear()
        return iter(())

    def close(self) -> None:
        pass


def growing_snapshots(stream: DataFrame, key: str = "message_id", order: Sequence[str] = ("file_path", "line_no"), tokens: TokenColumns = TOKENS,
                      ts: str = "ts", late_by: str = "1 day", keep_for_ms: int = 2 * 86_400_000) -> DataFrame:
    """A row whenever the largest snapshot of a key grows (output mode `update`); the last row of a key is its largest.

    A key's state goes `keep_for_ms` behind the time of its largest snapshot. Rows without a key are left out.
    """
    columns = stream.columns
    kinds = [f.dataType.simpleString() for f in stream.schema.fields]
    processor = LargestSnapshot(columns, kinds, list(order), list(tokens.counts), ts, keep_for_ms)
    keyed = stream.where(f"{key} IS NOT NULL").withWatermark(ts, late_by).groupBy(key)
    return keyed.transformWithState(processor, outputStructType=_nullable(stream.schema), outputMode="Update", timeMode="EventTime")


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])


class ConsumingPairs(StatefulProcessor):
    """Per key the pending call; its first result takes it out of the state, further results find none.

    Events of a batch are taken in the order of their times, calls first at equal times. A call without a result becomes
    an orphan when another call takes its place, or by its timer: every call comes out once, as a pair or as an orphan.
    """

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "call string, at bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        events = []
        for batch in rows:
            events += zip((_millis(t) if t is not None and t is not pd.NaT else None for t in batch["at"]), batch["is_result"].tolist(), batch["event"].tolist(), strict=True)
        events.sort(key=lambda e: (e[0] is None, e[0] or 0, e[1], e[2]))
        out = []
        held = self.pending.get() if self.pending.exists() else None
        for at, is_result, event in events:
            if not is_result:
                if held is not None:
                    out.append(("orphan", held[0], None))  # a call with the same id takes its place
                held = (event, at)
            elif held is not None:
                out.append(("pair", held[0], event))
                held = None
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if held is None:
            self.pending.clear()
        else:
            self.pending.update(held)
            watermark = timerValues.getCurrentWatermarkInMs()
            self.handle.registerTimer(max(held[1] if held[1] is not None else watermark, watermark) + self.keep_ms)
        if out:
            yield self.rows(key, out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.pending.exists():
            call, _ = self.pending.get()
            self.pending.clear()
            yield self.rows(key, [("orphan", call, None)])

    def rows(self, key: Any, found: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(*key, *f) for f in found], columns=[f"k{i}" for i in range(len(key))] + ["kind", "call", "result"])

    def close(self) -> None:
        pass


def consuming_pairs(events: DataFrame, keys: Sequence[str], event: str = "event", is_result: str = "is_result", ts: str = "ts",
                    late_by: str = "1 day", keep_for_ms: int = 86_400_000) -> DataFrame:
    """`(keys..., kind, call, result)`: pairs, and orphans: calls that found no result within `keep_for_ms`.

    `events` has calls and results in one stream, each with its keys, a string `event` that names it, and its time.
    """
    fields = {f.name: f.dataType for f in events.schema.fields}
    out = T.StructType([T.StructField(f"k{i}", fields[k]) for i, k in enumerate(keys)] + [T.StructField(c, T.StringType()) for c in ("kind", "call", "result")])
    plain = events.select(*keys, F.col(event).cast("string").alias("event"), F.col(is_result).alias("is_result"), F.col(ts).alias("at")).withWatermark("at", late_by)
    paired = plain.groupBy(*keys).transformWithStateInPandas(ConsumingPairs(keep_for_ms), outputStructType=out, outputMode="Append", timeMode="EventTime")
    return paired.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "kind", "call", "result")
