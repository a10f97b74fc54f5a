"""Totals that are kept up to date: each batch adds what changed and takes back what it replaces.

A row counts for its key only while it is the key's best (the largest snapshot of a request, the earliest line of a
session). When a better row comes, its measures are added to the totals of its own group and those of the row it
replaces are taken from theirs: retraction rows. Both logs are append-only, one folder per batch:

* `best`: the rows that became the best of their key, of which the last is the key's best now;
* `totals`: net changes per group, already summed over the batch.

The best of a key does not depend on the order in which rows come, so any order of batches, with late rows, repeated
rows and rows split over batches, gives the totals of a full rebuild. Only keys of the batch are looked up, and the
totals are never recomputed. A batch that is applied again (a restarted run) replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions.tokens import TOKENS, TokenColumns, total_tokens
from ..session import cut_lineage


class RetractableTotals:
    """Sums of `measures` by `groups` over the best row of each key, kept below `path`.

    `rank` orders the rows of a key, the least is the best; rows of equal rank are the same row. `groups` and `measures`
    name their columns and say how a row gives them. Rows with a null key are left out; a null group is a group.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, rank: Sequence[Column], groups: dict[str, Column], measures: dict[str, Column]) -> None:
        self.spark, self.path, self.key, self.rank, self.groups, self.measures = spark, path.rstrip("/"), key, list(rank), groups, measures

    def _plain(self, rows: DataFrame) -> DataFrame:
        ranks = F.struct(*[c.alias(f"r{i}") for i, c in enumerate(self.rank)])
        return rows.where(F.col(self.key).isNotNull()).select(
            F.col(self.key).alias("_key"), ranks.alias("_rank"), *[c.alias(n) for n, c in self.groups.items()], *[F.coalesce(c, F.lit(0)).cast("bigint").alias(n) for n, c in self.measures.items()])

    def _best(self, plain: DataFrame) -> DataFrame:
        rest = [c for c in plain.columns if c != "_key"]
        return plain.groupBy("_key").agg(F.min_by(F.struct(*rest), "_rank").alias("_best")).select("_key", "_best.*")

    def _log(self, name: str, before: int | None) -> DataFrame | None:
        """What batches wrote, those before `before` only; null if there is none."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        store = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not store.exists(folder):
            return None
        found = [f.getPath() for f in store.listStatus(folder)]
        done = [p.toString() for p in found if store.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")) and (before is None or int(p.getName().split("=")[1]) < before)]
        return self.spark.read.parquet(*done) if done else None

    def apply(self, rows: DataFrame, batch: int) -> None:
        """Take in a batch: `batch` numbers rise, and a number that comes again replaces its batch (the last one only)."""
        fresh = self._best(self._plain(rows))
        log = self._log("best", batch)
        if log is None:
            won = fresh.withColumn("_old", F.lit(None).cast(fresh.drop("_key").schema))
        else:
            keys = fresh.select("_key")
            held = self._best(log.join(keys, "_key", "left_semi"))
            held = held.select(F.col("_key").alias("_held"), F.struct(*[F.col(c) for c in fresh.columns if c != "_key"]).alias("_old"))
            won = fresh.join(held, F.col("_key") == F.col("_held"), "left").where(F.col("_old").isNull() | (F.col("_rank") < F.col("_old._rank"))).drop("_held")
        won = cut_lineage(won, "won")
        plus = won.select(*self.groups, *self.measures, F.lit(1).cast("bigint").alias("rows"))
        minus = won.where("_old IS NOT NULL").select(*[F.col(f"_old.{c}").alias(c) for c in self.groups], *[(-F.col(f"_old.{c}")).alias(c) for c in self.measures], F.lit(-1).cast("bigint").alias("rows"))
        net = plus.unionByName(minus).groupBy(*self.groups).agg(*[F.sum(c).alias(c) for c in (*self.measures, "rows")])
        changed = reduce(or_, [F.col(c) != 0 for c in (*self.measures, "rows")])
        # totals first: a batch whose winners are not written is applied again from the same state
        net.where(changed).write.mode("overwrite").parquet(f"{self.path}/totals/batch={batch}")
        won.drop("_old").write.mode("overwrite").parquet(f"{self.path}/best/batch={batch}")

    def totals(self) -> DataFrame | None:
        """`(groups..., measures..., rows)` as a rebuild gives them; groups that lost all their rows are gone."""
        log = self._log("totals", None)
        if log is None:
            return None
        return log.groupBy(*self.groups).agg(*[F.sum(c).alias(c) for c in (*self.measures, "rows")]).where("rows <> 0")

    def compacted(self, path: str, batch: int) -> RetractableTotals:
        """The same state below a new path as one batch, so that old winners are not read again."""
        out = RetractableTotals(self.spark, path, self.key, self.rank, self.groups, self.measures)
        totals, best = self.totals(), self._log("best", None)
        if totals is not None and best is not None:
            totals.write.mode("overwrite").parquet(f"{out.path}/totals/batch={batch}")
            self._best(best).write.mode("overwrite").parquet(f"{out.path}/best/batch={batch}")
        return out


def daily_model_totals(spark: SparkSession, path: str, key: str = "message_id", order: Sequence[str] = ("file_path", "line_no"), ts: str = "ts",
                       model: str = "model", tokens: TokenColumns = TOKENS) -> RetractableTotals:
    """Token sums per UTC date and model, on the date of the largest snapshot. Give it rows that have a time and a model."""
    measures = {**{c: F.col(c) for c in tokens.counts}, "total_tokens": total_tokens(tokens)}
    return RetractableTotals(spark, path, key, [-total_tokens(tokens), *[F.col(c) for c in order]], {"date": cal.utc_date(ts), "model": F.col(model)}, measures)


def usable_requests(rows: DataFrame, ts: str = "ts", model: str = "model") -> DataFrame:
    return rows.where(F.col(ts).isNotNull() & F.col(model).isNotNull())


def session_starts(spark: SparkSession, path: str, session: str = "session_id", ts: str = "ts") -> RetractableTotals:
    """Sessions started per UTC date (`rows`): an earlier line that comes late moves its session to the earlier day."""
    return RetractableTotals(spark, path, session, [F.col(ts)], {"date": cal.utc_date(ts)}, {})
