"""Mixing sources to target weights by hash thresholds, without sorting rows.

Every row gets a 36-bit hash of its id and text. Words are summed by source and hash bucket (12 bits); the bucket in
which the cumulative sum passes the source's budget is the boundary. Only its rows are summed again by the next 12
bits, and once more by the last 12. What comes out is one threshold per source: rows below it are taken once more.
Because the hash does not depend on the budget, a larger budget takes the same rows and more.

A target above the size of its source takes every row floor(target / size) times, and the threshold decides on the
rest; targets stop at `max_repeat` times the size, and what is over goes to the other sources by weight.

Nulls: a null source is a source of its own, ordered last; a null id is hashed as empty; a null text has size 0.
Rows equal in id and text share a hash and are taken together. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import WORD

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_REPEAT = 2.0
STEP_BITS, STEPS = 12, 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_hash(doc_id: Column, text: Column) -> Column:
    """36 bits of an md5, so that any engine can repeat them."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 9), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """(source, source_size) to (source, source_size, target): one row per source.

    Sharing the excess until no target is above its cap ends at one level per unit of weight, at which a source
    either has its cap or weight times level. Ordered by cap per weight, the capped sources come first.
    """
    # one row per source: the windows below hold as many rows as there are sources
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    given = F.array(*[F.lit(float(w)) for w in weights])
    return (
        sizes.withColumn("weight", F.element_at(given, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
        .withColumn("level", (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
        .withColumn("open", F.when(F.col("cap") / F.col("weight") > F.col("level"), F.col("level")))
        .withColumn("level", F.first("open", ignorenulls=True).over(everything))
        .select("source", "source_size", F.coalesce(F.least("cap", F.col("weight") * F.col("level")), "cap").alias("target"))
    )


def _boundary(histogram: DataFrame, last: bool) -> DataFrame:
    """The bucket of each source in which the sum passes `rest`, and what is left for it."""
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    passed = (
        histogram.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0)).cast("double"))
        .where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words")))
        .withColumn("left", F.col("rest") - F.col("before"))
    )
    step = F.lit(1 << STEP_BITS)
    prefix = F.col("prefix") * step + F.col("bucket")
    if last:  # the whole bucket, or nothing of it, whichever is nearer
        prefix = prefix + F.when(F.col("left") * 2 >= F.col("words"), 1).otherwise(0)
    return passed.select("source", prefix.alias("prefix"), F.col("left").alias("rest"))


def thresholds(rows: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """(source, size, h) to (source, source_size, target, whole, below): one row per source."""
    step = 1 << STEP_BITS
    first = cut_lineage(
        rows.groupBy("source", F.shiftright("h", STEP_BITS * (STEPS - 1)).alias("bucket")).agg(F.sum("size").alias("words")), "mix-histogram"
    )
    per_source = targets(first.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, max_repeat)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    per_source = cut_lineage(per_source.withColumn("whole", whole.cast("int")).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "mix-targets")
    plan = per_source.select(F.col("source").alias("s"), "rest")
    counted = first.join(plan, F.col("source").eqNullSafe(F.col("s"))).withColumn("prefix", F.lit(0).cast("long"))
    edge = cut_lineage(_boundary(counted, last=STEPS == 1), "mix-boundary")
    for k in range(1, STEPS):
        shift = STEP_BITS * (STEPS - 1 - k)
        at = edge.select(F.col("source").alias("s"), "prefix", "rest")
        inside = rows.join(at, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", shift + STEP_BITS) == F.col("prefix")))
        finer = inside.groupBy("source", "prefix", "rest", (F.shiftright("h", shift) % step).alias("bucket")).agg(F.sum("size").alias("words"))
        edge = cut_lineage(_boundary(finer, last=k == STEPS - 1), "mix-boundary")
    edge = edge.select(F.col("source").alias("s"), F.col("prefix").alias("below"))
    return per_source.join(edge, F.col("source").eqNullSafe(F.col("s")), "left").select(
        "source", "source_size", "target", "whole", F.coalesce("below", F.lit(0)).alias("below")
    )


def _prepared(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), row_hash(F.col("doc_id"), F.col("text")).alias("h"))


def _with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    plan = plan.withColumnRenamed("source", "_mix_source")
    copies = F.col("whole") + F.when(F.col("h") < F.col("below"), 1).otherwise(0)
    return rows.join(plan, F.col("source").cast("string").eqNullSafe(F.col("_mix_source"))).withColumn("copies", copies)


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies and taken (words the mix takes)."""
    rows = cut_lineage(_prepared(docs), "mix-rows")
    plan = cut_lineage(thresholds(rows, weights, share, max_repeat), "mix-plan")
    return _with_copies(rows, plan).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def materialize(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """The mixed documents themselves, with their own columns: a document taken twice is there twice."""
    rows = cut_lineage(_prepared(docs), "mix-rows")
    plan = cut_lineage(thresholds(rows, weights, share, max_repeat), "mix-plan")
    own = [F.col("d")[c].alias(c) for c in docs.columns]
    hashed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), F.col("source").cast("string").alias("source"), row_hash(F.col("doc_id"), F.col("text")).alias("h"))
    taken = _with_copies(hashed, plan).where(F.col("copies") > 0)
    return taken.select("d", F.explode(F.sequence(F.lit(1), "copies")).alias("_copy")).select(*own)
