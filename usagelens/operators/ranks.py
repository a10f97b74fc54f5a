"""Global order statistics without a global sort.

Values are first folded to `(value, count)`; each value belongs to an order-preserving bucket (about one
per cent wide). A bucket with more than BUCKET_ROWS distinct values is cut again at quantiles of its own values, which
a mergeable sketch gives, so a part is small however the values cluster: a few far values do not widen it, as they
would the parts of a range. Up to MAX_PARTS times BUCKET_ROWS distinct values in one per cent of range the
parts keep that size; beyond, they grow in proportion. The running count inside a bucket is a partitioned window; the
counts of the buckets give the offsets. Percentiles, rank tests and bootstrap look-ups all read from this one
shape. Infinite values have end buckets of their own.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKETS_PER_OCTAVE = 64
#: Distinct values of a bucket beyond which it is cut again, and the most parts of one.
BUCKET_ROWS, MAX_PARTS = 2_000, 512
#: Size of the sketch: its ranks are off by less than a third of the narrowest part (a part in 512).
SKETCH_K = 4_096
_STEP = 22  # splitters are searched in two steps of about this many
_END_BUCKET = 1 << 30


def order_bucket(value: Column, per_octave: int = BUCKETS_PER_OCTAVE) -> Column:
    """A bucket number that never decreases as `value` grows."""
    magnitude = lambda v: F.floor((F.log2(v) + 1075) * per_octave).cast("bigint") + 1
    end, infinity = F.lit(_END_BUCKET).cast("bigint"), F.lit(float("inf"))
    return (
        F.when(value == infinity, end).when(value == -infinity, -end)
        .when(value > 0, magnitude(value)).when(value < 0, -magnitude(-value)).otherwise(F.lit(0).cast("bigint"))
    )


def bucket_splitters(values: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """`(by..., _splitters, _heads)` for the buckets with more than BUCKET_ROWS distinct values: where each is cut.

    `_heads` has every _STEP-th splitter. Ranks of the sketch are fixed, so a bucket takes every so many of them.
    """
    ranks = F.array(*[F.lit(i / MAX_PARTS) for i in range(1, MAX_PARTS)])
    found = values.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"), F.kll_sketch_agg_double(value, F.lit(SKETCH_K)).alias("_sketch"))
    large = found.filter(F.col("_rows") > BUCKET_ROWS)
    stride = F.greatest(F.floor(F.lit(MAX_PARTS) / F.ceil(F.col("_rows") / BUCKET_ROWS)), F.lit(1)).cast("int")
    quantiles = large.select(*by, stride.alias("_stride"), F.kll_sketch_get_quantile_double("_sketch", ranks).alias("_all"))
    every = F.transform(F.sequence("_stride", F.lit(MAX_PARTS - 1), "_stride"), lambda i: F.element_at("_all", i))
    cut = quantiles.select(*by, F.array_distinct(every).alias("_splitters"))
    heads = F.filter("_splitters", lambda _, i: i % _STEP == _STEP - 1)
    return cut.withColumn("_heads", heads)


def _part(value: Column) -> Column:
    """How many splitters are at or below the value: first among the heads, then behind the last of them."""
    up_to = lambda splitters: F.size(F.filter(splitters, lambda s: s <= value))
    before = up_to(F.col("_heads")) * _STEP
    return F.when(F.col("_splitters").isNull(), 0).otherwise(before + up_to(F.slice("_splitters", before + 1, F.lit(_STEP - 1)))).cast("bigint")


def value_counts(df: DataFrame, value: str = "value", by: Sequence[str] = (), **measures: Column) -> DataFrame:
    """Distinct values with their count (`n`), or with the given conditional counts."""
    measures = measures or {"n": F.count(F.lit(1))}
    clean = df.withColumn(value, F.col(value).cast("double")).filter(F.col(value).isNotNull() & ~F.isnan(value))
    return clean.groupBy(*by, value).agg(*[c.alias(name) for name, c in measures.items()])


def running_counts(
    counts: DataFrame,
    value: str = "value",
    by: Sequence[str] = (),
    measures: Sequence[str] = ("n",),
) -> DataFrame:
    """Add `below_<m>` (count of strictly smaller values) and `total_<m>` for each measure, and `group_sum`."""
    by = list(by)
    coarse = counts.withColumn("_coarse", order_bucket(F.col(value)))
    # one row per large bucket, which are few: the join back is a broadcast wherever their size allows
    cut = bucket_splitters(coarse, value, [*by, "_coarse"])
    bucketed = null_safe_join(coarse, cut, [*by, "_coarse"], "left").withColumn("_bucket", F.col("_coarse") * F.lit(MAX_PARTS) + _part(F.col(value)))
    bucketed = bucketed.drop("_coarse", "_splitters", "_heads")
    per_bucket = bucketed.groupBy(*by, "_bucket").agg(
        *[F.sum(m).alias(f"_in_{m}") for m in measures],
        F.sum(F.col(value) * F.col(measures[0])).alias("_value_sum"),
    )
    ordered = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = per_bucket.select(
        *by, "_bucket",
        *[F.coalesce(F.sum(f"_in_{m}").over(ordered), F.lit(0)).alias(f"_before_{m}") for m in measures],
        *[F.sum(f"_in_{m}").over(whole).alias(f"total_{m}") for m in measures],
        F.sum("_value_sum").over(whole).alias("group_sum"),
    )
    inside = Window.partitionBy(*by, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = bucketed.select(
        "*", *[F.coalesce(F.sum(m).over(inside), F.lit(0)).alias(f"_local_{m}") for m in measures]
    )
    return null_safe_join(local, offsets, [*by, "_bucket"]).select(
        *by, value, "_bucket", *measures,
        *[(F.col(f"_before_{m}") + F.col(f"_local_{m}")).alias(f"below_{m}") for m in measures],
        *[f"total_{m}" for m in measures],
        "group_sum",
    )


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a null group key meets itself."""
    renamed = right.select(
        *[F.col(k).alias(f"_right_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    condition = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(renamed, condition, how).drop(*[f"_right_{k}" for k in keys])


def value_at(position: Column, value: str = "value", measure: str = "n") -> Column:
    """Aggregate: the value at a 0-based position of the sorted group."""
    below = F.col(f"below_{measure}")
    return F.max(F.when((below <= position) & (position < below + F.col(measure)), F.col(value)))


def percentile_aggregates(
    percentiles: dict[str, float], value: str = "value", measure: str = "n"
) -> tuple[list[Column], list[Column]]:
    """Two lists: aggregates for the neighbours of each percentile, and their linear interpolation.

    The position is `p * (n - 1)`; the value between two neighbours is interpolated.
    """
    aggregates, results = [], []
    for name, p in percentiles.items():
        position = F.lit(float(p)) * (F.col(f"total_{measure}") - 1)
        aggregates += [
            value_at(F.floor(position), value, measure).alias(f"_lo_{name}"),
            value_at(F.ceil(position), value, measure).alias(f"_hi_{name}"),
            F.max(position - F.floor(position)).alias(f"_fraction_{name}"),
        ]
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        results.append((lo + F.col(f"_fraction_{name}") * (hi - lo)).alias(name))
    return aggregates, results


def values_at_positions(
    running: DataFrame,
    positions: DataFrame,
    position: str = "position",
    value: str = "value",
    by: Sequence[str] = (),
    measure: str = "n",
) -> DataFrame:
    """Look up the sorted-order value of each row of `positions(by..., position, ...)`.

    Two as-of steps by union and window: first over the buckets of a group, then over the values of a
    bucket. Both partitions hold few rows, so no range join is needed.
    """
    by = list(by)
    extra = [c for c in positions.columns if c not in (*by, position)]
    begin = F.col(f"below_{measure}")

    starts = running.groupBy(*by, "_bucket").agg(F.min(begin).alias("_at"))
    located = _as_of(starts.withColumnRenamed("_bucket", "_found"), positions.withColumnRenamed(position, "_at"),
                     by, "_found", extra)
    values = running.select(*by, "_bucket", begin.alias("_at"), F.col(value).alias("_value"))
    lookups = located.withColumnRenamed("_found", "_bucket")
    found = _as_of(values, lookups, [*by, "_bucket"], "_value", extra)
    return found.select(*by, F.col("_at").alias(position), *extra, F.col("_value").alias(value))


def _as_of(known: DataFrame, lookups: DataFrame, by: list[str], carried: str, extra: list[str]) -> DataFrame:
    """For every look-up row the `carried` value of the last known row at or before `_at`."""
    tagged = known.select(*by, "_at", carried).withColumn("_lookup", F.lit(0))
    asked = lookups.select(*by, "_at", *extra).withColumn("_lookup", F.lit(1))
    window = Window.partitionBy(*by).orderBy("_at", "_lookup").rowsBetween(Window.unboundedPreceding, 0)
    return (
        tagged.unionByName(asked, allowMissingColumns=True)
        .withColumn(carried, F.last(carried, ignorenulls=True).over(window))
        .filter(F.col("_lookup") == 1)
        .select(*by, "_at", *extra, carried)
    )
