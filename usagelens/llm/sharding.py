"""Sharding by jump consistent hashing: a stable key and the number of shards decide, and no ring table is kept.

With one more shard, a key either stays or goes to the new shard. Inside a shard, rows get gapless slots in order of key,
size and checksum, at every size of the input: rows are dealt into ranges of that order, counted per cell (shard and
range), cells get offsets, and only the rows of one cell are ordered together.

A null key counts as key 0; a null text has no bytes. Equal rows get slots next to each other, and are counted
before they are ordered, so that many copies of one row do not meet in one task. An empty table gives no rows.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import utf8

#: Rows ordered together, about, and copies of one row that are held at once.
CELL_ROWS, COPIES = 2_000, 10_000
OVERHEAD = 16


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key. Multiplier and shift are those of the published algorithm (fixed values)."""
    k = keys.astype(np.uint64)
    b, j = np.zeros(len(k), np.int64), np.zeros(len(k))
    going = np.ones(len(k), bool)
    while going.any():
        b[going] = j[going].astype(np.int64)
        k[going] = k[going] * np.uint64(2862933555777941757) + np.uint64(1)
        j[going] = np.floor((b[going] + 1) * (2.0**31 / ((k[going] >> np.uint64(33)).astype(np.float64) + 1.0)))
        going &= j < shards
    return b


def shard_of(key: Column, shards: int) -> Column:
    """Shard 0 to shards - 1 of an integer key."""
    if shards < 1:
        raise ValueError("at least one shard")

    @F.pandas_udf("int")
    def run(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64), shards).astype(np.int32))

    return run(F.coalesce(key.cast("long"), F.lit(0).cast("long")))


def with_shard(docs: DataFrame, shards: int, key: str = "doc_id", out: str = "shard") -> DataFrame:
    """All columns and the shard; no row moves."""
    return docs.withColumn(out, shard_of(F.col(key), shards))


def manifest(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", cell_rows: int = CELL_ROWS) -> DataFrame:
    """One row per document: key, size, text_crc32, shard, slot, grown_shard (with one more shard)."""
    rows = docs.select(F.col(key).alias("key"), (F.octet_length(utf8(text)) + OVERHEAD).cast("long").alias("size"), F.crc32(utf8(text)).alias("text_crc32"))
    # the shards are found for distinct rows, after the copies are counted
    rows = rows.groupBy("key", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.withColumn("shard", shard_of(F.col("key"), shards)).withColumn("grown_shard", shard_of(F.col("key"), shards + 1))
    ordered = ["key", "size", "text_crc32"]
    # null keys come first in both orders
    rows = cut_lineage(rows, "shard-counts")
    ranges = max(1, -(-rows.count() // (shards * cell_rows)))
    rows = cut_lineage(rows.repartitionByRange(ranges, *ordered).withColumn("cell", F.spark_partition_id()), "shard-rows")
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "cell").agg(F.sum("n").alias("in_cell")).withColumn("offset", F.coalesce(F.sum("in_cell").over(before), F.lit(0)))
    within = Window.partitionBy("shard", "cell").orderBy(*ordered).rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("offset") + F.coalesce(F.sum("n").over(within), F.lit(0))
    placed = rows.join(offsets.select("shard", "cell", "offset"), ["shard", "cell"]).withColumn("first", first).withColumn("last", F.col("first") + F.col("n") - 1)
    some = placed.select("*", F.explode(F.sequence("first", "last", F.lit(COPIES).cast("long"))).alias("from"))
    slot = F.explode(F.sequence("from", F.least(F.col("from") + COPIES - 1, "last"))).alias("slot")
    return some.select(F.col("key").alias(key), "size", "text_crc32", "shard", slot, "grown_shard")
