"""Slots follow the key at every size of the input."""

import collections

from pyspark.sql import functions as F

from usagelens.llm import sharding


def slots_by_definition(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r["shard"]].append(((r["doc_id"] is not None, r["doc_id"] or 0), r["size"], r["text_crc32"], r["slot"]))
    return all([x[3] for x in sorted(g)] == list(range(len(g))) for g in groups.values())


def test_many_cells_and_hot_rows(spark):
    """Ranges of twenty rows a shard; one id with many texts, one row with many copies, null ids."""
    ids = spark.range(-3000, 3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    hot = spark.range(2000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("v"), F.col("id") % 1000).alias("text"))
    copies = spark.range(25_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    docs = ids.unionByName(hot).unionByName(copies)
    rows = sharding.manifest(docs, 4, cell_rows=20).collect()
    assert len(rows) == 33_000 and slots_by_definition(rows)


def test_two_hundred_thousand_rows(spark):
    """Above 80,000 rows, with the sizes of production; as SQL numbers them."""
    docs = spark.range(200_000).select((F.col("id") * 7919 % 200_003).alias("doc_id"), (F.col("id") % 97).cast("string").alias("text"))
    placed = sharding.manifest(docs, 40)
    placed.createOrReplaceTempView("placed")
    wrong = spark.sql("SELECT count(*) AS n FROM (SELECT slot, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS want FROM placed) WHERE slot <> want")
    assert wrong.first()["n"] == 0 and placed.count() == 200_000
