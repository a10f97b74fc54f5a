"""Ranked lexical search over per-term posting lists in geometric blocks, exact.

The items are the stated query set; they are taken in blocks of at most BLOCK_TERMS distinct terms. For a block:

1. `vectors`: every document's terms that the block asks for, with their occurrences (other terms are only counted).
2. Weights from document counts; each (document, term) gets its integer impact, and documents are dealt into shards of SHARD_DOCS.
3. `build_index`: in a shard, each posting list is clustered by the similarity of its documents (inner products of random
   projections of their weighted vectors) into blocks of at most BLOCK_DOCS. A block keeps its documents and its
   summary: for each term the greatest impact that any of its documents has (terms that no item has together with the
   list's term are left out). The index is a table with a row per block.
4. `search`: per shard, an item's summed summary is an upper bound of every score in a block. Blocks are opened from
   the greatest bound down, their documents are scored whole, and what is left is skipped only when its bound lies below the
   score of rank `top` so far. A document with a score has a term of the item, so it lies in a block of that list.
5. The ranks of shards meet by item, cut to `top` before they are sent.

The clustering decides only how much is skipped. Scores are 64-bit integers; equal scores rank by ascending key.

Nulls: a null text has no terms; null keys rank before others. Items without terms, or without a document that has
one, give no rows; equal items are searched once and listed for each of their ids. Repeated rows are ranked one by one.
Empty tables give no rows. Long texts are read whole; an item with more than BLOCK_TERMS terms is a block of its own.
Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import LOWER_ASCII, utf8

TOP = 50
BLOCK_TERMS, SHARD_DOCS, BLOCK_DOCS, PROJECTED = 4_096, 4_096, 256, 32
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")  # after lower-casing
INDEX = "shard int, term int, docs array<int>, dims array<int>, tops array<int>"


def terms_of(data: bytes | None) -> list[bytes]:
    return TERM.findall(data.translate(LOWER_ASCII)) if data else []


def item_blocks(items: DataFrame, text: str, most: int = BLOCK_TERMS) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Distinct item texts with their distinct terms, in blocks of at most `most` distinct terms; one block is held at a time."""
    block: list[tuple[str, list[bytes]]] = []
    known: set[bytes] = set()
    for row in items.select(F.col(text).cast("string").alias("t")).where("t is not null").distinct().toLocalIterator():
        asked = sorted(set(terms_of(row["t"].encode())))
        if block and len(known.union(asked)) > most:
            yield block
            block, known = [], set()
        if asked:
            block.append((row["t"], asked))
            known.update(asked)
    if block:
        yield block


def vectors(docs: DataFrame, number: Broadcast, text: str, key: str) -> DataFrame:
    """(row, key, n, terms, tfs): n counts all terms of a document, the lists hold those in `number` (term to number)."""

    @F.pandas_udf("n long, terms array<int>, tfs array<int>")
    def run(texts: pd.Series) -> pd.DataFrame:
        get, out = number.value.get, []
        for t in texts:
            found = terms_of(t)
            asked = Counter(filter(None.__ne__, map(get, found)))
            out.append((len(found), list(asked), list(asked.values())))
        return pd.DataFrame(out, columns=["n", "terms", "tfs"])

    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), run(utf8(text)).alias("v")).select("row", "key", "v.*")


def impact(tf: Column, m: Column) -> Column:
    return F.call_function("div", F.lit(1_000_000_000).cast("long") * tf, F.lit(1000).cast("long") * tf + F.lit(20).cast("long") * m)


def weights(df: dict[int, int], n_docs: int, n_terms: int) -> np.ndarray:
    """Weight of each term number; zero for terms that no document has."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) if t in df else 0 for t in range(n_terms)], np.int64)


class Shard:
    """The vectors of a shard's documents in order of their keys, as flat arrays."""

    def __init__(self, table: pa.Table) -> None:
        table = table.sort_by([("place", "ascending")]).combine_chunks()
        self.keys, self.docs = table.column("key"), table.num_rows
        lists, values = (table.column(c).combine_chunks() for c in ("terms", "impacts"))
        self.at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        self.terms, self.impacts = (np.asarray(x.flatten()).astype(np.int64) for x in (lists, values))

    def entries(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the entries of documents (each has one at least), and where each document's begin among them."""
        size = self.at[docs + 1] - self.at[docs]
        begin = np.cumsum(size) - size
        return np.arange(size.sum()) + np.repeat(self.at[docs] - begin, size), begin


def clustered(docs: np.ndarray, points: np.ndarray, most: int) -> list[np.ndarray]:
    """A posting list in blocks of at most `most`: every document goes to the most similar of evenly chosen ones."""
    if len(docs) <= most:
        return [docs]
    heads = docs[np.linspace(0, len(docs) - 1, -(-len(docs) // most)).astype(int)]
    own = np.argmax(points[docs] @ points[heads].T, axis=1)
    return [part[k: k + most] for i in range(len(heads)) if len(part := docs[own == i]) for k in range(0, len(part), most)]


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values).astype(np.int32) if values else np.zeros(0, np.int32)))


def build_index(shards: DataFrame, asked: Broadcast) -> DataFrame:
    """(shard, place, key, terms, impacts) to INDEX. `asked`: weights, and the items as lists of term numbers."""

    def run(table: pa.Table) -> pa.Table:
        weight, items = asked.value
        together: dict[int, np.ndarray] = {}
        for item in items:
            for t in item:
                together.setdefault(t, np.zeros(len(weight), bool))[item] = True
        shard = Shard(table)
        axes = np.random.default_rng(12).choice(np.array([-1, 1], np.float32), (len(weight), PROJECTED))
        value = (weight[shard.terms] * shard.impacts).astype(np.float32)
        points = np.add.reduceat(axes[shard.terms] * value[:, None], shard.at[:-1], axis=0)
        points /= np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-9)
        by_term = np.argsort(shard.terms, kind="stable")
        of = np.repeat(np.arange(shard.docs), np.diff(shard.at))[by_term]
        cuts = np.flatnonzero(np.diff(shard.terms[by_term])) + 1
        out: tuple[list, ...] = ([], [], [], [])
        for t, docs in zip(shard.terms[by_term][np.concatenate([[0], cuts])].tolist(), np.split(of, cuts), strict=True):
            blocks = clustered(docs, points, BLOCK_DOCS)
            most = np.zeros((len(blocks), len(weight)), np.int64)
            for i, block in enumerate(blocks):
                at, _ = shard.entries(block)
                np.maximum.at(most[i], shard.terms[at], shard.impacts[at])
            for block, top in zip(blocks, most, strict=True):
                dims = np.flatnonzero((top > 0) & together[t])
                for column, x in zip(out, (t, block, dims, top[dims]), strict=True):
                    column.append(x)
        number = pa.array([table.column("shard")[0].as_py()] * len(out[0]), pa.int32())
        return pa.table([number, pa.array(out[0], pa.int32()), *map(_lists, out[1:])], names=["shard", "term", "docs", "dims", "tops"])

    return shards.groupBy("shard").applyInArrow(run, INDEX)


class Blocks:
    """The index rows of a shard: documents by block, blocks by list, and summaries by term."""

    def __init__(self, table: pa.Table, n_terms: int) -> None:
        self.docs = [np.asarray(x.values).astype(np.int64) for x in table.column("docs")]
        self.lists: dict[int, list[int]] = {}
        for i, t in enumerate(table.column("term").to_pylist()):
            self.lists.setdefault(t, []).append(i)
        dims, tops = (table.column(c).combine_chunks() for c in ("dims", "tops"))
        block = np.repeat(np.arange(table.num_rows), dims.value_lengths().to_numpy(zero_copy_only=False))
        dims, tops = (np.asarray(x.flatten()).astype(np.int64) for x in (dims, tops))
        order = np.argsort(dims, kind="stable")
        self.block, self.top = block[order], tops[order]
        self.at = np.searchsorted(dims[order], np.arange(n_terms + 1))

    def bounds(self, item: list[int], weight: np.ndarray) -> np.ndarray:
        """Upper bound of an item's score in every block of its lists (of other blocks, a part of it)."""
        total = np.zeros(len(self.docs), np.int64)
        for t in item:
            part = slice(self.at[t], self.at[t + 1])
            total[self.block[part]] += weight[t] * self.top[part]
        return total


def best(shard: Shard, blocks: Blocks, item: list[int], weight: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents, scores) of the item's best in the shard, and how many blocks were skipped."""
    bound = blocks.bounds(item, weight)
    mine = np.array([i for t in item for i in blocks.lists.get(t, ())], np.int64)
    mine = mine[np.argsort(-bound[mine], kind="stable")]
    asked = np.zeros(len(weight), np.int64)
    asked[item] = weight[item]
    seen = np.zeros(shard.docs, bool)
    docs, scores, least, k, step = np.zeros(0, np.int64), np.zeros(0, np.int64), 1, 0, 4
    while k < len(mine) and bound[mine[k]] >= least:
        part = mine[k: k + step]
        part = part[bound[part] >= least]
        fresh = np.unique(np.concatenate([blocks.docs[i] for i in part]))
        fresh = fresh[~seen[fresh]]
        seen[fresh] = True
        if len(fresh):
            at, begin = shard.entries(fresh)
            docs = np.concatenate([docs, fresh])
            scores = np.concatenate([scores, np.add.reduceat(asked[shard.terms[at]] * shard.impacts[at], begin)])
            order = np.lexsort((docs, -scores))[:top]
            docs, scores = docs[order], scores[order]
            if len(docs) == top:
                least = max(1, int(scores[-1]))
        k, step = k + step, min(64, step * 2)
    return docs[scores > 0], scores[scores > 0], max(0, len(mine) - k)


def search(shards: DataFrame, index: DataFrame, asked: Broadcast, top: int = TOP) -> DataFrame:
    """(item, key, score): the best of each shard; `item` is the item's place in the block."""
    kind = shards.schema["key"].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        weight, items = asked.value
        shard, blocks = Shard(left), Blocks(right, len(weight))
        found = [best(shard, blocks, item, weight, top) for item in items]
        docs, scores = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        number = np.repeat(np.arange(len(items)), [len(f[0]) for f in found])
        return pa.table({"item": pa.array(number, pa.int32()), "key": shard.keys.take(pa.array(docs)).combine_chunks(), "score": pa.array(scores, pa.int64())})

    return shards.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(run, f"item int, key {kind}, score long")


def _ranked(docs: DataFrame, items: DataFrame, block: list[tuple[str, list[bytes]]], top: int, text: str, key: str, item_key: str, item_text: str) -> DataFrame:
    spark = docs.sparkSession
    number = {t: i for i, t in enumerate(sorted({t for _, asked in block for t in asked}))}
    found = cut_lineage(vectors(docs, spark.sparkContext.broadcast(number), text, key), "search-vectors")
    of = found.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms"), F.count(F.when(F.size("terms") > 0, 1)).alias("asked")).first()
    df = {r["t"]: r["c"] for r in found.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("c")).collect()}  # of the block's terms
    weight = weights(df, of["docs"], len(number))
    wide = F.col("n").cast("decimal(19,0)") * 50 * F.lit(of["docs"]).cast("decimal(18,0)")
    m = F.call_function("div", wide, F.lit(max(1, of["terms"])).cast("decimal(19,0)")) + 50
    n_shards = max(1, -(-of["asked"] // SHARD_DOCS))
    shards = found.where(F.size("terms") > 0).withColumn("m", m).select(
        F.pmod("row", F.lit(n_shards)).cast("int").alias("shard"), "key", "terms", F.transform("tfs", lambda tf: impact(tf.cast("long"), F.col("m"))).alias("impacts"))
    # documents of a shard are numbered in order of their keys, so that ties fall to the smaller
    shards = cut_lineage(shards.withColumn("place", F.row_number().over(Window.partitionBy("shard").orderBy("key"))), "search-shards")
    asked = spark.sparkContext.broadcast((weight, [[number[t] for t in terms if weight[number[t]] > 0] for _, terms in block]))
    index = cut_lineage(build_index(shards, asked), "search-index")
    by_rank = Window.partitionBy("item").orderBy(F.desc("score"), "key")
    best_of_all = search(shards, index, asked, top).withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= top)
    texts = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(block)], "i int, t string")
    named = items.select(F.col(item_key).alias("_id"), F.col(item_text).cast("string").alias("_text")).join(texts, F.col("_text") == F.col("t")).select("i", "_id")
    best_of_all = cut_lineage(best_of_all, "search-ranks")
    return named.join(best_of_all, F.col("i") == F.col("item")).select(F.col("_id").alias(item_key), "rank", F.col("key").alias(key), "score")


def rank_documents(docs: DataFrame, items: DataFrame, top: int = TOP, text: str = "text", key: str = "doc_id", item_key: str = "item_id", item_text: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_key, rank, key, score): the `top` documents with a score above 0 for every item."""
    found = [_ranked(docs, items, block, top, text, key, item_key, item_text) for block in item_blocks(items, item_text, block_terms)]
    if not found:
        kinds = [items.schema[item_key].dataType.simpleString(), docs.schema[key].dataType.simpleString()]
        return docs.sparkSession.createDataFrame([], f"{item_key} {kinds[0]}, rank int, {key} {kinds[1]}, score long")
    return reduce(DataFrame.unionByName, found)
