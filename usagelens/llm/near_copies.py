"""Near copies: texts whose sets of word shingles have a Jaccard similarity of SIMILARITY or more, linked and reduced to one.

A node is a distinct set of shingle hashes (XXH64), named by its digest; a text with fewer words than a shingle is one
shingle, and texts without words are one node. Nodes that may link come from two places:

* fingerprints of `simhash` within `errors` bits, by the trie join, as a forest;
* min-hashes: BANDS values of BAND_ROWS least hashes each. Two sets of similarity s share a value with probability
  1 - (1 - s**BAND_ROWS)**BANDS, which is 1 - 5e-8 at 0.8. Fingerprints of 64 bits lie some ten bits apart there, and
  a trie walked with an error budget that finds them all would have to link random texts too.

Every pair is held against the sets of shingles before it links, in Spark. Pairs are tried in two steps:

1. Each node with the chosen node of each of its values (and the forest of fingerprints). This links dense groups of
   any size by as many pairs as they have nodes.
2. What a value holds together and step 1 left in several components. Up to ALL_PAIRS nodes: all their pairs. More: an
   exact similarity join by prefixes. Shingles are ordered from the rarest; two sets of the similarity share one among
   their first n - ceil(s n) + 1, and at the first they share enough must be left of both. Where two components meet, the
   nodes of the one with fewer there go on to the other. A node has a bitmap in which each of its shingles flips a bit: two
   bitmaps differ in no more bits than the sets in shingles, so a pair that differs in more than the similarity allows is
   none. Only pairs across components that pass are tried, so that no link between different texts is lost and no group
   is held against itself.

Nulls: a null text has no words; null keys are documents like others (a component without any key has a null id).
Repeated rows are one node; long texts are read whole; an empty table gives no rows. Other columns are kept, with any name.
"""

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import utf8
from .components import components
from .simhash import SEED, links, majority, shingle_hashes

SIMILARITY = 0.8
BANDS, BAND_ROWS = 32, 4
ALL_PAIRS = 8
BITMAP_WORDS = 16  # of 64 bits each
AT_ONCE, ROWS_AT_ONCE, PART_ROWS = 1_024, 500, 10_000
SLACK = 1e-9  # what rounding may take from a bound
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 64, BANDS * BAND_ROWS, np.uint64) | np.uint64(1)


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def shingle_set(data: bytes, shingle: int) -> np.ndarray:
    """Distinct shingle hashes, sorted."""
    return _joined(list(shingle_hashes(data, shingle)))


def digest(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).astype(np.int64))


def bands(found: np.ndarray) -> list[int]:
    """One value per band, which also holds the number of the band; an empty set has none."""
    if not len(found):
        return []
    least = np.min([(found[k: k + AT_ONCE, None] * FACTORS).min(axis=0) for k in range(0, len(found), AT_ONCE)], axis=0)
    rows = least.astype("<u8").reshape(BANDS, BAND_ROWS)
    return [int(np.uint64(xxhash.xxh64_intdigest(r.tobytes(), k)).astype(np.int64)) for k, r in enumerate(rows)]


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ROWS_AT_ONCE, so that what a worker holds beside its input stays small."""
    for b in batches:
        for k in range(0, b.num_rows, ROWS_AT_ONCE):
            yield b.slice(k, ROWS_AT_ONCE)


def _sketches(rows: DataFrame, shingle: int) -> DataFrame:
    """(key, data) to (key, node, fp, n, bands)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches):
            out: tuple[list, ...] = ([], [], [], [])
            for t in b.column("data"):
                parts = list(shingle_hashes(t.as_py(), shingle))
                found = _joined(parts)
                for column, x in zip(out, (digest(found), majority(parts), len(found), bands(found)), strict=True):
                    column.append(x)
            kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column("key"), *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)]], names=["key", "node", "fp", "n", "bands"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, node long, fp long, n long, bands array<long>")


def _sets(rows: DataFrame, shingle: int) -> DataFrame:
    """(node, data) to (node, shingles), for those whose text is the node's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches):
            found = [(node.as_py(), shingle_set(t.as_py(), shingle)) for node, t in zip(b.column("node"), b.column("data"), strict=True)]
            found = [(node, x) for node, x in found if digest(x) == node]
            ends = np.concatenate([[0], np.cumsum([len(x) for _, x in found])]).astype(np.int32)
            flat = _flat([x for _, x in found])
            yield pa.RecordBatch.from_arrays([pa.array([node for node, _ in found], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["node", "shingles"])

    return rows.mapInArrow(run, "node long, shingles array<long>")


def _flat(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)


def _digests(text: str, shingle: int) -> Column:
    """Node (long) of a text column."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([digest(shingle_set(t, shingle)) for t in texts], dtype=np.int64)

    return run(utf8(text))


def _sized(a: Column, b: Column, at_least: float) -> Column:
    """Whether sets of these sizes can have the similarity."""
    return F.least(a, b) >= F.greatest(a, b) * at_least - SLACK


def _pair(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _sets_of(docs: DataFrame, wanted: DataFrame, shingle: int, text: str, key: str) -> DataFrame:
    """(node, shingles) of the wanted nodes (key, node): their texts are fetched by key and read once more."""
    side = wanted.select(F.col("key").alias("_key"), F.col("node").alias("_node"))
    texts = docs.select(F.col(key).alias("key"), utf8(text).alias("data")).join(side.hint("merge"), F.col("key").eqNullSafe(F.col("_key")))
    # a key may name several rows: those with another text are left out, equal ones are one
    return cut_lineage(_sets(texts.select(F.col("_node").alias("node"), "data"), shingle).dropDuplicates(["node"]), "near-sets")


def _alike(pairs: DataFrame, sets: DataFrame, at_least: float) -> DataFrame:
    """Those of the pairs (a, b) that have the similarity."""
    x = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    held = pairs.join(x, "a").join(y, "b").where(common >= (F.size("x") + F.size("y") - common) * at_least)
    return cut_lineage(held.select("a", "b"), "near-edges")


def _bitmap(column: str) -> Column:
    """Aggregate: BITMAP_WORDS longs in which each value has flipped one bit."""
    bit = F.expr(f"shiftleft(1L, CAST(`{column}` & 63 AS INT))")
    word = F.shiftright(column, 6).bitwiseAND(F.lit(BITMAP_WORDS - 1))
    return F.array(*[F.coalesce(F.bit_xor(F.when(word == i, bit)), F.lit(0).cast("long")) for i in range(BITMAP_WORDS)])


def _bits_apart(a: str, b: str) -> Column:
    return reduce(Column.__add__, [F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(BITMAP_WORDS)])


def prefix_pairs(nodes: DataFrame, at_least: float) -> DataFrame:
    """(node, root, shingles) to the pairs (a, b) of different roots that can have the similarity; none that has it is left out."""
    each = nodes.select("node", "root", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    often = each.groupBy("s").agg(F.count(F.lit(1)).alias("f"))
    ordered = each.join(often, "s").groupBy("node", "root", "n").agg(F.array_sort(F.collect_list(F.struct("f", "s"))).alias("order"), _bitmap("s").alias("bits"))
    length = F.col("n") - F.ceil(F.col("n") * at_least - SLACK) + 1
    first = ordered.select("node", "root", "n", "bits", F.posexplode(F.slice("order", F.lit(1), length.cast("int"))).alias("at", "x"))
    first = cut_lineage(first.where("x.f > 1").select("node", "root", "n", "bits", F.col("x.s").alias("s"), (F.col("n") - F.col("at")).alias("left")), "near-prefixes")
    enough = lambda a, b, m, n: F.least(a, b) >= (m + n) * (at_least / (1 + at_least)) - SLACK
    # components that share a shingle, with the most that any of their nodes has left there; a is the one with fewer nodes
    roots = first.groupBy("s", "root").agg(F.max("left").alias("left"), F.min("n").alias("n"), F.count(F.lit(1)).alias("m"))
    p, q = roots.alias("p"), roots.alias("q")
    met = p.join(q, (F.col("p.s") == F.col("q.s")) & (F.col("p.root") < F.col("q.root")) & enough(F.col("p.left"), F.col("q.left"), F.col("p.n"), F.col("q.n")))
    other = lambda c: F.when(F.col("p.m") <= F.col("q.m"), F.col(f"q.{c}")).otherwise(F.col(f"p.{c}"))
    fewer = F.when(F.col("p.m") <= F.col("q.m"), F.col("p.root")).otherwise(F.col("q.root"))
    met = met.select(F.col("p.s").alias("s"), fewer.alias("ra"), other("root").alias("rb"), other("left").alias("left_rb"), other("n").alias("n_rb"))
    side = lambda c: first.select(F.col("s").alias(f"s{c}"), F.col("root").alias(f"of_{c}"), *[F.col(x).alias(f"{x}_{c}") for x in ("node", "n", "left", "bits")])
    # a node goes on only if the other component can have enough for it
    pairs = met.join(side("a"), (F.col("s") == F.col("sa")) & (F.col("ra") == F.col("of_a")) & enough(F.col("left_a"), F.col("left_rb"), F.col("n_a"), F.col("n_rb")))
    fits = _sized(F.col("n_a"), F.col("n_b"), at_least) & enough(F.col("left_a"), F.col("left_b"), F.col("n_a"), F.col("n_b"))
    fits = fits & (_bits_apart("bits_a", "bits_b") <= (F.col("n_a") + F.col("n_b")) * ((1 - at_least) / (1 + at_least)) + SLACK)
    pairs = pairs.join(side("b"), (F.col("s") == F.col("sb")) & (F.col("rb") == F.col("of_b")) & fits)
    return pairs.select(*_pair(F.col("node_a"), F.col("node_b"))).distinct()


def near_groups(docs: DataFrame, shingle: int = 5, at_least: float = SIMILARITY, errors: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: key, node, root (of its component) and component_id (smallest key in the component)."""
    rows = cut_lineage(_sketches(docs.select(F.col(key).alias("key"), utf8(text).alias("data")), shingle), "near-rows")
    parts = max(1, -(-rows.count() // PART_ROWS))
    # tables of a row or so per document: no more files than their rows need, whatever the width of the shuffles
    light = lambda df, label: cut_lineage(df.coalesce(parts), label)
    nodes = light(rows.groupBy("node").agg(F.min("key").alias("key"), *[F.first(c).alias(c) for c in ("fp", "n", "bands")]), "near-nodes")

    # fingerprints: nodes of one fingerprint with one of them, and the forest over fingerprints
    firsts = light(nodes.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("first")), "near-firsts")
    same = nodes.join(firsts, "fp").where((F.col("node") != F.col("first.node")) & _sized(F.col("n"), F.col("first.n"), at_least))
    linked = cut_lineage(links(firsts.select("fp"), errors), "near-trie")
    side = lambda c: firsts.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_first"))
    linked = linked.join(side("a"), "a").join(side("b"), "b").where(_sized(F.col("a_first.n"), F.col("b_first.n"), at_least))

    # values that several nodes share, with one node of each (another one in every band)
    spread = nodes.select("node", "n", F.explode("bands").alias("band"))
    heads = spread.groupBy("band").agg(F.count(F.lit(1)).alias("many"), F.min_by(F.struct("node", "n"), F.xxhash64("node", "band")).alias("head")).where("many > 1")
    members = cut_lineage(spread.join(heads.hint("merge"), "band"), "near-members")
    stars = members.where((F.col("node") != F.col("head.node")) & _sized(F.col("n"), F.col("head.n"), at_least))
    tried = reduce(DataFrame.unionByName, [
        same.select(*_pair(F.col("node"), F.col("first.node"))), linked.select(*_pair(F.col("a_first.node"), F.col("b_first.node"))), stars.select(*_pair(F.col("node"), F.col("head.node"))),
    ]).distinct()
    tried = light(tried, "near-pairs")

    wanted = members.select("node").unionByName(tried.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    sets = _sets_of(docs, nodes.select("node", "key").join(wanted, "node"), shingle, text, key)
    joined = light(components(_alike(tried, sets, at_least)), "near-joined").withColumnRenamed("node", "u")
    rooted = lambda df: df.join(joined, F.col("node") == F.col("u"), "left").withColumn("root", F.coalesce("root", "node")).drop("u")

    # values whose nodes are still in several components
    inside = rooted(members.select("band", "node", "n", "many"))
    apart = inside.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("band")
    apart = cut_lineage(inside.join(apart, "band"), "near-apart")
    few = apart.where(F.col("many") <= ALL_PAIRS)
    x, y = few.alias("x"), few.alias("y")
    across = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root")) & _sized(F.col("x.n"), F.col("y.n"), at_least))
    across = across.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    crowd = apart.where(F.col("many") > ALL_PAIRS).select("node", "root").distinct()
    if crowd.limit(1).count():
        across = across.unionByName(prefix_pairs(cut_lineage(crowd.join(sets, "node"), "near-crowd"), at_least))
    more = _alike(light(across.distinct().join(tried, ["a", "b"], "left_anti"), "near-pairs"), sets, at_least)
    # components of components
    of = lambda c: joined.select(F.col("u").alias(c), F.col("root").alias(f"{c}_root"))
    between = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    again = components(between).select(F.col("node").alias("v"), F.col("root").alias("top"))

    root = rooted(nodes.select("node", "key")).join(again, F.col("root") == F.col("v"), "left").select("node", F.coalesce("top", "root").alias("root"), "key")
    root = light(root, "near-roots")
    smallest = root.groupBy("root").agg(F.min("key").alias("component_id"))
    named = root.select(F.col("node").alias("_node"), "root").join(smallest, "root")
    return rows.join(named, F.col("node") == F.col("_node")).select(F.col("key").alias(key), "node", "root", "component_id")


def deduplicate(docs: DataFrame, shingle: int = 5, at_least: float = SIMILARITY, errors: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents that stay, with their own columns: of each component the row with the smallest key.

    A component without any key, or with its smallest key repeated, keeps one of those rows.
    """
    row = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    grouped = near_groups(docs, shingle, at_least, errors, text, key)
    grouped = cut_lineage(grouped, "near-grouped")
    parts = max(1, -(-grouped.count() // PART_ROWS))
    first = cut_lineage(grouped.where(F.col(key).eqNullSafe(F.col("component_id"))).select(F.col(key).alias("_first"), F.col("node").alias("_node"), F.col("root").alias("_root")).coalesce(parts), "near-first")
    stay = cut_lineage(first.groupBy("_first", "_root").agg(F.count(F.lit(1)).alias("_n")).coalesce(parts), "near-stay")
    # the list of those that stay grows with the documents: it is dealt out by key at every size, never broadcast
    kept = row.join(stay.hint("merge"), F.col("_key").eqNullSafe(F.col("_first")))
    repeated = stay.where("_n > 1 or _first is null").limit(1).count() or stay.groupBy("_first").count().where("count > 1").limit(1).count()
    if repeated:  # the key does not name one row: the node has to agree, and one row of each component stays
        listed = first.distinct()
        again = row.withColumn("_own", _digests("_text", shingle)).join(listed, F.col("_key").eqNullSafe(F.col("_first")) & (F.col("_own") == F.col("_node")))
        kept = again.dropDuplicates(["_root"])
    return kept.select("_row.*")
