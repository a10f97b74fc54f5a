"""Benchmark decontamination: SimHash fingerprints of item-sized windows, found by multi-index Hamming blocks.

Words are runs of other bytes than white space, lower-cased. An item of L words has the shingles of SHINGLE words in
it (an item with fewer words: itself). A document window has the same number of shingles, so it is item-sized.

1. A window can reach the similarity only if it shares most shingles with an item. So document shingles are looked up
   among those of all items, and a window starts at a shingle of some item of its size, and is cut only where
   enough of its places have such shingles. (Moving a window to the first shingle it shares with an item drops
   only others, so its similarity does not fall, and no window that would pass is lost.)
2. Windows and items get 64-bit SimHash fingerprints over their shingles, repeats weighing as often as they occur.
3. Fingerprints are cut into BLOCKS blocks. If two differ in RADIUS bits at most, some block differs in
   RADIUS // BLOCKS at most. Each item is entered under all block values that near, so an equality join finds
   every item within the radius of a window.
4. Candidates within the radius are kept if the weighted Jaccard similarity of their shingles, by exact counts,
   reaches the threshold.

Everything is DataFrame operations. Texts are told apart by their md5, so copies are looked at once. Null or
empty texts and items match nothing; repeated items and rows give a result each. Windows at the end of a text
may be shorter. Extra columns of the inputs are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

SHINGLE, SIMILARITY = 5, 0.8
WHITE = " \t\n\x0b\x0c\r"
BLOCKS, RADIUS = 5, 19
#: First bit of each block, and the end.
EDGES = [64 * k // BLOCKS for k in range(BLOCKS + 1)]


def words(text: Column) -> Column:
    """Lower-case words; null and empty texts have none."""
    inner = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(WHITE))
    return F.when(inner != "", F.split(inner, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def shingles(w: Column, k: int) -> Column:
    """Hash of each run of k words; fewer words give none."""
    runs = F.transform(F.sequence(F.lit(0), F.size(w) - F.lit(k)), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
    return F.when(F.size(w) >= k, runs).otherwise(F.array().cast("array<bigint>"))


def _blocks(counts: list[Column], total: Column) -> list[Column]:
    """Fingerprint as BLOCKS numbers, from the weight of each bit."""
    bit = lambda b, low: F.when(counts[b] * 2 > total, 1 << (b - low)).otherwise(0)
    return [sum((bit(b, low) for b in range(low + 1, high)), bit(low, low)).alias(f"b{k}") for k, (low, high) in enumerate(zip(EDGES, EDGES[1:]))]


def _fingerprints(elements: DataFrame, by: list[str]) -> DataFrame:
    """(by, h, weight) to (by, size, b0 ...): one fingerprint per group."""
    summed = elements.groupBy(*by).agg(
        F.sum("weight").alias("size"), *[F.sum(F.when(F.shiftright("h", b).bitwiseAND(F.lit(1)) == 1, F.col("weight")).otherwise(0)).alias(f"s{b}") for b in range(64)]
    )
    return summed.select(*by, "size", *_blocks([F.col(f"s{b}") for b in range(64)], F.col("size")))


def _near_values(value: Column, bits: int) -> Column:
    """Values of one block that differ from `value` in RADIUS // BLOCKS bits at most."""
    masks = F.filter(F.sequence(F.lit(0), F.lit((1 << bits) - 1)), lambda x: F.bit_count(x) <= RADIUS // BLOCKS)
    return F.transform(masks, lambda m: value.bitwiseXOR(m))


def text_key(text: str) -> Column:
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def leaks_by_text(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, text: str = "text") -> DataFrame:
    """(t, item_id, word_start, n_words, similarity): the best window for each text (by its md5) and item with one."""
    # equal items are one, named by the md5 of their text
    items = benchmark.select(text_key("text").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0).dropDuplicates(["item"]).withColumn("k", F.least(F.size("w"), F.lit(SHINGLE)))
    elements = cut_lineage(
        items.withColumn("h", F.explode(shingles_by_size("w", "k"))).groupBy("item", "k", "h").agg(F.count(F.lit(1)).cast("int").alias("weight")), "leak-items"
    )
    sizes = elements.groupBy("item", "k").agg(F.sum("weight").cast("int").alias("n"))
    # each shingle with the sizes of the items that have it
    known = cut_lineage(elements.join(sizes, ["item", "k"]).select("k", "h", "n").distinct(), "leak-known")
    classes = sorted(tuple(r) for r in known.select("k", "n").distinct().collect())  # as many as items have lengths
    lengths = sorted({k for k, _ in classes})  # of 1 to SHINGLE
    texts = docs.select(text_key(text).alias("t"), words(F.col(text)).alias("w"))
    # every document shingle is looked up in the benchmark's
    each = [texts.select("t", F.lit(k).alias("k"), F.posexplode(shingles(F.col("w"), k)).alias("pos", "h")) for k in lengths]
    hits = None
    for x in each:
        hits = x if hits is None else hits.unionByName(x)
    if hits is None:
        return docs.sparkSession.createDataFrame([], "t string, item_id long, word_start long, n_words long, similarity double")
    # copies of a text have the same hits: one of them is kept
    hits = cut_lineage(hits.join(known, ["k", "h"]).select("t", "k", "n", "pos").distinct(), "leak-hits")
    # a window starts at a shingle of an item of its size, and most of its places are such shingles
    dense = F.lit(False)
    for k, n in classes:
        inside = Window.partitionBy("t", "k", "n").orderBy("pos").rangeBetween(0, n - 1)
        dense = dense | ((F.col("k") == k) & (F.col("n") == n) & (F.count(F.lit(1)).over(inside) >= max(1, _ceil(similarity * n))))
    starts = cut_lineage(hits.withColumn("dense", dense).where("dense").drop("dense"), "leak-windows")
    # shingles are hashed once per text, and all its windows cut from them
    asked = cut_lineage(starts.groupBy("t", "k").agg(F.collect_list(F.struct("pos", "n")).alias("cuts")), "leak-cuts")
    cut = None
    for k in lengths:
        # texts are dealt out whole, copies of one as one, and parted into words where they are needed; the list of texts
        # with windows grows with the documents and is never broadcast
        whole = docs.select(text_key(text).alias("t"), F.col(text).alias("whole")).dropDuplicates(["t"])
        hashed = whole.join(asked.where(F.col("k") == k).hint("merge"), "t").select("t", "k", "cuts", words(F.col("whole")).alias("w"))
        hashed = hashed.select("t", "k", "cuts", shingles(F.col("w"), k).alias("hashes"))
        cut = hashed if cut is None else cut.unionByName(hashed)
    cut = cut.select("t", "k", "hashes", F.inline("cuts")).select("t", "k", "pos", "n", F.explode(F.slice("hashes", F.col("pos") + 1, F.col("n"))).alias("h"))
    windows = cut.groupBy("t", "k", "pos", "n", "h").agg(F.count(F.lit(1)).cast("int").alias("weight"))
    windows = cut_lineage(windows, "leak-elements")
    prints = cut_lineage(_fingerprints(windows, ["t", "k", "pos", "n"]), "leak-prints")
    block = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"b{i}").alias("v")) for i in range(BLOCKS)]))
    item_prints = cut_lineage(_fingerprints(elements, ["item", "k"]).withColumnRenamed("size", "n"), "leak-item-prints")
    entered = F.array(*[F.struct(F.lit(i).alias("i"), _near_values(F.col(f"b{i}"), EDGES[i + 1] - EDGES[i]).alias("vs")) for i in range(BLOCKS)])
    index = item_prints.select("item", "k", "n", F.explode(entered).alias("x")).select("item", "k", "n", F.col("x.i").alias("i"), F.explode("x.vs").alias("v"))
    # equal fingerprints ask once, however many windows have them
    bits = [f"b{i}" for i in range(BLOCKS)]
    asked = prints.select("k", "n", *bits).distinct().select("k", "n", *bits, block.alias("x"))
    asked = asked.select("k", "n", *bits, F.col("x.i").alias("i"), F.col("x.v").alias("v"))
    # the index is hundreds of times as large as the items it comes from: it is not to be broadcast by their size
    near = asked.join(index.hint("merge"), ["k", "n", "i", "v"]).drop("i", "v").distinct()
    apart = sum((F.bit_count(F.col(f"b{i}").bitwiseXOR(F.col(f"c{i}"))) for i in range(1, BLOCKS)), F.bit_count(F.col("b0").bitwiseXOR(F.col("c0"))))
    theirs = item_prints.select("item", "k", *[F.col(f"b{i}").alias(f"c{i}") for i in range(BLOCKS)])
    near = cut_lineage(near.join(theirs, ["item", "k"]).where(apart <= RADIUS).select("k", "n", *bits, "item"), "leak-near")
    found = prints.select("t", "k", "pos", "n", F.col("size").alias("m"), *bits).join(near, ["k", "n", *bits]).drop(*bits)
    theirs = elements.select("item", "k", "h", F.col("weight").alias("of_item"))
    shared = found.join(windows, ["t", "k", "pos", "n"]).join(theirs, ["item", "k", "h"]).groupBy("t", "k", "pos", "n", "m", "item").agg(F.sum(F.least("weight", "of_item")).alias("common"))
    alike = F.col("common") / (F.col("n") + F.col("m") - F.col("common"))
    passed = shared.withColumn("similarity", alike).where(F.col("similarity") >= similarity)
    best = passed.groupBy("t", "item").agg(F.max_by(F.struct("pos", "m", "k", "similarity"), F.struct("similarity", -F.col("pos"))).alias("x"))
    named = benchmark.select("item_id", text_key("text").alias("item"))
    best = best.join(named, "item").select("t", "item_id", F.col("x.pos").cast("long").alias("word_start"), (F.col("x.m") + F.col("x.k") - 1).cast("long").alias("n_words"), F.col("x.similarity").alias("similarity"))
    return cut_lineage(best, "leak-best")


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, item_id, word_start, n_words, similarity) for each row and item with a window that reaches the similarity."""
    return docs.select(F.col(key), text_key(text).alias("t")).join(leaks_by_text(docs, benchmark, similarity, text), "t").drop("t")


def _ceil(x: float) -> int:
    return int(-(-(x - 1e-9) // 1))


def shingles_by_size(w: str, k: str) -> Column:
    """Shingles of as many words as column k says, 1 to SHINGLE."""
    out = F.when(F.col(k) == SHINGLE, shingles(F.col(w), SHINGLE))
    for n in range(1, SHINGLE):
        out = out.when(F.col(k) == n, shingles(F.col(w), n))
    return out


def remove_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, text: str = "text") -> DataFrame:
    """The documents without any leaked item, with their own columns."""
    bad = cut_lineage(leaks_by_text(docs, benchmark, similarity, text).select(F.col("t").alias("_leak_t")).distinct(), "leak-texts")
    return docs.join(bad, text_key(text) == F.col("_leak_t"), "left_anti")
