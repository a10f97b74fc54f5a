"""Source divergence audit: how far the sources of a language differ in their words, and by which words.

Terms are runs of letters A-Z and of bytes from 0x80, A-Z lower-cased. Each task takes its texts in slices of SLICE_BYTES and
finds the terms by their pointers: the starts of all words in the Arrow buffer are sorted by the words they point to,
eight bytes of a word at a time (multikey quicksort: only slices of equal keys go on to the next eight bytes). Words
that are equal are then one run of pointers. Pointers are in order of group and row within a run, so a run says how
often each source has the term and in how many documents. What leaves a slice is one row per run and source; Spark
adds them up, first in the task and then by term.

A language keeps the terms that at least `least_docs` of its documents have. Smoothed shares are p = 1 + floor(10**9 *
(count + 5) / (N + 5 V)), of which all sums are exact (decimals of 38 digits where 64 bits could overflow).

Nulls in text, lang and source are read as ''. Every (lang, source) that occurs is a group, also without terms.
Repeated rows are documents of their own; ties rank by the item's bytes; long texts are cut whole (a text longer than
a slice is a slice). An empty table gives no rows. Other columns are ignored. Lists are held for the sources of one
language (the report has a row for each pair of them), never for its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import LOWER_ASCII

LEAST_DOCS, TOP, SMOOTH, UNIT = 30, 50, 5, 1_000_000_000
SLICE_BYTES, CELLS = 8 << 20, 1 << 22
LOWER = np.frombuffer(LOWER_ASCII, np.uint8)
#: Bytes of terms, after lower-casing: a-z and those from 0x80.
TERM_BYTE = np.array([97 <= c <= 122 or c >= 128 for c in range(256)])
PARTIAL = "lang string, source string, term string, n long, docs long"


def word_pointers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every term of the rows that `offsets` part; a term ends with its row."""
    inside = TERM_BYTE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = inside & (edge[:-1] | np.concatenate([[True], ~inside[:-1]]))
    last = inside & (edge[1:] | np.concatenate([~inside[1:], [True]]))
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(offsets, start, "right") - 1


def key_at(data: np.ndarray, start: np.ndarray, length: np.ndarray, depth: int) -> np.ndarray:
    """Bytes depth to depth + 8 of each word as a big-endian number, zeros behind its end. `data` has 8 bytes more."""
    key = np.zeros(len(start), np.uint64)
    for i in range(depth, depth + 8):
        here = np.where(i < length, data[np.minimum(start + i, len(data) - 1)], 0)
        key = (key << np.uint64(8)) | here.astype(np.uint64)
    return key


def pointer_sort(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, run): pointers in order of their words, and the number of each pointer's run of equal words.

    Stable: pointers to equal words stay in their order.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    key = key_at(padded, start, length, 0)
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])[: len(order)]
    depth = 8
    while True:
        run = np.cumsum(new) - 1
        longer = np.zeros(run[-1] + 1 if len(run) else 0, bool)
        longer[run[length[order] > depth]] = True
        size = np.bincount(run) if len(run) else np.zeros(0, int)
        open_at = np.flatnonzero((longer & (size > 1))[run])  # slices that are equal so far, and go on
        if not len(open_at):
            return order, run
        mine = order[open_at]
        key = key_at(padded, start[mine], length[mine], depth)
        again = np.lexsort((key, run[open_at]))
        order[open_at] = mine[again]
        key = key[again]
        new[open_at[1:]] |= key[1:] != key[:-1]
        depth += 8


def runs(data: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(term, group, n, docs) of the rows of a slice; `group` is the number of each row's group."""
    data = LOWER[data]
    start, end, row = word_pointers(data, offsets)
    by_group = np.argsort(group[row], kind="stable")
    start, row, length = start[by_group], row[by_group], (end - start)[by_group]
    order, run = pointer_sort(data, start, length)
    start, row, length = start[order], row[order], length[order]
    own = group[row]
    head = np.flatnonzero(np.concatenate([[True], (run[1:] != run[:-1]) | (own[1:] != own[:-1])])[: len(run)])
    fresh = np.concatenate([[True], (run[1:] != run[:-1]) | (row[1:] != row[:-1])])[: len(run)]
    n = np.diff(np.append(head, len(run)))
    docs = np.add.reduceat(fresh.astype(np.int64), head) if len(head) else np.zeros(0, np.int64)
    at, size = start[head], length[head]
    ends = np.concatenate([[0], np.cumsum(size)])
    letters = data[np.arange(ends[-1]) + np.repeat(at - ends[:-1], size)]
    term = pa.Array.from_buffers(pa.large_utf8(), len(head), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(letters.tobytes())])
    return term, own[head], n, docs


def slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Rows from and to, of SLICE_BYTES about."""
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE_BYTES, "right")) - 1)
        yield a, b
        a = b


def partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (lang, source, data) to PARTIAL. Each group has a row with an empty term, which says that it is there."""
    text, schema = pa.string(), pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
    for b in batches:
        if not b.num_rows:
            continue
        names = pa.StructArray.from_arrays([b.column("lang").cast(text), b.column("source").cast(text)], ["lang", "source"])
        pairs = [(x["lang"], x["source"]) for x in names.to_pylist()]
        known = {p: i for i, p in enumerate(sorted(set(pairs)))}
        group = np.array([known[p] for p in pairs])
        lang, source = (pa.array([p[i] for p in known], text) for i in (0, 1))
        zero = pa.array(np.zeros(len(known), np.int64))
        yield pa.RecordBatch.from_arrays([lang, source, pa.array([""] * len(known), text), zero, zero], schema=schema)
        column = b.column("data").cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
        for a, z in slices(offsets):
            term, own, n, docs = runs(data[offsets[a]: offsets[z]], offsets[a: z + 1] - offsets[a], group[a:z])
            own = pa.array(own, pa.int64())
            yield pa.RecordBatch.from_arrays([lang.take(own), source.take(own), term.cast(text), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], schema=schema)


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10**9 * (count + 5) / (total + 5 terms)), exactly."""
    wide = lambda c: c.cast("decimal(19,0)")
    of, whole = (wide(count) + SMOOTH) * UNIT, wide(total) + wide(terms) * SMOOTH
    return F.call_function("div", of, whole) + 1


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, term, cells, total): terms of each language with their counts by source; the empty term lists all sources."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(plain(lang).alias("lang"), plain(source).alias("source"), plain(text).cast("binary").alias("data"))
    counts = rows.mapInArrow(partial_counts, PARTIAL).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = counts.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("cells"))
    return by_term.where((F.col("docs") >= least_docs) | (F.col("term") == "")).select("lang", "term", "cells", "total")


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (lang, p) to (lang, i, j, value): distances of places in p, summed over the terms of a batch."""
    for b in batches:
        langs = np.array(b.column("lang").to_pylist(), object)
        column = b.column("p")
        ends, flat = column.offsets.to_numpy(), column.values.to_numpy()
        for lang in sorted(set(langs)):
            rows = np.flatnonzero(langs == lang)
            width = int(ends[rows[0] + 1] - ends[rows[0]])
            if width < 2:
                continue
            sums = np.zeros((width, width), np.int64)
            step = max(1, CELLS // width)
            for k in range(0, len(rows), step):
                p = flat[ends[rows[k: k + step]][:, None] + np.arange(width)]
                for i in range(width - 1):
                    sums[i, i + 1:] += np.abs(p[:, i + 1:] - p[:, i: i + 1]).sum(axis=0)
            sums += sums.T
            i, j = np.nonzero(~np.eye(width, dtype=bool))
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(i), pa.string()), "i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "value": pa.array(sums[i, j], pa.int64())})


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` has the distances to the other sources of the language, part
    `term` the `top` terms that the source has more of than its language."""
    found = cut_lineage(kept_terms(docs, least_docs, text, lang, source), "audit-terms")
    terms = found.where("term <> ''")
    cells = terms.select("lang", "term", "total", F.inline("cells"))
    per_lang = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("n_lang"))
    per_group = cells.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    groups = found.where("term = ''").select("lang", F.explode("cells.source").alias("source")).join(per_group, ["lang", "source"], "left").join(per_lang, "lang", "left")
    groups = cut_lineage(groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_group", "n_lang", "v")]), "audit-groups")

    more = cells.where("n > 0").join(groups, ["lang", "source"])
    more = more.withColumn("value", share(F.col("n"), F.col("n_group"), F.col("v")) - share(F.col("total"), F.col("n_lang"), F.col("v"))).where("value > 0")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    by_term = more.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)

    listed = groups.groupBy("lang", "v").agg(F.sort_array(F.collect_list(F.struct("source", "n_group"))).alias("groups"))
    listed = cut_lineage(listed, "audit-sources")
    has = F.map_from_entries("cells")
    p = F.transform("groups", lambda g: share(F.coalesce(has[g["source"]], F.lit(0)), g["n_group"], F.col("v")))
    summed = terms.join(listed, "lang").select("lang", p.alias("p")).mapInArrow(_distances, "lang string, i int, j int, value long")
    # every pair is there with zero, also in languages that keep no term
    each = listed.select("lang", F.posexplode(F.transform("groups", lambda g: g["source"])).alias("i", "one"), "groups")
    none = each.select("lang", "i", F.posexplode("groups").alias("j", "other")).where("i <> j").select("lang", "i", "j", F.lit(0).cast("long").alias("value"))
    pairs = summed.unionByName(none).groupBy("lang", "i", "j").agg(F.sum("value").alias("value")).join(listed, "lang")
    pairs = pairs.select("lang", F.col("groups")[F.col("i")]["source"].alias("source"), F.lit("pair").alias("part"), F.col("groups")[F.col("j")]["source"].alias("item"), "value")
    return pairs.withColumn("rank", F.row_number().over(ranked)).unionByName(by_term)
