"""Repeated byte strings across documents: common-prefix interval trees over enhanced suffix arrays.

1. Copies of a whole text are looked at once, under their smallest key.
2. Each window of `length` bytes is named by the least hash among its GRAM-byte strings, so equal windows have equal
   names and neighbouring windows mostly share one: a text becomes runs of windows of one name, 1 in 14 bytes. Names
   are counted over all documents; only those of two keys or more matter. (Names travel packed, 5 bytes each.)
3. The stretches of those runs are cut out and brought together by name. In each task, the windows of its stretches
   are suffix-sorted together with the lengths of their common prefixes (an enhanced suffix array). A stack-scan
   over the prefix lengths gives the intervals of the prefix tree, each a string with all places where it starts; it
   is a maximal repeat if the bytes on its left differ. Every interval of `length` bytes or more is one group.
4. In a group, the bytes of every place under a larger key than the smallest are covered.

A name that more than MANY texts have would bring as many different stretches into one task. Its stretches are cut into their
windows instead, each named by its own hash: equal ones follow each other in order of key, and nothing else meets.

All windows of another name meet in one place, so a group has all its occurrences. A stretch ends where its name does, and a
repeat that reaches the edge of a stretch counts as diverse there; what is covered is the union over stretches.
Equal stretches follow each other in order of key: all but the first are covered and need not be kept.

Nulls: a null text is empty; a row with null key neither covers nor is covered. Rows of one key never cover each
other. Texts under `length` bytes are kept. An empty table gives no rows. Extra columns are ignored.
"""

import hashlib
from collections.abc import Iterator


import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8, width

GRAM, LENGTH, SEED = 24, 50, 42
#: Longest stretch in bytes: suffixes are compared whole.
STRETCH, WORDS, ROW = 80, 10, 112
TEXT_AT_ONCE, STRETCHES_AT_ONCE, RANGE_BYTES = 32 << 20, 1 << 15, 64 << 20
BORDER = 256
#: Texts with one name, above which its windows are dealt out one by one; how such a name is marked.
MANY, MARK = 1 << 13, 1 << 62


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (fixed multipliers)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def window_names(data: bytes, length: int = LENGTH) -> np.ndarray:
    """The name of each window of `length` bytes: the least hash of the GRAM-byte strings in it."""
    n = len(data)
    if n < length:
        return np.zeros(0, np.uint64)
    h = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    by = {1: h}
    for size in (1, 2, 4, 8):
        p = by[size]
        m = np.uint64(pow(0x9E3779B97F4A7C15, size, 1 << 64))
        by[2 * size] = p[:-size] * m + p[size:]
    a, b = by[16], by[8]
    h = mixed(a[: n - GRAM + 1] * np.uint64(pow(0x9E3779B97F4A7C15, 8, 1 << 64)) + b[16:])
    span = length - GRAM + 1  # strings in a window
    size = 1
    while 2 * size <= span:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    rest = span - size
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def runs(names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window of each run of one name, and the names mixed anew (least hashes are small)."""
    if not len(names):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), names
    first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
    last = np.concatenate([first[1:] - 1, [len(names) - 1]])
    return first, last, mixed(names[first] ^ np.uint64(0xA5A5A5A5A5A5A5A5))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _columns(batch: pa.RecordBatch, *names: str) -> zip:
    return zip(*(batch.column(c).to_pylist() for c in names), strict=True)


def packed_names(docs: DataFrame, ranges: int, length: int) -> DataFrame:
    """(r, texts, counts, names): distinct names of each text in one range of names, many texts to a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            names = np.concatenate([n for _, n in held])
            text = np.repeat(np.arange(len(held)), [len(n) for _, n in held])
            ids = np.array([t for t, _ in held], np.uint64)
            r = ((names >> np.uint64(32)) % np.uint64(ranges)).astype(np.int64)
            order = np.argsort(r, kind="stable")
            edge = np.searchsorted(r[order], np.arange(ranges + 1))
            rows = []
            for k in range(ranges):
                at = order[edge[k]: edge[k + 1]]
                if len(at):
                    which, n = np.unique(text[at], return_counts=True)
                    rows.append((k, ids[which].tobytes(), n.astype(np.uint32).tobytes(), names[at].astype(np.uint32).tobytes()))
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(kinds)], names=["r", "texts", "counts", "names"])

        for b in batches:
            for (data,) in _columns(b, "data"):
                found = np.unique(runs(window_names(data, length))[2])
                if len(found):
                    held.append((xxhash.xxh64_intdigest(data, SEED), found))
                    size += len(data)
                if size >= TEXT_AT_ONCE:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return docs.select("data").mapInArrow(run, "r int, texts binary, counts binary, names binary")


def shared_names(packs: DataFrame, many: int = MANY) -> DataFrame:
    """(text_id, names): of each text the names that another text has as well, with MARK if more than `many` texts do."""

    def run(table: pa.Table) -> pa.Table:
        joined = lambda c, t: np.concatenate([np.frombuffer(x, t) for x in table.column(c).to_pylist()])
        texts = np.repeat(joined("texts", np.uint64), joined("counts", np.uint32))
        names = joined("names", np.uint32)
        order = np.argsort(names, kind="stable")
        names, texts = names[order], texts[order]
        first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
        n = np.diff(np.append(first, len(names)))
        shared = np.repeat(np.minimum.reduceat(texts, first) != np.maximum.reduceat(texts, first), n)
        names, texts, mark = names[shared], texts[shared], np.repeat(np.where(n > many, MARK, 0), n)[shared]
        order = np.argsort(texts, kind="stable")
        names, texts, mark = names[order], texts[order], mark[order]
        first = np.flatnonzero(np.concatenate([[True], texts[1:] != texts[:-1]])) if len(texts) else np.zeros(0, np.int64)
        r = np.int64(table.column("r")[0].as_py())
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(texts)), pa.int32()), pa.array((r << np.int64(32)) | names.astype(np.int64) | mark))
        return pa.table({"text_id": pa.array(signed(texts[first])), "names": lists})

    found = packs.groupBy("r").applyInArrow(run, "text_id long, names array<long>")
    return found.groupBy("text_id").agg(F.flatten(F.collect_list("names")).alias("names"))  # at most one per window of a text


CUT = "name long, key long, text_id long, start long, end long, stretch binary"


def stretches(joined: DataFrame, ranges: int, length: int) -> DataFrame:
    """CUT: the stretches of shared names; of names with MARK, their windows under the hash of each.

    Of equal stretches in one batch, those of the smallest key are sent. The others are covered already: they come
    without their bytes, under a name spread by their key, and pass through.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {c: [] for c in ("name", "key", "text_id", "start", "end")}
            cut: list[bytes | None] = []
            seen: dict[bytes, int] = {}
            names, keys, texts = b.column("names"), b.column("key").to_pylist(), b.column("data")
            for i in sorted(range(len(keys)), key=keys.__getitem__):
                data, key = texts[i].as_py(), keys[i]
                first, last, name = runs(window_names(data, length))
                code = ((((name >> np.uint64(32)) % np.uint64(ranges)) << np.uint64(32)) | (name & np.uint64(0xFFFFFFFF))).astype(np.int64)
                listed = names[i].values.to_numpy()
                marked = np.isin(code | MARK, listed)
                kept = marked | np.isin(code, listed)
                first, last, code, marked = first[kept], last[kept], code[kept], marked[kept]
                most = np.where(marked, 1, STRETCH - length + 1)
                parts = (last - first) // most + 1  # long runs (of periodic text) in pieces
                k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                most, marked = np.repeat(most, parts), np.repeat(marked, parts)
                start = np.repeat(first, parts) + k * most
                end = np.minimum(start + most - 1, np.repeat(last, parts)) + length
                own: list[bytes | None] = [data[x:y] for x, y in zip(start.tolist(), end.tolist(), strict=True)]
                code = np.repeat(code, parts)
                for j in np.flatnonzero(marked).tolist():
                    code[j] = xxhash.xxh64_intdigest(own[j], SEED) >> 1
                spread = int(mixed(np.array([key], np.int64).view(np.uint64))[0] >> np.uint64(1))
                for j, s in enumerate(own):
                    if seen.setdefault(s, key) < key:
                        own[j], code[j] = None, spread
                cut += own
                for c, v in (("name", code), ("key", np.full(len(start), key)), ("text_id", signed(np.full(len(start), xxhash.xxh64_intdigest(data, SEED), np.uint64))), ("start", start), ("end", end)):
                    out[c].append(v.astype(np.int64))
            cols = [pa.array(np.concatenate(v) if v else np.zeros(0, np.int64)) for v in out.values()]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(cut, pa.binary())], names=[*out, "stretch"])

    return joined.select("key", "data", "names").mapInArrow(run, CUT)


def suffix_array(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes in lexicographic order: text, offset, common prefix with the one before, byte on the left.

    Of all suffixes of `length` bytes or more, those whose first `length` bytes start elsewhere too.
    """
    lens = np.array([len(t) for t in texts])
    n = lens - length + 1
    of = np.repeat(np.arange(len(texts)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    # texts stand in rows of ROW bytes, filled up with zeros; eight bytes from each place on as one big-endian word
    flat = np.frombuffer(b"".join(t.ljust(ROW, b"\0") for t in texts) + bytes(8), np.uint8)
    eight = flat.astype(np.uint64)
    for k in (1, 2, 4):
        eight = (eight[:-k] << np.uint64(8 * k)) | eight[k:]
    base = of * ROW + at
    # a suffix without an equal first `length` bytes anywhere is in no interval: only the others are sorted
    key = np.zeros(len(of), np.uint64)
    for place in [*range(0, length - 8, 8), length - 8]:
        key = mixed(key ^ eight[base + place])
    order = np.argsort(key, kind="stable")
    same = np.concatenate([[False], key[order][1:] == key[order][:-1], [False]])
    kept = np.sort(order[same[1:] | same[:-1]])
    of, at, base = of[kept], at[kept], base[kept]
    left = lens[of] - at
    words = np.stack([eight[base + 8 * w] for w in range(WORDS)]) if len(of) else np.zeros((WORDS, 0), np.uint64)
    order = np.lexsort((left, *words[::-1]))
    words, left, of, at, base = words[:, order], left[order], of[order], at[order], base[order]
    lcp = np.zeros(len(of), np.int64)
    if len(of) > 1:
        equal = np.ones(len(of) - 1, bool)
        common = np.zeros(len(of) - 1, np.int64)
        for w in range(WORDS):
            x = words[w, 1:] ^ words[w, :-1]
            same = x == 0
            # leading zero bytes of the first word that differs: bits below the highest one are set, then counted
            for k in (1, 2, 4, 8, 16, 32):
                x |= x >> np.uint64(k)
            common += np.where(equal, (64 - np.bitwise_count(x).astype(np.int64)) // 8, 0)
            equal &= same
            if not equal.any():
                break
        lcp[1:] = np.minimum(common, np.minimum(left[1:], left[:-1]))
    before = np.where(at > 0, flat[base - 1].astype(np.int64), BORDER)
    return of, at, lcp, before


def intervals(lcp: np.ndarray, before: np.ndarray, owner: np.ndarray, length: int) -> list[tuple[int, int, int, int]]:
    """Stack-scan: (first, last, common prefix, smallest owner) of each interval that is diverse on the left."""
    out: list[tuple[int, int, int, int]] = []
    near = np.flatnonzero(lcp >= length)
    if not len(near):
        return out
    # stretches of the suffix array whose neighbours share `length` bytes are scanned one by one
    split = np.flatnonzero(np.diff(near) > 1)
    for lo, hi in zip(near[np.append(0, split + 1)], near[np.append(split, len(near) - 1)], strict=True):
        lo = int(lo) - 1
        p, b, o = lcp[lo: hi + 1].tolist(), before[lo: hi + 1].tolist(), owner[lo: hi + 1].tolist()
        stack: list[list] = []  # common prefix, first, smallest owner, byte on the left (BORDER: diverse)
        for i in range(1, len(p) + 1):
            depth = p[i] if i < len(p) else 0
            node = [0, i - 1, o[i - 1], b[i - 1]]  # the suffix i - 1 by itself
            while stack and stack[-1][0] > depth:
                top = stack.pop()
                top[2] = min(top[2], node[2])
                top[3] = top[3] if top[3] == node[3] else BORDER
                if top[3] == BORDER:
                    out.append((lo + top[1], lo + i - 1, top[0], top[2]))
                node = [0, top[1], top[2], top[3]]
            if depth >= length:
                if stack and stack[-1][0] == depth:
                    stack[-1][2] = min(stack[-1][2], node[2])
                    stack[-1][3] = stack[-1][3] if stack[-1][3] == node[3] else BORDER
                else:
                    stack.append([depth, node[1], node[2], node[3]])
    return out


def repeat_groups(texts: list[bytes], owner: np.ndarray, length: int = LENGTH) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Maximal repeats of texts of at most STRETCH bytes: (length, smallest owner, all (text, offset))."""
    of, at, lcp, before = suffix_array(texts, length)
    return [(n, m, list(zip(of[a: b + 1].tolist(), at[a: b + 1].tolist(), strict=True))) for a, b, n, m in intervals(lcp, before, owner[of], length)]


def covered(texts: list[bytes], owner: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of what smaller owners cover, merged per text."""
    of, at, lcp, before = suffix_array(texts, length)
    found = intervals(lcp, before, owner[of], length)
    if not found:
        return (np.zeros(0, np.int64),) * 3
    first, last, n, m = np.array(found, np.int64).T
    size = last - first + 1
    i = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    n, m = np.repeat(n, size), np.repeat(m, size)
    hit = owner[of[i]] > m
    i, n = i[hit], n[hit]
    start = of[i] * (2 * STRETCH) + at[i]  # one line of numbers, with room between the texts
    return merged(start, start + n)


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > reach[:-1]]) if len(start) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    a, b = start[at], reach[np.append(at[1:], len(start)) - 1] if len(at) else start
    return a // (2 * STRETCH), a % (2 * STRETCH), b - a // (2 * STRETCH) * (2 * STRETCH)


def cover(cut: DataFrame, length: int) -> DataFrame:
    """(key, text_id, start, end) of covered bytes, from stretches that come in order of name, stretch and key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[bytes] = []
        rows: list[tuple[int, int, int]] = []  # the first of equal stretches
        last = (None, None)

        def settle() -> list[tuple[int, int, int, int]]:
            owner = np.array([x[0] for x in rows], np.int64)
            return [(rows[i][0], rows[i][1], rows[i][2] + a, rows[i][2] + b) for i, a, b in zip(*(x.tolist() for x in covered(texts, owner, length)), strict=True)]

        for b in batches:
            out: list[tuple[int, int, int, int]] = []
            for name, stretch, key, text_id, start, end in _columns(b, "name", "stretch", "key", "text_id", "start", "end"):
                if stretch is None:
                    out.append((key, text_id, start, end))
                    continue
                if last == (name, stretch):
                    if key > rows[-1][0]:
                        out.append((key, text_id, start, end))
                    else:  # the same key again: covered by what covers the first
                        texts.append(stretch)
                        rows.append((key, text_id, start))
                    continue
                if name != last[0] and len(texts) >= STRETCHES_AT_ONCE:
                    out += settle()
                    texts, rows = [], []
                last = (name, stretch)
                texts.append(stretch)
                rows.append((key, text_id, start))
            yield _spans(out)
        if texts:
            yield _spans(settle())

    return cut.mapInArrow(run, "key long, text_id long, start long, end long")


def _spans(out: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    a = np.array(out, np.int64).reshape(-1, 4)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a[:, i])) for i in range(4)], names=["key", "text_id", "start", "end"])


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>"


def covered_spans(docs: DataFrame, length: int = LENGTH, many: int = MANY) -> DataFrame:
    """(key, text_id, start, end) over `docs` (key not null, data): bytes covered by strings of smaller keys."""
    total = docs.agg(F.sum(F.octet_length("data").cast("long"))).first()[0] or 0
    ranges = max(width(docs.sparkSession), total // RANGE_BYTES)
    ids = docs.select("key", F.md5("data").alias("t"), F.xxhash64("data").alias("text_id"), F.octet_length("data").cast("long").alias("n")).where(F.col("n") >= length)
    owners = ids.groupBy("t").agg(F.min("key").alias("key"), F.first("text_id").alias("text_id"))
    copies = ids.join(owners.select("t", F.col("key").alias("owner")), "t").where("key > owner")
    copies = copies.select("key", "text_id", F.lit(0).cast("long").alias("start"), F.col("n").alias("end"))
    shared = shared_names(packed_names(docs, ranges, length), many).join(owners.select("text_id", "key"), "text_id")
    shared = shared.groupBy("key").agg(F.flatten(F.collect_list("names")).alias("names"))
    cut = stretches(docs.join(shared, "key"), ranges, length)
    dealt = cut.repartition(4 * width(docs.sparkSession), "name").sortWithinPartitions("name", "stretch", "key")
    return cover(dealt, length).unionByName(copies)


def remove_repeats(docs: DataFrame, length: int = LENGTH, text: str = "text", key: str = "doc_id") -> DataFrame:
    """RESULT for each row: spans are the maximal runs of removed bytes."""
    if not GRAM <= length <= STRETCH:
        raise ValueError(f"length is {GRAM} to {STRETCH}")
    every = docs.select(F.col(key).cast("long").alias("key"), utf8(text).alias("data"))
    base = every.where("key is not null")
    spans = covered_spans(base, length).groupBy("key").agg(F.collect_list(F.struct("text_id", "start", "end")).alias("spans"))
    joined = base.join(spans, "key", "left").unionByName(every.where("key is null"), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            spans = b.column("spans")
            for i, (k, data) in enumerate(_columns(b, "key", "data")):
                found: list[tuple[int, int]] = []
                if spans[i].is_valid:
                    own = spans[i].values
                    ids, start, end = (own.field(j).to_numpy(zero_copy_only=False) for j in range(3))
                    mine = ids == np.uint64(xxhash.xxh64_intdigest(data, SEED)).astype(np.int64)
                    found = joined_spans(start[mine], end[mine])
                kept = b"".join(data[x:y] for x, y in zip([0, *(e for _, e in found)], [*(s for s, _ in found), len(data)], strict=True))
                out.append((k, len(data), len(data) - len(kept), len(found), hashlib.sha256(kept).hexdigest(), [{"start": s, "end": e} for s, e in found]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], t) for j, t in enumerate(kinds)], names=list(names))

    return joined.mapInArrow(run, RESULT)


def joined_spans(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Spans that touch or overlap as one."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order]) if len(end) else end
    at = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]])) if len(start) else np.zeros(0, np.int64)
    return list(zip(start[at].tolist(), reach[np.append(at[1:], len(start)) - 1].tolist() if len(at) else [], strict=True))
