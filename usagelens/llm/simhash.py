"""Near-duplicates by SimHash fingerprints, joined by a binary trie with itself.

Fingerprint: of each shingle of words an XXH64 (seed 42); a bit is set if it is set in over half the hashes. A text
with fewer words than a shingle is one shingle; a text without words (null, empty) has fingerprint zero and is
linked like any other.

Join: distinct fingerprints form a binary trie. Node pairs are walked together from the top; each bit in which they
differ is charged to the pair, and a pair that has spent its errors is dropped with all below it. Of two
fingerprints within `errors` bits, one half of the bits differs in errors // 2 at most, or the other half in fewer;
so the trie is walked twice, with either half on top and that smaller allowance in it. Near the top this drops
most pairs. The top levels are dealt out by Spark: every fingerprint goes to the pairs of top nodes it can take part
in, and tasks walk the pairs below. Each gives back a spanning forest of what it linked, never all pairs of a
group. Components of the forest are found by joins.
"""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import utf8, width, words_of
from .components import components

SEED = 42
#: Fingerprints below one top node, about, and pairs of nodes compared directly.
NODE_ROWS, LEAF, CHUNK = 8_192, 16, 1 << 15
HASHES_AT_ONCE = 1 << 16


def shingle_hashes(data: bytes, shingle: int) -> Iterator[np.ndarray]:
    """Hashes of the shingles of a text in order, at most HASHES_AT_ONCE in an array."""
    words = words_of(data)
    if not words:
        return
    text, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    first, last = starts[: len(words) - k + 1].tolist(), ends[k - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(first), HASHES_AT_ONCE):
        part = slice(at, at + HASHES_AT_ONCE)
        yield np.array([digest(text[a:b], SEED) for a, b in zip(first[part], last[part], strict=True)], dtype="<u8")


def majority(parts: list[np.ndarray]) -> int:
    """The bits set in over half the hashes, as a signed integer; zero without hashes."""
    counts, n = np.zeros(64, np.int64), 0
    for hashes in parts:
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


def fingerprint(data: bytes, shingle: int) -> int:
    """64 bits, as a signed integer."""
    return majority(list(shingle_hashes(data, shingle)))


def fingerprints(text: str | Column, shingle: int) -> Column:
    """Fingerprint (long) of a text column."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype=np.int64)

    return run(utf8(text))


def hexadecimal(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


class Forest:
    """Links between positions of an array, kept as the smallest position reached."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            i, j = self.up[i], self.up[j]
            apart = i != j
            i, j = np.minimum(i[apart], j[apart]), np.maximum(i[apart], j[apart])
            if len(i):
                np.minimum.at(self.up, j, i)
            while True:
                nearer = self.up[self.up]
                if (nearer == self.up).all():
                    break
                self.up = nearer


def walk(a: np.ndarray, b: np.ndarray | None, depth: int, errors: int, top_errors: int, forest: Forest) -> None:
    """Link all of sorted `a` with all of sorted `b` (None: a with itself) within `errors` bits.

    Both lie below one trie node each, at `depth`. Above bit 32 a pair may spend `top_errors`. Positions in the forest:
    those of a, then those of b.
    """
    own = b is None
    b, shift = (a, 0) if own else (b, len(a))
    if not len(a) or not len(b):
        return
    used = 0 if own else int(np.bitwise_count((a[0] ^ b[0]) >> np.uint64(64 - depth))) if depth else 0
    one = lambda x: np.array([x], np.int64)
    todo = [(depth, one(0), one(len(a)), one(0), one(len(b)), one(used))]
    while todo:
        d, a0, a1, b0, b1, u = todo.pop()
        if len(a0) > CHUNK:
            h = len(a0) // 2
            todo += [(d, a0[:h], a1[:h], b0[:h], b1[:h], u[:h]), (d, a0[h:], a1[h:], b0[h:], b1[h:], u[h:])]
            continue
        small = (a1 - a0) * (b1 - b0) <= LEAF
        if d == 64:
            small[:] = True
        if small.any():
            x0, nx, y0, ny = a0[small], (a1 - a0)[small], b0[small], (b1 - b0)[small]
            n = nx * ny
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            i, j = np.repeat(x0, n) + k // np.repeat(ny, n), np.repeat(y0, n) + k % np.repeat(ny, n)
            near = np.bitwise_count(a[i] ^ b[j]) <= errors
            if own:
                near &= i != j
            forest.link(i[near], j[near] + shift)
        a0, a1, b0, b1, u = (x[~small] for x in (a0, a1, b0, b1, u))
        if not len(a0):
            continue
        bit = np.uint64(1 << (63 - d))
        low = np.uint64((1 << (64 - d)) - 1)
        am = np.clip(np.searchsorted(a, (a[a0] & ~low) | bit), a0, a1)
        bm = np.clip(np.searchsorted(b, (b[b0] & ~low) | bit), b0, b1)
        allowed = top_errors if d < 32 else errors
        same = own & (a0 == b0) & (a1 == b1)
        pairs = [(a0, am, b0, bm, u, None), (am, a1, bm, b1, u, None), (a0, am, bm, b1, u + 1, u < allowed), (am, a1, b0, bm, u + 1, (u < allowed) & ~same)]
        parts = []
        for *p, keep in pairs:
            keep = (p[1] > p[0]) & (p[3] > p[2]) & (True if keep is None else keep)
            parts.append([x[keep] for x in p])
        todo.append((d + 1, *(np.concatenate(x) for x in zip(*parts, strict=True))))


def _top_pairs(depth: int, errors: int) -> list[int]:
    """All ways to change up to `errors` of the first `depth` bits."""
    return [sum(1 << b for b in bits) for n in range(errors + 1) for bits in combinations(range(depth), n)]


def links(found: DataFrame, errors: int) -> DataFrame:
    """Distinct fingerprints (fp) to edges (a, b) that connect exactly those within `errors` bits, by a forest."""
    found = cut_lineage(found.select("fp").where("fp is not null").distinct(), "simhash-distinct")
    total = found.count()
    # deep enough that no top node holds much more than NODE_ROWS, and that there is work for every task
    depth = max(1, (max(total // NODE_ROWS, min(4 * width(found.sparkSession), total // 64)) or 1).bit_length())
    top = lambda c, n: F.shiftrightunsigned(c, 64 - n)
    while depth < 28 and total:
        most = max(found.groupBy(top(c, depth).alias("p")).count().agg(F.max("count")).first()[0] for c in (F.col("fp"), _swapped(F.col("fp"))))
        if most <= 4 * NODE_ROWS:
            break
        depth += 2
    sides = []
    for turned, top_errors in ((False, errors // 2), (True, errors - errors // 2 - 1)):
        if top_errors < 0:
            continue
        key = _swapped(F.col("fp")) if turned else F.col("fp")
        own = top(key, depth)
        changes = F.array(*[F.lit(x).cast("long") for x in _top_pairs(depth, top_errors)])
        sides.append(found.select(key.alias("key"), own.alias("own"), F.explode(changes).alias("change")).select(
            "key", "own", F.lit(turned).alias("turned"), F.least("own", F.col("own").bitwiseXOR(F.col("change"))).alias("lo"), F.greatest("own", F.col("own").bitwiseXOR(F.col("change"))).alias("hi")
        ))
    dealt = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])

    def run(table: pa.Table) -> pa.Table:
        key = table.column("key").to_numpy().astype(np.uint64)
        own, lo, hi = (table.column(c).to_numpy() for c in ("own", "lo", "hi"))
        turned = table.column("turned")[0].as_py()
        a = np.sort(key[own == lo])
        b = None if lo[0] == hi[0] else np.sort(key[own == hi])
        forest = Forest(len(a) + (0 if b is None else len(b)))
        walk(a, b, depth, errors, errors - errors // 2 - 1 if turned else errors // 2, forest)
        both = a if b is None else np.concatenate([a, b])
        at = np.flatnonzero(forest.up != np.arange(len(both)))
        x, y = both[at], both[forest.up[at]]
        if turned:
            x, y = ((v << np.uint64(32)) | (v >> np.uint64(32)) for v in (x, y))
        return pa.table({"a": x.astype(np.int64), "b": y.astype(np.int64)})

    return dealt.groupBy("turned", "lo", "hi").applyInArrow(run, "a long, b long")


def _swapped(fp: Column) -> Column:
    """The two halves of the bits in the other order."""
    return F.shiftleft(fp, 32).bitwiseOR(F.shiftrightunsigned(fp, 32))


def groups(docs: DataFrame, shingle: int = 3, errors: int = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: key, fp and component_id (smallest key in its component; null keys are passed over)."""
    rows = cut_lineage(docs.select(F.col(key).alias("key"), fingerprints(text, shingle).alias("fp")), "simhash-rows")
    least = cut_lineage(rows.groupBy("fp").agg(F.min("key").alias("least")), "simhash-least")
    joined = components(links(least, errors))
    root = least.join(joined, least["fp"] == joined["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    smallest = root.groupBy("root").agg(F.min("least").alias("component_id"))
    named = root.select("fp", "root").join(smallest, "root").select(F.col("fp").alias("f"), "root", "component_id")
    return rows.join(named, rows["fp"] == named["f"]).select(F.col("key").alias(key), "fp", "root", "component_id")
