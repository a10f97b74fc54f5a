"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A paragraph is a line; a long line is cut behind sentence ends. The n-th occurrence of a paragraph in a text has its
own digest, so repeats count. Each digest is put in HASHES cells of a sketch, one in each third; a cell has a count,
the XOR of its digests and the XOR of their checks. The sketch of one version minus that of another holds only what
differs; cells with a single digest are peeled until nothing is left. If that fails, both sketches are built again
with twice as many cells, until it succeeds (at a size that gives each digest a cell to itself it does).

The likeness of two texts is the Jaccard similarity of their paragraphs, with repeats, found from the peeled difference
and the number of paragraphs in each sketch. Two texts without paragraphs are alike (1).

A fingerprint is `cells:paragraphs:` and the cells in base64; equal texts have equal fingerprints. Null texts
are empty. Versions follow each other in descending key order; null keys come last; among rows with one key, order
is by text. A single row follows itself. An empty table gives no rows. Extra columns are ignored.
"""

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8, width

HASHES, CELLS, LONG_LINE = 3, 24, 80
CELL = np.dtype([("count", "<i4"), ("key", "<u8"), ("check", "<u4")])
MAX_BUCKETS = 4096
#: Texts, and paragraphs, compared together.
AT_ONCE, DIGESTS_AT_ONCE = 512, 1 << 18


def paragraphs(data: bytes) -> list[bytes]:
    """Lines without the empty ones; lines over LONG_LINE bytes are cut behind sentence ends."""
    out: list[bytes] = []
    for line in data.split(b"\n"):
        if len(line) > LONG_LINE:
            out += line.replace(b". ", b".\n").split(b"\n")
        elif line:
            out.append(line)
    return [x for x in out if x]


def digests(data: bytes) -> np.ndarray:
    """One digest per paragraph; that of the n-th occurrence of the same paragraph depends on n."""
    found = np.array([xxhash.xxh64_intdigest(p) for p in paragraphs(data)], np.uint64)
    if len(found) < 2:
        return found
    order = np.argsort(found, kind="stable")
    s = found[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    if new.all():
        return found
    nth = np.arange(len(s)) - np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
    return np.where(nth > 0, mixed(s + nth.astype(np.uint64)), s)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (fixed multipliers)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def places(keys: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells of each key (HASHES columns, each in its own part of the sketch) and its check."""
    part, out, h = cells // HASHES, [], keys
    for i in range(HASHES):
        h = mixed(h + np.uint64(i + 1))
        out.append(i * part + ((h >> np.uint64(32)) % np.uint64(part)).astype(np.int64))
    return np.stack(out, axis=1), (mixed(h) >> np.uint64(32)).astype(np.uint32)


def sketch(keys: np.ndarray, cells: int = CELLS) -> np.ndarray:
    return sketches([keys], cells)[0]


def sketches(texts: list[np.ndarray], cells: int) -> np.ndarray:
    """A row of cells for each list of digests."""
    out = np.zeros(len(texts) * cells, CELL)
    keys = np.concatenate([*texts, np.zeros(0, np.uint64)])
    if len(keys):
        at, check = places(keys, cells)
        at = (at + np.repeat(np.arange(len(texts)) * cells, [len(t) for t in texts])[:, None]).ravel()
        out["count"] = np.bincount(at, minlength=len(out))
        np.bitwise_xor.at(out["key"], at, np.repeat(keys, HASHES))
        np.bitwise_xor.at(out["check"], at, np.repeat(check, HASHES))
    return out.reshape(len(texts), cells)


def subtract(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(a.shape, CELL)
    out["count"], out["key"], out["check"] = a["count"] - b["count"], a["key"] ^ b["key"], a["check"] ^ b["check"]
    return out


def peel(diff: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Peel a difference in each row: row, digest and sign (1: first version) of what was found, and which rows are done."""
    n, cells = diff.shape
    count, key, left = (np.ascontiguousarray(diff[c]).ravel() for c in ("count", "key", "check"))
    found: list[tuple] = []
    while True:
        single = np.flatnonzero(np.abs(count) == 1)
        keys = key[single]
        where, check = places(keys, cells)
        where += (single // cells * cells)[:, None]
        good = (check == left[single]) & (where == single[:, None]).any(axis=1)
        single, keys, where, check = single[good], keys[good], where[good], check[good]
        if not len(single):
            break
        row = single // cells
        order = np.lexsort((keys, row))  # a digest may be alone in several cells
        new = np.concatenate([[True], (keys[order][1:] != keys[order][:-1]) | (row[order][1:] != row[order][:-1])])
        take = order[new]
        keys, where, check, row, sign = keys[take], where[take].ravel(), check[take], row[take], count[single[take]]
        found.append((row, keys, sign))
        np.subtract.at(count, where, np.repeat(sign, HASHES))
        np.bitwise_xor.at(key, where, np.repeat(keys, HASHES))
        np.bitwise_xor.at(left, where, np.repeat(check, HASHES))
    done = ~((count != 0) | (key != 0) | (left != 0)).reshape(n, cells).any(axis=1)
    row, keys, sign = (np.concatenate([x[i] for x in found]) if found else np.zeros(0, t) for i, t in enumerate((np.int64, np.uint64, np.int32)))
    return row, keys, sign, done


def differences(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """For each pair of versions: digests only in the first, only in the second, and the cells it took."""
    out: list = [None] * len(pairs)
    # no sketch smaller than the difference of the numbers can be peeled
    need = [max(CELLS, CELLS * (1 << max(0, (abs(len(a) - len(b)) // CELLS).bit_length()))) for a, b in pairs]
    cells, todo = CELLS, list(range(len(pairs)))
    while todo:
        now, todo = [i for i in todo if need[i] <= cells], [i for i in todo if need[i] > cells]
        if now:
            row, keys, sign, done = peel(subtract(sketches([pairs[i][0] for i in now], cells), sketches([pairs[i][1] for i in now], cells)))
            order = np.argsort(row, kind="stable")
            row, keys, sign = row[order], keys[order], sign[order]
            edge = np.searchsorted(row, np.arange(len(now) + 1))
            for j, i in enumerate(now):
                k, s = keys[edge[j]: edge[j + 1]], sign[edge[j]: edge[j + 1]]
                out[i] = (k[s > 0], k[s < 0], cells)
            todo += [i for j, i in enumerate(now) if not done[j]]
        cells *= 2
    return out


def likeness(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[float]:
    found = []
    for (a, _), (only_a, only_b, _) in zip(pairs, differences(pairs), strict=True):
        either = len(a) + len(only_b)
        found.append((len(a) - len(only_a)) / either if either else 1.0)
    return found


def fingerprint(keys: np.ndarray) -> str:
    return f"{CELLS}:{len(keys)}:{base64.b64encode(sketch(keys).tobytes()).decode('ascii')}"


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of the next text."""
    m = len(text) // 3
    return text[: len(text) - m] + following[:m]


def edited_bytes(first: bytes, second: bytes) -> tuple[int, bytes]:
    """Code points of the first text, and its edited text."""
    text = first.decode("utf-8", "surrogatepass")
    return len(text), edited(text, second[: 4 * (len(text) // 3)].decode("utf-8", "ignore")).encode("utf-8", "surrogatepass")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_versions(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """SCHEMA for each document, against its edited text and the next document.

    Documents are dealt by key ranges, once. Each range also gets the first document of the next one, so a task
    streams its rows in order and holds two texts at a time.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("k"), utf8(text).alias("data"))
    count = rows.count()
    if not count:
        return spark.createDataFrame([], SCHEMA)
    wanted = int(min(MAX_BUCKETS, max(8 * width(spark), count // 4096), max(1, count // 16)))
    at = [i / wanted for i in range(1, wanted)]
    cuts = rows.agg(F.percentile_approx("k", at, 10 * MAX_BUCKETS)).first()[0] if at else []
    splits = [float("-inf"), *sorted({float(c) for c in cuts or []}), float("inf")]
    cut = Bucketizer(splits=splits, inputCol="x", outputCol="bucket", handleInvalid="keep") if len(splits) > 2 else None
    # descending ranges: the largest keys are range 0, null keys are the last
    last = len(splits) - 1
    numbered = rows.withColumn("x", F.col("k").cast("double"))
    numbered = cut.transform(numbered) if cut else numbered.withColumn("bucket", F.when(F.col("x").isNull(), 1.0).otherwise(0.0))
    numbered = numbered.select("k", "data", F.when(F.col("k").isNull(), last).otherwise(last - 1 - F.col("bucket")).cast("int").alias("bucket"))
    heads = {r[0]: (r[1], r[2]) for r in numbered.groupBy("bucket").agg(F.max("k"), F.count(F.lit(1))).collect()}  # one per range
    filled = sorted(heads)
    # the first row of each range is also the row after the range before it, and the first of all follows the last
    led = spark.createDataFrame([(heads[b][0], b, filled[i - 1], i == 0) for i, b in enumerate(filled)], "hk long, hb int, before int, wrap boolean")
    own = numbered.select("bucket", F.lit(0).alias("guest"), "k", "data")
    guests = numbered.join(F.broadcast(led), (F.col("bucket") == F.col("hb")) & F.col("k").eqNullSafe(F.col("hk")))  # at most MAX_BUCKETS + 1 rows
    guests = guests.select(F.col("before").alias("bucket"), F.lit(1).alias("guest"), "k", "data")
    dealt = own.unionByName(guests).repartition(width(spark), "bucket").sortWithinPartitions("bucket", "guest", F.desc_nulls_last("k"), "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row whose next is awaited
        out: list[tuple] = []
        pairs: list[tuple] = []
        weight = 0
        for b in batches:
            for bucket, guest, k, data in zip(*(b.column(c).to_pylist() for c in ("bucket", "guest", "k", "data")), strict=True):
                keys = digests(data)
                if held is not None and held[0] == bucket and not held[1]:
                    n, other = edited_bytes(held[3], data)
                    ours = digests(other)
                    out.append((held[2], n, hashlib.sha256(other).hexdigest(), fingerprint(held[4]), fingerprint(ours)))
                    pairs += [(held[4], ours), (held[4], keys)]
                    weight += 2 * len(held[4]) + len(ours) + len(keys)
                    if len(out) >= AT_ONCE or weight >= DIGESTS_AT_ONCE:
                        yield _batch(out, likeness(pairs))
                        out, pairs, weight = [], [], 0
                held = (bucket, guest, k, data, keys)
        yield _batch(out, likeness(pairs))

    return dealt.mapInArrow(run, SCHEMA)


def _batch(out: list[tuple], near: list[float]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}
    cols = [x.split() for x in SCHEMA.split(", ")]
    rows = [(*r, near[2 * i], near[2 * i + 1]) for i, r in enumerate(out)]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(cols)], names=[n for n, _ in cols])
