"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

Features are counts of UTF-8 byte n-grams (A-Z lower-cased), hashed to 2**BITS cells and divided by their number
in the text plus SHORT. Each cell is scaled by r = log((a + toxic count)/(all toxic counts)) - log(same of the clean texts);
a logistic regression is fitted on the scaled features. Both factors fold into one weight per cell, so scoring is
one gather and one sum per n-gram and order, over whole texts, whatever their length.

Null and empty texts have no feature and get the score of the intercept. Rows with null label or null id are not
learnt from. Repeated rows count as often as they occur. Extra columns of the inputs are ignored.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import LOWER_ASCII, utf8

ORDERS = (3, 4, 5)
BITS = 18
#: Most labelled rows the fit takes; above that, those with the smallest hash of their id.
SAMPLE_ROWS = 8_000
#: Cells with a weight: those that part the classes best in the sample.
KEPT_CELLS = 1 << 12
#: Added to the number of n-grams.
SHORT = 200


@dataclass
class Model:
    """One weight per cell and an intercept: (2**BITS + 1) numbers, whatever the input."""

    weights: np.ndarray
    intercept: float


def cells(data: bytes) -> list[np.ndarray]:
    """Cell of each n-gram, one array per order."""
    b = np.frombuffer(data.translate(LOWER_ASCII), dtype=np.uint8).astype(np.uint32)
    out, h = [], None
    for n in range(1, max(ORDERS) + 1):
        if len(b) < n:
            out += [np.zeros(0, np.uint32)] * (n in ORDERS)
            continue
        h = b * np.uint32(0x9E3779B1) if n == 1 else (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + b[n - 1:]
        if n in ORDERS:
            out.append(((h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS))
    return out


def counted(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells of a text and their counts over its n-grams (SHORT more, so that a few n-grams say little)."""
    found = np.concatenate(cells(data))
    at, n = np.unique(found, return_counts=True)
    return at.astype(np.int32), (n / (SHORT + len(found))).astype(np.float32)


def fit_rows(texts: list[bytes], labels: np.ndarray, smooth: float = 1e-6, l2: float = 1e-4, rounds: int = 200, weight: float = 2.0, times: np.ndarray | None = None) -> Model:
    """Fit on texts in memory (at most SAMPLE_ROWS), each there `times` times; toxic rows count `weight` times as much."""
    size = 1 << BITS
    times = np.ones(len(texts)) if times is None else times
    rows = times.sum()
    if not len(texts) or labels.min() == labels.max():
        share = float((labels * times).sum() / rows) if len(texts) else 0.0
        return Model(np.zeros(size, np.float32), float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    # cells whose share of texts differs most between the classes, in standard errors
    seen = np.zeros((2, size))
    for t, y, k in zip(texts, labels, times, strict=True):
        seen[int(y), counted(t)[0]] += k
    n_c, n_t = ((1 - labels) * times).sum(), (labels * times).sum()
    both = seen.sum(0) / rows
    apart = np.abs(seen[1] / n_t - seen[0] / n_c) / np.sqrt(np.maximum(both * (1 - both), 0.5 / rows) * (1 / n_t + 1 / n_c))
    kept = apart >= np.sort(apart)[-KEPT_CELLS]
    parts = []
    for t in texts:
        at, x = counted(t)
        use = kept[at]
        parts.append((at[use], x[use]))
    at, x = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    row = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p[0]) for p in parts])
    toxic = labels[row] == 1
    p = np.bincount(at[toxic], (x * times[row])[toxic], size) + smooth * n_t
    q = np.bincount(at[~toxic], (x * times[row])[~toxic], size) + smooth * n_c
    r = np.where(kept, np.log(p / p.sum()) - np.log(q / q.sum()), 0.0)
    z = (x * r[at]).astype(np.float32)
    norm = np.sqrt((np.bincount(row, z.astype(np.float64) ** 2, len(parts)) * times).sum() / rows) or 1.0
    z /= norm
    each = np.where(labels == 1, weight, 1.0) * times
    each /= each.sum()
    # full-batch gradient descent with adaptive steps (Adam)
    w, b = np.zeros(size), float(np.log(n_t / n_c))
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for k in range(1, rounds + 1):
        y = 1 / (1 + np.exp(-np.clip(np.bincount(row, z * w[at], len(parts)) + b, -30, 30)))
        e = (y - labels) * each
        g = np.bincount(at, z * e[row], size) + l2 * w
        gb = float(e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        step = 0.5 / (1 + k / 100)
        w -= step * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        b -= step * (mb / (1 - 0.9**k)) / (np.sqrt(vb / (1 - 0.999**k)) + 1e-8)
    return Model((w * r / norm).astype(np.float32), b)


def score_texts(texts: list[bytes], model: Model) -> np.ndarray:
    out = np.empty(len(texts))
    for i, t in enumerate(texts):
        found = cells(t)
        n = sum(map(len, found))
        total = sum(float(model.weights[f].sum(dtype=np.float64)) for f in found)
        out[i] = 1 / (1 + np.exp(-np.clip(total / (SHORT + n) + model.intercept, -30, 30)))
    return out


def sample(documents: DataFrame, labels: DataFrame, label: str = "toxic", learn_from=None, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id, label, data, times) of at most `rows` labelled documents, the same on every run: the smallest hashes of the ids.

    Equal rows are one with their number; of ids with several texts, the smallest hashes of id and text fill up to `rows`.
    `learn_from` is a condition on doc_id; ids labelled both ways count by their larger label.
    """
    known = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    if learn_from is not None:
        known = known.where(learn_from)
    ids = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    ids = cut_lineage(ids, "toxicity-sample")  # at most `rows` pairs of numbers, of a size the optimizer sees
    picked = documents.select(F.col("doc_id").alias("id"), utf8("text").alias("data")).join(ids, F.col("id") == F.col("doc_id"))
    picked = picked.groupBy("id", "label", "data").agg(F.count(F.lit(1)).alias("times"))
    return picked.orderBy(F.xxhash64("id", "data"), "id", "data").limit(rows)


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", learn_from=None, rows: int = SAMPLE_ROWS) -> Model:
    """Fit in one task on the bounded sample; what comes back is the model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((i, y, t, n) for x in batches for i, y, t, n in zip(*(x.column(c).to_pylist() for c in ("id", "label", "data", "times")), strict=True))
        model = fit_rows([x[2] for x in got], np.array([x[1] for x in got], dtype=float), times=np.array([x[3] for x in got], dtype=float))
        yield pa.RecordBatch.from_pydict({"weights": [model.weights.tobytes()], "intercept": [model.intercept]})

    found = sample(documents, labels, label, learn_from, rows).repartition(1).mapInArrow(run, "weights binary, intercept double").collect()
    if not found:
        return fit_rows([], np.zeros(0))
    return Model(np.frombuffer(bytes(found[0]["weights"]), np.float32), found[0]["intercept"])


def score(documents: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """All columns of `documents` and the score, 0 to 1."""
    sent = documents.sparkSession.sparkContext.broadcast(model)  # of a fixed size

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(score_texts(list(texts), sent.value))

    return documents.withColumn(out, scored(utf8(text)))
