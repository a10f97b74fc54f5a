"""Ranked search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from usagelens.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, top):
    """Ranks by definition: (item, rank, key, score)."""
    held = [(k, Counter(terms(t))) for k, t in docs]
    n_docs, n_all = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    out = []
    for item, text in items:
        scored = []
        for k, c in held:
            n = sum(c.values())
            m = 50 + (50 * n * n_docs) // n_all if n_all else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 20 * m)) for w in set(terms(text)) if c[w])
            if score > 0:
                scored.append((-score, (k is not None, k if k is not None else 0), k))
        out += [(item, i, k, -s) for i, (s, _, k) in enumerate(sorted(scored, key=lambda x: x[:2])[:top], 1)]
    return sorted(out, key=str)


def corpus(seed, n, words=60):
    """Zipf-like words, copies and near copies, so that scores tie."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)] + ["Été", "漢字", "X9"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    texts = [" ".join(rng.choices(vocabulary, weights, k=rng.randint(0, 40))) for _ in range(n)]
    texts += [texts[3]] * 20 + [f"{texts[5]} extra", texts[5].upper()] * 10
    rng.shuffle(texts)
    return list(enumerate(texts)), [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 12)))) for i in range(15)]


@pytest.mark.parametrize("shard_docs,block_docs,block_terms", [(4096, 256, 4096), (40, 4, 4096), (100, 8, 10)])
def test_ranks_by_definition(spark, monkeypatch, shard_docs, block_docs, block_terms):
    monkeypatch.setattr(lexical, "SHARD_DOCS", shard_docs)
    monkeypatch.setattr(lexical, "BLOCK_DOCS", block_docs)
    docs, items = corpus(shard_docs, 300)
    got = lexical.rank_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), top=7, block_terms=block_terms)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, items, 7)


def test_edges(spark):
    """Null, empty and long texts, null and repeated keys and rows, equal items, items without a document, clashing names."""
    long = "tail " * 100_000 + "alpha"
    docs = [(1, "alpha beta"), (1, "alpha beta"), (None, "alpha beta"), (2, None), (3, ""), (4, "..."), (5, long), (6, "ALPHA gamma"), (-1, "beta")]
    items = [(1, "alpha"), (2, "Alpha, beta!"), (2, "gamma"), (None, "alpha"), (3, None), (4, ""), (5, "nowhere"), (1, "alpha")]
    d = spark.createDataFrame([(*x, 1, "r") for x in docs], "doc_id long, text string, rank int, shard string")
    i = spark.createDataFrame([(*x, 1, 2) for x in items], "item_id int, text string, doc_id int, i int")
    got = lexical.rank_documents(d, i, top=4)
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, items, 4)
    assert lexical.rank_documents(d.limit(0), i).count() == 0 and lexical.rank_documents(d, i.limit(0)).count() == 0


def shard_of(docs, number):
    rows = [(k, [number[w] for w in c], list(c.values())) for k, c in docs]
    return pa.table({"shard": pa.array([0] * len(rows), pa.int32()), "place": pa.array(range(len(rows)), pa.int32()), "key": pa.array([r[0] for r in rows], pa.int64()),
                     "terms": pa.array([r[1] for r in rows], pa.list_(pa.int32())), "impacts": pa.array([r[2] for r in rows], pa.list_(pa.int64()))})


def test_blocks_are_skipped_only_below_the_threshold():
    """Bounds hold for every document of a block; topics make blocks that need not be opened."""
    rng = random.Random(4)
    number = {f"t{k}w{j}": 10 * k + j for k in range(8) for j in range(10)} | {"the": 80}
    docs = [(i, Counter(["the", *rng.choices([f"t{i % 8}w{j}" for j in range(10)], k=12)])) for i in range(800)]
    table, weight = shard_of(docs, number), np.array([100] * 80 + [1], np.int64)
    shard, rows, by_term = lexical.Shard(table), [], {}
    points = np.zeros((800, 8), np.float32)
    points[np.arange(800), np.arange(800) % 8] = 1
    for i, (_, c) in enumerate(docs):
        for w in c:
            by_term.setdefault(number[w], []).append(i)
    for t, members in sorted(by_term.items()):
        for block in lexical.clustered(np.array(members), points, 50):
            top = np.zeros(81, np.int64)
            at, _ = shard.entries(block)
            np.maximum.at(top, shard.terms[at], shard.impacts[at])
            dims = np.flatnonzero(top)
            rows.append((t, block.tolist(), dims.tolist(), top[dims].tolist()))
    assert sorted(d for t, b, _, _ in rows if t == 80 for d in b) == list(range(800))
    kinds = [pa.int32(), *[pa.list_(pa.int32())] * 3]
    blocks = lexical.Blocks(pa.table([pa.array([r[k] for r in rows], kinds[k]) for k in range(4)], names=["term", "docs", "dims", "tops"]), 81)
    skipped = 0
    for k in range(8):
        item = [number[f"t{k}w0"], number[f"t{k}w1"], 80]
        scores = np.array([sum(weight[number[w]] * n for w, n in c.items() if number[w] in item) for _, c in docs])
        bound = blocks.bounds(item, weight)
        for t in item:
            assert all(bound[b] >= scores[blocks.docs[b]].max() for b in blocks.lists[t])
        got, value, left = lexical.best(shard, blocks, item, weight, 10)
        want = np.lexsort((np.arange(800), -scores))[:10]
        assert got.tolist() == want.tolist() and value.tolist() == scores[want].tolist()
        skipped += left
    assert skipped > 0
