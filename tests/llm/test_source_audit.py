"""The pointer sort and the audit against plain counting."""

import collections
import random
import re

import numpy as np
import pyarrow as pa

import __spark_entry__ as entry
from usagelens.llm import source_audit

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def test_pointers_sort_by_whole_words():
    """Words with equal first 8, 16 and more bytes, of exactly 8 bytes, and others; rows meet without a byte between."""
    rng = random.Random(13)
    stems = ["", "abcdefgh", "abcdefghabcdefgh", "abcdefghabcdefghabcdefghabcdefgh", "é" * 9, "z"]
    for _ in range(30):
        texts = ["".join(rng.choice((rng.choice(stems) + rng.choice("abAB"), " ", "9", "ABCDEFGH", "")) for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(1, 20))]
        group = np.array([rng.randrange(3) for _ in texts])
        column = pa.array([t.encode() for t in texts], pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[: len(texts) + 1]
        data = np.frombuffer(column.buffers()[2], np.uint8) if offsets[-1] else np.zeros(0, np.uint8)
        term, own, n, docs = source_audit.runs(data[: offsets[-1]], offsets, group)
        got = {(w, int(g)): (int(a), int(b)) for w, g, a, b in zip(term.to_pylist(), own, n, docs, strict=True)}
        assert len(got) == len(term)
        counts, seen = collections.Counter(), collections.Counter()
        for t, g in zip(texts, group, strict=True):
            words = terms(t)
            counts.update((w, int(g)) for w in words)
            seen.update((w, int(g)) for w in set(words))
        assert got == {k: (counts[k], seen[k]) for k in counts}


def plain(rows, least, top):
    """The report by definition."""
    langs = collections.defaultdict(lambda: collections.defaultdict(collections.Counter))
    docs = collections.Counter()
    for text, lang, source in rows:
        langs[lang or ""][source or ""].update(words := terms(text))
        docs.update((lang or "", w) for w in set(words))
    out = set()
    for lang, groups in langs.items():
        kept = [w for (x, w), k in docs.items() if x == lang and k >= least]
        share = lambda c: {w: 1 + 10**9 * (c[w] + 5) // (sum(c[t] for t in kept) + 5 * len(kept)) for w in kept}
        whole, each = share(sum(groups.values(), collections.Counter())), {s: share(c) for s, c in groups.items()}
        for s in groups:
            parts = [("pair", o, sum(abs(each[s][w] - each[o][w]) for w in kept)) for o in groups if o != s]
            parts += [("term", w, each[s][w] - whole[w]) for w in kept if groups[s][w] and each[s][w] > whole[w]]
            for part in ("pair", "term"):
                listed = sorted((x for x in parts if x[0] == part), key=lambda x: (-x[2], x[1].encode()))
                out |= {(lang, s, *x, k) for k, x in enumerate(listed, 1) if part == "pair" or k <= top}
    return out


def test_audit_by_definition(spark):
    """Nulls, empty texts, sources without terms, a language that keeps none, ties, repeated rows, a long text, other columns."""
    rng = random.Random(3)
    rows = [(" ".join(rng.choices(["alpha", "Beta", "gamma-ray", "Été", "x1y", "漢字"], k=rng.randint(0, 9))), rng.choice(["en", None]), rng.choice(["a", "b", "c", None])) for _ in range(120)]
    rows += [rows[0]] * 5 + [(None, "en", "empty"), ("", "fr", "alone"), ("solo", "de", "one"), ("duo", "de", "two"), ("alpha beta " * 200_000, "en", "long")]
    docs = spark.createDataFrame([(*r, "t", 1) for r in rows], "text string, lang string, source string, term string, n int").repartition(3)
    got = source_audit.audit(docs, least_docs=4, top=3)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert {tuple(r) for r in got.collect()} == plain(rows, 4, 3)
    assert source_audit.audit(docs.limit(0)).count() == 0


def test_shares_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    c, n, v = 10**13 + 7, 10**15 + 3, 12_345
    row = spark.range(1).select(source_audit.share(F.lit(c), F.lit(n), F.lit(v)).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (c + 5) // (n + 5 * v)


def test_whole_table(spark, sf):
    import duckdb

    rows = duckdb.sql(f"SELECT text, lang, source FROM '{sf}/documents.parquet'").fetchall()
    assert {tuple(r) for r in entry.queries()["op13_source_audit"](spark, sf).collect()} == plain(rows, 30, 50)
