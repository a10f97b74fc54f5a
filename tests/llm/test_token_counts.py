"""Token counts against the library itself, with a table, without one and with caches that overflow."""

import random

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
from usagelens.llm import token_counts

PATH = public_tokenizers.path(token_counts.VOCABULARY)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def by_library(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


def test_whole_table(spark, sf, library):
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall())
    got = entry.queries()["op11_token_counts"](spark, sf)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    rows = got.collect()
    assert len(rows) == len(texts) and any(r["over_limit"] for r in rows) and not all(r["over_limit"] for r in rows)
    for r in rows:
        n = by_library(library, texts[r["doc_id"]])
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 512)


@pytest.mark.parametrize("cache", [3, 100_000])
def test_pieces_of_any_script(library, monkeypatch, cache):
    """Contractions, white space of every kind, special strings, other scripts; a cache that overflows changes nothing."""
    monkeypatch.setattr(token_counts, "CACHE_ROWS", cache)
    lengths = token_counts.Lengths(token_counts.read_vocabulary(PATH), {" the": 1, "'s": 1})
    rng = random.Random(11)
    near = [*"ab'stm drve lLZ09.,!?\n\t\r\x0b\x1c\x1f\x85\xa0ñé²½ßªº_-", "<|endoftext|>", "<|end", " the", "  "]
    far = [*near, "漢", "\U0001f600", "’", "　", "​", "ſ", "Ω", "́", "٣", "ⅷ", " ", "᠎"]
    for k in range(6000):
        text = "".join(rng.choices((near, far)[k % 2], k=rng.randint(0, 30)))
        assert lengths.count(text) == by_library(library, text), text


def test_table_decides_nothing_but_speed(spark, library):
    long = "word " * 40_000 + "x" * 100_000
    texts = [(1, "The cat's hat, isn't it?"), (1, "The cat's hat, isn't it?"), (2, None), (3, ""), (None, "no id <|endoftext|>"), (4, long), (5, "漢字 text"), (None, None)]
    docs = spark.createDataFrame([(*t, "k", 7) for t in texts], "doc_id long, text string, key string, n_tokens int")
    want = sorted((str(i), len((t or "").encode()), by_library(library, t)) for i, t in texts)
    for table in (None, [], ["The", " cat", "'s", "not a piece", "y" * 100]):
        got = token_counts.token_counts(docs, table=table).collect()
        assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got) == want
    kept = token_counts.with_token_counts(docs, table=[])
    assert kept.columns == docs.columns and kept.schema["n_tokens"].dataType.simpleString() == "bigint"
    assert token_counts.token_counts(docs.limit(0)).count() == 0


def test_table_is_bounded_and_repeatable(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one, two = (token_counts.frequent_pieces(docs, ids=50, rows=100) for _ in range(2))
    assert one == two and 0 < len(one) <= 100 and " the" in one


def test_no_shuffle_of_pieces(spark, sf):
    plan = entry.queries()["op11_token_counts"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ArrowEvalPython" in plan


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        token_counts.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
