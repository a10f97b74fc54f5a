"""Each operator and each stage on empty tables, nulls, empty and long texts, repeated rows and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from usagelens.llm import class_lm, decontaminate, mixing, paragraph_sketch, repeats, sharding, simhash, toxicity, url_rules, warc

LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(60_000))
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, key string, data string, t string, fp long, h long, size string, bucket int, label string, words string"
OTHERS = (0.5, 3, "k", "d", "t", 1, 2, "s", 4, "l", "w")
ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog. It was a fine day for all of them indeed.", "en", "a", 1),
    (1, "The quick brown fox jumps over the lazy dog. It was a fine day for all of them indeed.", "en", "a", 1),
    (2, "The quick brown fox jumps over the lazy dog. It was a fine day for all of them indeed.", "en", None, 1),
    (None, "The quick brown fox jumps over the lazy dog. It was a fine day for all of them indeed.", None, None, None),
    (3, None, "en", "b", 0), (4, "", "en", "b", 0), (5, " \n\t ", "en", "b", 0), (6, "one", "en", "a", 3), (6, "another text of the same key", "en", "a", 3),
    (7, LONG, "en", "c", 0), (8, LONG + " tail", "en", "c", 0), (9, f"before it {ITEM} after it", "en", "a", 1), (10, "ünï çödé 漢字 \U0001f600 " * 20, "fr", "b", 1), (None, None, None, None, None),
    (11, "you idiot scum trash moron idiot scum", "en", "a", 1), (-5, "negative keys are keys", "en", "é", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, *OTHERS) for r in ROWS], DOCS)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, ITEM, "x"), (2, None, "x"), (3, "", "x"), (4, "tiny", "x"), (None, ITEM, "x"), (5, ITEM, "x")], "item_id long, text string, t string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(11, 1, 1), (1, 0, 0), (2, 0, 0), (None, 1, 0), (7, None, 1), (11, 0, 0), (6, 0, 1)], "doc_id long, toxic int, quality int")


def empty(df):
    return df.where(F.lit(False))


RUNS = {
    "3": lambda d, b, y: decontaminate.find_leaks(d, b),
    "4": lambda d, b, y: class_lm.score(d, F.lit(False), classes=4),
    "5": lambda d, b, y: mixing.mix(d),
    "6": lambda d, b, y: sharding.manifest(d, 7),
    "7": lambda d, b, y: simhash.groups(d),
    "8": lambda d, b, y: paragraph_sketch.compare_versions(d),
    "9": lambda d, b, y: toxicity.score(d, toxicity.fit(d, y)),
    "10": lambda d, b, y: repeats.remove_repeats(d),
}


@pytest.mark.parametrize("op", RUNS)
def test_empty_tables(spark, docs, bench, labels, op):
    assert RUNS[op](empty(docs), bench, labels).count() == 0
    RUNS[op](docs, empty(bench), empty(labels)).count()


@pytest.mark.parametrize("op", [x for x in RUNS if x != "3"])
def test_one_row_for_each(docs, bench, labels, op):
    found = RUNS[op](docs, bench, labels).collect()
    count = lambda rows: sorted(str(r["doc_id"]) for r in rows)
    assert count(found) == count(docs.collect())


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, docs, bench, labels, tmp_path, name, stage):
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    out = stage(spark, docs, str(tmp_path))
    if name != "sharding":
        assert out.schema.simpleString() == docs.schema.simpleString()
    kept = [r["doc_id"] for r in out.collect()]
    if name == "benchmark_decontamination":
        assert 9 not in kept and len(kept) == len(ROWS) - 1
    if name == "simhash_near_dedup":  # one of each group: the four foxes, the four without words, the two long ones
        assert sorted(kept, key=str) == sorted([1, 3, 6, 6, 7, 9, 10, 11, -5], key=str)
    assert stage(spark, empty(docs), str(tmp_path)).count() == 0


def test_values(docs, bench, labels):
    leaks = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find_leaks(docs, bench).collect()}
    assert set(leaks) == {(9, 1), (9, None), (9, 5)} and leaks[9, 1]["word_start"] == 2 and leaks[9, 1]["similarity"] == 1.0
    grouped = {(r["doc_id"], r["fp"]): r["component_id"] for r in simhash.groups(docs).collect()}
    assert {v for (k, f), v in grouped.items() if f == 0} == {3}
    assert {v for (k, _), v in grouped.items() if k in (1, 2)} == {1} and grouped[8, next(f for k, f in grouped if k == 8)] == 7
    removed = {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in repeats.remove_repeats(docs).collect()}
    assert removed[1, 86] == 0 and removed[2, 86] == 86 and removed[None, 86] == 0 and removed[8, len(LONG) + 5] >= len(LONG)
    cut = {(r["doc_id"], r["n_chars"]): r for r in paragraph_sketch.compare_versions(docs).collect()}
    assert cut[3, 0]["near_edited"] == 1.0 and len({r["fingerprint"] for (k, n), r in cut.items() if n == 86}) == 1


def test_pages(spark):
    schema = "page_id long, url string, html string, host string, verdict int, payload string, k long"
    pages = spark.createDataFrame([(1, "http://a.net/x", "<p>x</p>", "h", 1, "p", 1), (1, "http://a.net/x", "<p>x</p>", "h", 1, "p", 1), (2, None, None, None, None, None, None), (3, "no scheme", "", "", 0, "", 0),
                                   (None, "HTTP://B.EXAMPLE.NET/en/?q#f", "<p>x</p>", "", 0, "", 0), (4, "ftp://x.org/fr/é\r\nWARC-Type: x", "é\x1f\x00WARC/1.1\r\n\r\n" * 9000, "", 0, "", 0)], schema)
    found, gaps = warc.read(spark, warc.write(pages))
    rows = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in found.collect()), key=str)
    assert rows == sorted([(1, "response", None, 8), (1, "response", None, 8), (None, "revisit", 1, 8), (2, "response", None, 0), (3, "revisit", 2, 0), (4, "response", None, 16 * 9000)], key=str)
    assert gaps.count() == 0
    found, gaps = warc.read(spark, warc.write(empty(pages)))
    assert found.count() == 0 and gaps.count() == 0
    judged = {(r["page_id"], r["host"], r["path"]): (r["rule"], r["verdict"]) for r in url_rules.judge(pages).collect()}
    assert judged == {(1, "a.net", "/x"): ("net/", "block"), (2, "", ""): (None, "allow"), (3, "", ""): (None, "allow"), (None, "b.example.net", "/en/"): ("example.net/en/", "allow"),
                      (4, "x.org", "/fr/é\r\nWARC-Type: x"): ("org/fr/", "allow")}
    assert url_rules.judge(empty(pages)).count() == 0 and url_rules.judge(pages, rules=[]).where("verdict = 'allow'").count() == 6
