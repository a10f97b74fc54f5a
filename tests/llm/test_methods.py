"""Operators against brute force, exact round trips, SQL and held-out accuracy."""

import collections
import hashlib
import math
import random
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
from usagelens.llm import class_lm, decontaminate, mixing, paragraph_sketch, repeats, sharding, simhash, url_rules, warc

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def lower(text):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())


@pytest.fixture(scope="module")
def texts(sf):
    return duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet' ORDER BY doc_id").fetchall()


def result(spark, sf, name):
    return entry.queries()[name](spark, sf).collect()


@pytest.mark.parametrize("name", ["op1_warc_salvage", "op2_url_rules", "op3_benchmark_decontamination", "op5_mixing", "op6_sharding", "op10_repeated_strings"])
def test_equal_to_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    plain = lambda rows: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)
    assert plain(tuple(r[c] for c in columns) for r in result(spark, sf, name)) == plain(cur.fetchall())


# -- 1


def test_round_trip_of_pages(spark, sf):
    pages = duckdb.sql(f"SELECT page_id, html FROM '{sf}/pages.parquet'").fetchall()
    got = {r["page_id"]: r for r in result(spark, sf, "op1_warc_salvage")}
    assert len(got) == len(pages)
    for page_id, html in pages:
        r = got[page_id]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(html.encode()), warc.digest(html.encode()))
        assert r["record_type"] == "response" and r["refers_to"] is None


def damaged(path, folder, change):
    folder.mkdir()
    source = next(p for p in Path(path).iterdir() if p.name.startswith("part-"))
    data = bytearray(source.read_bytes())
    change(data)
    (folder / "archive").write_bytes(bytes(data))
    return str(folder), data


def test_salvage_of_damaged_members(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>{i}</p>" * 50) for i in range(20)], "page_id long, url string, html string").coalesce(1)
    path = warc.write(pages)
    starts = []

    def change(data):
        starts.extend(m.start() for m in re.finditer(re.escape(warc.MAGIC), bytes(data)))
        data[starts[5] + 40] ^= 0xFF  # inside the sixth member
        del data[starts[12] + 60: starts[13]]  # a cut member
        data[0:0] = b"noise before"

    folder, _ = damaged(path, tmp_path / "one", change)
    found, gaps = warc.read(spark, folder)
    assert sorted(r["page_id"] for r in found.collect()) == [i for i in range(20) if i not in (5, 12)]
    logged = sorted((r["start"], r["end"]) for r in gaps.collect())
    assert logged == [(0, 12), (12 + starts[5], 12 + starts[6]), (12 + starts[12], 12 + starts[12] + 60)]


def test_salvage_of_plain_archives(spark, tmp_path):
    """Version lines: a body with a version line is put together again, a broken header is skipped."""
    bodies = [b"one", b"two WARC/1.1 inside\r\n\r\nWARC/1.", b"", b"four" * 100]
    raw = [warc.record(i, "u", b, None, False) for i, b in enumerate(bodies)]
    raw[2] = raw[2].replace(b"Content-Length: 0", b"Content-Length: x")
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "a.warc").write_bytes(b"".join(raw))
    found, gaps = warc.read(spark, str(tmp_path / "plain"), members=False)
    assert {r["page_id"]: bytes(r["payload"]) for r in found.collect()} == {i: bodies[i] for i in (0, 1, 3)}
    (gap,) = gaps.collect()
    assert (gap["start"], gap["end"]) == (len(raw[0]) + len(raw[1]), len(raw[0]) + len(raw[1]) + len(raw[2])) and gap["reason"] == "no content length"


def test_large_records_close_with_a_zero():
    data = np.random.default_rng(0).bytes(17 << 20)
    packed = warc.member(data)
    assert packed[-1] == 0 and warc.inflate(iter([packed]))[0] == data


# -- 2


def test_rules_are_filed_by_tokens_of_all_they_fit():
    rng = random.Random(2)
    for verdict, kind, text in url_rules.RULES:
        pattern, tokens = re.compile(url_rules.compiled(kind, text).replace("\\A", "^")), url_rules.literal_tokens(kind, text)
        for _ in range(3000):
            parts = rng.choices(["net", "example", "com", "de", "org", "fr", "en", "login", "ads", "tag", "feed", ".", "/", "x", "-"], k=8) + [text.replace("*", "q")]
            rng.shuffle(parts)
            address = "".join(parts)
            if pattern.search(address):
                assert set(tokens) <= set(re.split("[^a-z0-9]+", address))


# -- 3


def test_leaks_against_brute_force(spark, sf, texts):
    items = duckdb.sql(f"SELECT item_id, text FROM '{sf}/benchmark.parquet'").fetchall()
    grams = lambda w: collections.Counter(tuple(w[i: i + 5]) for i in range(len(w) - 4))
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t.lower())
    known = [(i, len(split(t)), grams(split(t))) for i, t in items]
    want = {}
    for doc_id, text in texts:
        w = split(text or "")
        every = [tuple(w[i: i + 5]) for i in range(len(w) - 4)]
        for item, n, g in known:
            hits = [p for p, s in enumerate(every) if s in g]
            for p in hits:
                mine = collections.Counter(every[p: p + n - 4])
                common = sum((mine & g).values())
                alike = common / (sum(mine.values()) + sum(g.values()) - common)
                if alike >= 0.8 and alike > want.get((doc_id, item), (0,))[0]:
                    want[doc_id, item] = (alike, p)
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["word_start"]) for r in result(spark, sf, "op3_benchmark_decontamination")}
    assert want and {k: pytest.approx(v[0]) for k, v in want.items()} == {k: v[0] for k, v in got.items()}
    assert {k: v[1] for k, v in want.items()} == {k: v[1] for k, v in got.items()}


# -- 4


def test_class_model(spark, sf, texts):
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    tokens = {d: [*WORDS.findall(lower(t)), b"\0end"] for d, t in texts}
    counts = collections.Counter(w for d, ws in tokens.items() if not held(d) for w in ws)
    n, v = sum(counts.values()), len(counts)
    rows = result(spark, sf, "op4_class_model")
    assert len(rows) == len(texts)
    for r in rows:
        ws = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"]), len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws))
    assert sum(r["score"] for r in rows if r["held_out"]) > sum(r["base_score"] for r in rows if r["held_out"])


def test_exchange_move_is_the_gain_in_likelihood():
    rng = np.random.default_rng(4)
    units, k = 12, 4
    pairs = rng.integers(0, 20, (units, units)).astype(float)
    of = rng.integers(0, k, units)
    table = lambda of: np.array([[pairs[of == a][:, of == b].sum() for b in range(k)] for a in range(k)])
    f = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0).sum()
    likelihood = lambda of: f(table(of)) - f(table(of).sum(1)) - f(table(of).sum(0))
    for u in range(units):
        other = np.arange(units) != u
        after, before = np.bincount(of[other], pairs[u, other], k), np.bincount(of[other], pairs[other, u], k)
        best = class_lm.best_class(after, before, pairs[u, u], of[u], table(of), k)
        scores = [likelihood(np.where(np.arange(units) == u, g, of)) for g in range(k)]
        assert scores[best] == pytest.approx(max(scores))


def test_model_is_a_distribution():
    found = class_lm.Classes(np.array([0, 1, 2, 0]), np.array([[3.0, 1, 0], [2, 0, 5], [1, 1, 1]]))
    trans, emit = class_lm.score_tables(found, np.array([4.0, 7, 3, 2]), np.array([2.0, 3, 1, 1]))
    assert (10**trans).sum(1) == pytest.approx(1)
    # a class's counts plus one for each word, and one for a new word
    assert (6 + 3 + 1) * 10 ** emit[0] == pytest.approx(1)


# -- 5 and 6


def test_mix(spark, sf):
    rows = result(spark, sf, "op5_mixing")
    by = collections.defaultdict(lambda: [0, 0, 0.0, 0])
    docs = {r[0]: r[1] for r in duckdb.sql(f"SELECT doc_id, source FROM '{sf}/documents.parquet'").fetchall()}
    for r in rows:
        assert r["taken"] <= 2 * r["size"]
        one = by[docs[r["doc_id"]]]
        one[0], one[1], one[2], one[3] = one[0] + r["taken"], r["source_size"], r["target"], max(one[3], r["size"])
    assert sum(x[2] for x in by.values()) == pytest.approx(1.5 * sum(x[1] for x in by.values()))
    for taken, size, target, largest in by.values():
        assert abs(taken - target) <= largest and target <= 2 * size
    assert sorted((r["doc_id"], r["taken"]) for r in rows) == sorted((r["doc_id"], r["taken"]) for r in result(spark, sf, "op5_mixing"))


def test_mix_goes_through_repeats(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect() if r["copies"]}
    assert collections.Counter(r["doc_id"] for r in mixing.materialize(docs).collect()) == copies


def test_shards(spark, sf, texts):
    rows = result(spark, sf, "op6_sharding")
    slots = collections.defaultdict(list)
    known = dict(texts)
    for r in rows:
        data = (known[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 16, zlib.crc32(data))
        assert r["grown_shard"] in (r["shard"], 40)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(rows) == len(texts)


def test_jump_against_the_published_loop():
    def plain(key, shards):
        b, j = -1, 0
        while j < shards:
            b = j
            key = (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
        return b

    keys = np.array([0, 1, 2, -1, 2**63 - 1, -(2**63), *range(1000, 1400)], np.int64)
    for shards in (1, 2, 40, 1000):
        assert sharding.jump(keys, shards).tolist() == [plain(int(k) % 2**64, shards) for k in keys]
    moved = (sharding.jump(np.arange(100_000), 40) != sharding.jump(np.arange(100_000), 41)).mean()
    assert moved == pytest.approx(1 / 41, rel=0.1)


# -- 7


def test_simhash_groups(spark, sf, texts):
    def fingerprint(text):
        w = WORDS.findall(lower(text))
        runs = [b" ".join(w[i: i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        hashes = [xxhash.xxh64_intdigest(x, 42) for x in runs]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = {d: fingerprint(t) for d, t in texts}
    up = {d: d for d in prints}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                up[y] = x
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in result(spark, sf, "op7_simhash_near_dedup")}
    assert got == {d: (f"{p:016x}", root(d)) for d, p in prints.items()}


def test_trie_join_of_clusters(spark):
    rng = random.Random(7)
    values = []
    for _ in range(120):
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 8)):
            values.append(base)
            base ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
    a = np.unique(np.array(values, np.uint64))
    near = np.bitwise_count(a[:, None] ^ a[None, :])
    for errors in (0, 1, 2, 3, 4):
        want = simhash.Forest(len(a))
        want.link(*np.nonzero(near <= errors))
        found = simhash.links(spark.createDataFrame([(int(x),) for x in a.astype(np.int64)], "fp long"), errors).collect()
        at = {int(x): i for i, x in enumerate(a.astype(np.int64))}
        got = simhash.Forest(len(a))
        got.link(np.array([at[r["a"]] for r in found], np.int64), np.array([at[r["b"]] for r in found], np.int64))
        assert (got.up == want.up).all()


# -- 8


def test_sketches(spark, sf, texts):
    rows = {r["doc_id"]: r for r in result(spark, sf, "op8_paragraph_sketch")}
    order = sorted(texts, reverse=True)
    alike = lambda a, b: (lambda x, y: sum((x & y).values()) / sum((x | y).values()) if x or y else 1.0)(*(collections.Counter(paragraph_sketch.paragraphs(t.encode())) for t in (a, b)))
    for i, (doc_id, text) in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        other = text[: len(text) - len(text) // 3] + following[: len(text) // 3]
        r = rows[doc_id]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(other.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(alike(text, other)) and r["near_next"] == pytest.approx(alike(text, following))
    assert len({(r["fingerprint"], t) for t, r in ((t, rows[d]) for d, t in texts)}) == len({t for _, t in texts})


def test_difference_is_exact_at_any_size():
    rng = np.random.default_rng(8)
    for n in (0, 1, 5, 40, 3000):
        a = rng.integers(0, 2**63, n + 10).astype(np.uint64)
        b = np.concatenate([a[n // 2:], rng.integers(0, 2**63, n).astype(np.uint64)])
        ((only_a, only_b, cells),) = paragraph_sketch.differences([(a, b)])
        assert set(only_a) == set(a) - set(b) and set(only_b) == set(b) - set(a)
        assert n < 30 or cells > paragraph_sketch.CELLS


# -- 9


def test_toxicity_on_rows_not_learnt_from(spark, sf):
    larger = sf.replace("0.001", "0.1")
    labels = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{larger}/labels.parquet'").fetchall())
    rows = [r for r in result(spark, larger, "op9_toxicity") if r["held_out"] and r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    toxic, clean = ([r["predicted"] for r in rows if labels[r["doc_id"]] == y] for y in (1, 0))
    assert np.mean(toxic) > 0.9 and np.mean(clean) < 0.01


# -- 10


def test_repeats_against_brute_force(spark, sf, texts):
    first = {}
    for doc_id, text in texts:
        data = (text or "").encode()
        for p in range(len(data) - 49):
            first.setdefault(data[p: p + 50], doc_id)
    got = {r["doc_id"]: r for r in result(spark, sf, "op10_repeated_strings")}
    for doc_id, text in texts:
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, int)
        for p in range(len(data) - 49):
            if first[data[p: p + 50]] < doc_id:
                gone[p] += 1
                gone[p + 50] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        r = got[doc_id]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())


def test_maximal_repeats_have_all_places():
    rng = random.Random(10)
    shared = [bytes(rng.choices(b"abc ", k=60)) for _ in range(3)]
    texts = [(bytes(rng.choices(b"abc ", k=5)) + rng.choice(shared) + bytes(rng.choices(b"abc ", k=5)))[: repeats.STRETCH] for _ in range(12)]
    groups = repeats.repeat_groups(texts, np.arange(12))
    assert groups
    for n, least, places in groups:
        strings = {texts[i][at: at + n] for i, at in places}
        assert len(strings) == 1 and least == min(i for i, _ in places)
        (s,) = strings
        every = [(i, at) for i, t in enumerate(texts) for at in range(len(t) - n + 1) if t[at: at + n] == s]
        assert sorted(places) == every
        lefts = {texts[i][at - 1: at] if at else (i,) for i, at in places}
        rights = {texts[i][at + n: at + n + 1] or (i,) for i, at in places}
        assert len(lefts) > 1 and len(rights) > 1


def test_no_cross_joins_and_no_python_in_native_queries(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for df in (mixing.mix(docs), decontaminate.find_leaks(docs, spark.read.parquet(f"{sf}/benchmark.parquet"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Cartesian|NestedLoop|Python|Pandas|Arrow", plan)
    assert docs.select(F.count("*")).first()[0] == 200


def test_archives_are_read_in_splits(spark, tmp_path):
    """Members that cross the edges of splits, damage and bodies with the opening bytes, all in one file."""
    rng = random.Random(1)
    bodies = [("".join(rng.choices("abcdefghij", k=rng.randint(0, 9000))) + ("\x1f" if i % 7 == 0 else "")) for i in range(300)]
    pages = spark.createDataFrame([(i, f"http://x/{i}", b) for i, b in enumerate(bodies)], "page_id long, url string, html string").coalesce(1)
    marks = []

    def change(data):
        marks.extend(m.start() for m in re.finditer(re.escape(warc.MAGIC), bytes(data)))
        data[marks[150] + 30: marks[150] + 34] = warc.MAGIC  # an opening inside a damaged member

    folder, _ = damaged(warc.write(pages), tmp_path / "split", change)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30k")
    try:
        found, gaps = warc.read(spark, folder)
        got = {r["page_id"]: bytes(r["payload"]).decode() for r in found.collect()}
        (gap,) = gaps.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {i: b for i, b in enumerate(bodies) if i != 150}
    assert (gap["start"], gap["end"]) == (marks[150], marks[151])
