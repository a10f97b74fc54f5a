"""Registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import class_lm, decontaminate, lexical, mixing, paragraph_sketch, repeats, sharding, simhash, source_audit, token_counts, toxicity, url_rules, warc
from .common import in_fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Base32 of a SHA-1: its hexadecimal digits as bits, five at a time.
WARC_SQL = r"""
WITH hashed AS (
  SELECT page_id, coalesce(html, '') AS payload, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS least,
    array_to_string(list_transform(string_split(sha1(coalesce(html, '')), ''), lambda d: lpad(bin(instr('0123456789abcdef', d) - 1), 4, '0')), '') AS bits
  FROM pages)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + list_sum(list_transform(range(5), lambda j: CASE WHEN substr(bits, 5 * i + j + 1, 1) = '1' THEN 16 >> j ELSE 0 END))::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id > least THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > least THEN least END AS refers_to
FROM hashed
"""


@query("op1_warc_salvage", WARC_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write(table(spark, sf_dir, "pages"))
    found, _ = warc.read(spark, path, payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


URL_SQL = r"""
WITH parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)\A.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)\A.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(rule, verdict, rule_host, rule_path) AS (VALUES ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'),
  ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')),
judged AS (
  SELECT page_id, host, path,
    (SELECT arg_max(struct_pack(rule := rule, verdict := verdict), length(rule)) FROM rules
     WHERE (p.host = rule_host OR ends_with(p.host, '.' || rule_host)) AND starts_with(p.path, rule_path)) AS best
  FROM parts p)
SELECT page_id, host, path, best.rule AS rule,
  coalesce(best.verdict, CASE WHEN contains(host || path, '/login/') OR contains(host || path, '/ads/') OR contains(host || path, '/cart/')
    OR contains(host || path, '/wp-admin/') OR regexp_matches(host || path, '(?s)/tag/.*/feed/') THEN 'block' ELSE 'allow' END) AS verdict
FROM judged
"""


@query("op2_url_rules", URL_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_rules.judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


LEAK_SQL = r"""
WITH docs AS (SELECT doc_id, w, len(w) - 4 AS shingles FROM (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents) WHERE len(w) >= 5),
items AS (SELECT item_id, w, len(w) - 4 AS n FROM (
  SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM benchmark) WHERE len(w) >= 5),
theirs AS (SELECT item_id, n, s, count(*) AS c FROM (
  SELECT item_id, n, array_to_string(w[i + 1:i + 5], ' ') AS s FROM (SELECT *, unnest(range(n)) AS i FROM items)) GROUP BY ALL),
ours AS (SELECT doc_id, shingles, i, array_to_string(w[i + 1:i + 5], ' ') AS s FROM (SELECT *, unnest(range(shingles)) AS i FROM docs)),
starts AS (SELECT DISTINCT o.doc_id, o.shingles, t.item_id, t.n, o.i FROM ours o JOIN theirs t ON o.s = t.s),
shared AS (
  SELECT a.doc_id, a.item_id, a.i, a.n, least(a.n, a.shingles - a.i) AS m, sum(least(a.c, t.c)) AS common FROM (
    SELECT st.doc_id, st.item_id, st.i, st.n, st.shingles, o.s, count(*) AS c FROM starts st
    JOIN ours o ON o.doc_id = st.doc_id AND o.i >= st.i AND o.i < st.i + st.n GROUP BY ALL) a
  JOIN theirs t ON t.item_id = a.item_id AND t.s = a.s GROUP BY ALL),
alike AS (SELECT *, common::DOUBLE / (n + m - common) AS similarity FROM shared)
SELECT doc_id, item_id, i AS word_start, m + 4 AS n_words, similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, i) AS place FROM alike WHERE similarity >= 0.8) WHERE place = 1
"""


@query("op3_benchmark_decontamination", LEAK_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op4_class_model")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score(table(spark, sf_dir, "documents"), in_fold(F.col("doc_id"), 7, 2))


MIX_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 9) AS BIGINT) AS h
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight
  FROM rows GROUP BY source),
leveled AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap,
         (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size * 2.0::DOUBLE) OVER (ORDER BY source_size * 2.0::DOUBLE / weight, source IS NULL, source
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) /
         sum(weight) OVER (ORDER BY source_size * 2.0::DOUBLE / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources),
plan AS (
  SELECT source, source_size, coalesce(least(cap, weight * (SELECT arg_min(level, cap / weight) FROM leveled WHERE cap / weight > level)), cap) AS target FROM leveled),
ties AS (SELECT source, h, sum(size) AS words FROM rows GROUP BY source, h),
summed AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY h) - words AS before FROM ties),
taken AS (
  SELECT t.source, t.h, p.source_size, p.target,
         CASE WHEN p.source_size > 0 THEN CAST(floor(p.target / p.source_size) AS BIGINT) ELSE 0 END AS whole, t.before, t.words
  FROM summed t JOIN plan p ON t.source IS NOT DISTINCT FROM p.source)
SELECT r.doc_id, r.size, k.source_size, k.target,
       r.size * (k.whole + CASE WHEN k.before + k.words <= k.target - k.whole * k.source_size
         OR (k.before <= k.target - k.whole * k.source_size AND (k.target - k.whole * k.source_size - k.before) * 2 >= k.words) THEN 1 ELSE 0 END) AS taken
FROM rows r JOIN taken k ON r.source IS NOT DISTINCT FROM k.source AND r.h = k.h
"""


@query("op5_mixing", MIX_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def _nibble_table() -> list[int]:
    """Remainders of the reflected CRC-32 polynomial (a fixed value) for four bits."""
    table = []
    for x in range(16):
        for _ in range(4):
            x = (x >> 1) ^ (0xEDB88320 if x & 1 else 0)
        table.append(x)
    return table


#: The published loop of jump hashing, with the multiplier modulo 2**64; a CRC-32 by half bytes. Slots follow the id.
SHARD_SQL = f"""
WITH RECURSIVE ids AS (SELECT DISTINCT coalesce(doc_id, 0) AS id FROM documents),
steps AS (
  SELECT id, shards, id::HUGEINT & 18446744073709551615::HUGEINT AS k, -1::BIGINT AS b, 0::BIGINT AS j FROM ids, (VALUES (40), (41)) t(shards)
  UNION ALL
  SELECT id, shards, next AS k, j AS b, floor((j + 1) * (2147483648.0::DOUBLE / ((next // 8589934592)::DOUBLE + 1.0)))::BIGINT AS j
  FROM (SELECT *, (k * 2862933555777941757::HUGEINT + 1) & 18446744073709551615::HUGEINT AS next FROM steps WHERE j < shards)),
placed AS (SELECT id, max(b) FILTER (WHERE shards = 40) AS shard, max(b) FILTER (WHERE shards = 41) AS grown_shard FROM steps GROUP BY id),
digits AS (SELECT doc_id, coalesce(text, '') AS text, string_split(hex(encode(coalesce(text, ''))), '') AS h FROM documents),
summed AS (
  SELECT doc_id, CAST(strlen(text) + 16 AS BIGINT) AS size,
    xor(list_reduce(list_transform(range(2 * strlen(text)), lambda i: (instr('0123456789ABCDEF', h[CASE WHEN i % 2 = 0 THEN i + 2 ELSE i END]) - 1)::BIGINT),
      lambda c, d: xor(c >> 4, {_nibble_table()}[(xor(c, d) & 15) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32
  FROM digits)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard
FROM summed JOIN placed ON placed.id = coalesce(doc_id, 0)
"""


@query("op6_sharding", SHARD_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.manifest(table(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query("op7_simhash_near_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents"), shingle=3, errors=2)
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


@query("op8_paragraph_sketch")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_sketch.compare_versions(table(spark, sf_dir, "documents"))


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), in_fold(F.col("doc_id"), 4, 2)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), learn_from=~held_out)
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


REPEAT_SQL = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
windows AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(n - 49)) AS p FROM docs WHERE n >= 50)),
repeated AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS least FROM windows) WHERE least < doc_id),
numbered AS (SELECT doc_id, p, sum(start) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM (
  SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS start FROM repeated)),
spans AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM numbered GROUP BY doc_id, g),
before AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM spans),
gone AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last FROM spans GROUP BY doc_id),
heads AS (SELECT doc_id, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS kept FROM before JOIN docs USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, d.n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM docs d LEFT JOIN gone USING (doc_id) LEFT JOIN heads USING (doc_id)
"""


@query("op10_repeated_strings", REPEAT_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


@query("op11_token_counts")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


RANK_SQL = r"""
WITH words AS (
  SELECT d, doc_id, unnest(w) AS term, len(w) AS n FROM (
    SELECT row_number() OVER () AS d, doc_id,
      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents)),
asked AS (SELECT DISTINCT i, item_id, unnest(w) AS term FROM (
  SELECT row_number() OVER () AS i, item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark)),
counts AS (SELECT count(DISTINCT d)::BIGINT AS n_docs, count(*)::BIGINT AS n_terms FROM words),
tfs AS (SELECT d, doc_id, n, term, count(*)::BIGINT AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weighed AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight FROM (SELECT term, count(*) AS df FROM tfs GROUP BY term), counts),
scored AS (SELECT a.i, a.item_id, t.d, t.doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked a JOIN tfs t ON a.term = t.term JOIN weighed w ON w.term = t.term, counts GROUP BY a.i, a.item_id, t.d, t.doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 50
"""


@query("op12_ranked_search", RANK_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


AUDIT_SQL = r"""
WITH docs AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS d,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
groups AS (SELECT DISTINCT lang, source FROM docs),
cells AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT d) AS docs FROM (SELECT lang, source, d, unnest(w) AS term FROM docs) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS total FROM cells GROUP BY lang, term HAVING sum(docs) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(total) AS n_lang FROM kept GROUP BY lang),
dense AS (SELECT g.lang, g.source, k.term, k.total, coalesce(c.n, 0) AS n FROM groups g JOIN kept k ON g.lang = k.lang
  LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sizes AS (SELECT lang, source, sum(n) AS n_group FROM dense GROUP BY lang, source),
shares AS (SELECT d.lang, d.source, d.term, d.n, 1 + (1000000000::HUGEINT * (d.n + 5)) // (s.n_group + 5 * l.v) AS p, 1 + (1000000000::HUGEINT * (d.total + 5)) // (l.n_lang + 5 * l.v) AS q
  FROM dense d JOIN sizes s ON d.lang = s.lang AND d.source = s.source JOIN langs l ON d.lang = l.lang),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(p.p - q.p)), 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN shares p ON p.lang = a.lang AND p.source = a.source LEFT JOIN shares q ON q.lang = b.lang AND q.source = b.source AND q.term = p.term GROUP BY ALL),
parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts) WHERE part = 'pair' OR rank <= 50
"""


@query("op13_source_audit", AUDIT_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(table(spark, sf_dir, "documents"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
