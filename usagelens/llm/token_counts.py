"""Token counts: how many tokens a byte-level BPE vocabulary makes of each text, without moving a pre-token.

Tokens never cross pre-tokens (the pieces the vocabulary's pattern cuts a text into), so a text's count is the sum of
its pieces' lengths. Lengths are looked up on the map side, in two tiers:

* a table of frequent pieces and their lengths, broadcast: at most TABLE_ROWS pieces of at most PIECE_BYTES bytes, so
  its size is bounded (4 MB). It is fitted on the texts of SAMPLE_IDS ids, by a frequent-items sketch;
* what the table lacks is encoded by the library once per worker and kept in the worker's cache (two generations of
  CACHE_ROWS pieces; pieces over PIECE_BYTES are encoded each time, so the cache is bounded in bytes too).

Table and caches decide the speed alone: counts are the library's with any table, also with none. Only (text) goes to
Python and only a number comes back; no row is shuffled. The vocabulary file is read once, by the driver, and sent.

Special strings inside a text are one token each, as is the library's default. Nothing is added or truncated.
Null and empty texts have no tokens. Long texts are counted whole. Repeated rows give repeated rows, an empty table
none; other columns are ignored by `token_counts` and kept by `with_token_counts`.
"""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
import uuid
from collections.abc import Callable

import pandas as pd
import public_tokenizers
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

VOCABULARY = "byte_bpe_50k.json"
SAMPLE_IDS, TABLE_ROWS, TRACKED, PIECE_BYTES, CACHE_ROWS = 2_000, 32_768, 131_072, 64, 300_000
LIMIT = 512
#: The vocabulary's pattern of pre-tokens (a fixed value), as Java and `regex` read it.
PIECES = r"'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Below this code point, classes of characters have been the same in every Unicode version since 5.1.
SETTLED = 0x250


def _class(kinds: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(SETTLED) if unicodedata.category(chr(c))[0] in kinds)


def settled_pieces() -> re.Pattern:
    """The same pattern for texts of characters below SETTLED, with the classes written out: these texts are cut by `re`."""
    letters, digits, space = _class("L"), _class("N"), "\\t-\\r \\x85\\xa0"
    return re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{letters}]+| ?[{digits}]+| ?[^{space}{letters}{digits}]+|[{space}]+(?![^{space}])|[{space}]+")


class Lengths(dict):
    """Piece to number of tokens: the broadcast table, and behind it the worker's cache."""

    def __init__(self, vocabulary: str, table: dict[str, int]) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__(table)
        library = Tokenizer.from_str(vocabulary)
        self.cut, self.tokens = library.pre_tokenizer.pre_tokenize_str, library.model.tokenize
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self.settled, self.other = settled_pieces(), re.compile(f"[^\\x00-{chr(SETTLED - 1)}]")
        special = [t["content"] for t in json.loads(vocabulary)["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None

    def encoded(self, piece: str) -> int:
        return sum(len(self.tokens(mapped)) for mapped, _ in self.cut(piece))

    def __missing__(self, piece: str) -> int:
        n = self.young.get(piece)
        if n is None:
            n = self.old.get(piece)
            if n is None:
                n = self.encoded(piece)
            if len(piece.encode()) <= PIECE_BYTES:
                if len(self.young) >= CACHE_ROWS:
                    self.young, self.old = {}, self.young
                self.young[piece] = n
        return n

    def pieces(self, text: str) -> list[str]:
        if self.other.search(text) is None:
            return self.settled.findall(text)
        return [text[a:b] for _, (a, b) in self.cut(text)]  # other scripts are cut by the library itself

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        parts = self.special.split(text) if self.special else [text]
        return len(parts) - 1 + sum(sum(map(self.__getitem__, self.pieces(p))) for p in parts if p)


_WORKER: dict[str, Lengths] = {}


def lengths_of(sent: Broadcast, name: str) -> Lengths:
    """The lengths of this worker process; a worker that goes on to another task keeps its cache."""
    if name not in _WORKER:
        _WORKER.clear()
        _WORKER[name] = Lengths(*sent.value)
    return _WORKER[name]


def read_vocabulary(path: str) -> str:
    """The file's contents, if it is a byte-level BPE with the pattern above and nothing before or behind it."""
    with open(path, encoding="utf-8") as f:
        found = f.read()
    said = json.loads(found)
    cut, model = said.get("pre_tokenizer") or {}, said["model"]
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
    added = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in said["added_tokens"])
    if not plain or not added or said.get("normalizer") or model.get("type") != "BPE" or model.get("dropout"):
        raise ValueError(f"{path} is not a plain byte-level BPE")
    return found


def frequent_pieces(docs: DataFrame, text: str = "text", key: str = "doc_id", ids: int = SAMPLE_IDS, rows: int = TABLE_ROWS) -> list[str]:
    """At most `rows` frequent pieces of the texts of the `ids` ids with the smallest hashes; the same on every run."""
    hashed = docs.select(F.col(key).alias("_id")).where("_id is not null").groupBy("_id").agg(F.count(F.lit(1)).alias("_n"))
    picked = cut_lineage(hashed.orderBy(F.xxhash64("_id"), "_id").limit(ids).select("_id"), "token-sample")
    texts = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text")).join(picked, F.col("_key") == F.col("_id"))
    pieces = texts.select(F.explode(F.regexp_extract_all("_text", F.lit(PIECES), F.lit(0))).alias("piece"))
    pieces = pieces.where(F.octet_length("piece").between(1, PIECE_BYTES))
    found = pieces.agg(F.expr(f"approx_top_k(piece, {rows}, {TRACKED})").alias("top")).first()["top"]
    return [r["item"] for r in found or []]


def lookup(docs: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id", table: list[str] | None = None) -> Broadcast:
    """What every task looks up: the vocabulary and the table of frequent pieces (None: those of `docs`)."""
    vocabulary = read_vocabulary(path or public_tokenizers.path(VOCABULARY))
    encoder = Lengths(vocabulary, {})
    wanted = frequent_pieces(docs, text, key) if table is None else table
    wanted = [p for p in wanted if len(p.encode()) <= PIECE_BYTES][:TABLE_ROWS]
    return docs.sparkSession.sparkContext.broadcast((vocabulary, {sys.intern(p): encoder.encoded(p) for p in wanted}))


def count_with(sent: Broadcast) -> Callable[[Column], Column]:
    """The count of a text column, with what `lookup` gave."""
    name = uuid.uuid4().hex

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        lengths = lengths_of(sent, name)
        return pd.Series([lengths.count(t) for t in texts], dtype="int64")

    return run


def with_token_counts(docs: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id", out: str = "n_tokens", table: list[str] | None = None) -> DataFrame:
    """All columns of `docs` and the count; a column so named is replaced. Rows stay where they are."""
    return docs.withColumn(out, count_with(lookup(docs, path, text, key, table))(F.col(text).cast("string")))


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT, text: str = "text", key: str = "doc_id", table: list[str] | None = None) -> DataFrame:
    """One row per document: key, n_bytes (UTF-8), n_tokens, over_limit (more than `limit` tokens)."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    counted = with_token_counts(rows, path, "text", "key", "n_tokens", table)
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return counted.select(F.col("key").alias(key), n_bytes.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
