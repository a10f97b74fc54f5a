"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Bytes that part words: space and 0x09 to 0x0D. `bytes.split()` parts at the same ones.
WORD = r"[^\x20\x09-\x0D]+"
LOWER_ASCII = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_of(data: bytes | None) -> list[bytes]:
    """Words of UTF-8 text with A-Z lower-cased; null and empty text have none."""
    return data.translate(LOWER_ASCII).split() if data else []


def utf8(c: str | Column) -> Column:
    """UTF-8 bytes of a text column; null becomes empty."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")).cast("binary")


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32(doc_id as text) mod `folds` is `fold`; a null id is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def width(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session sets them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
