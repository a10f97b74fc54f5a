"""WARC archives: write pages with deduplicated payloads, and read archives back by salvage.

Writer. Each record is one gzip member. Pages with equal payloads give one response (that with the smallest key) and
revisits that refer to it. Files are written by Spark's text writer, whose line separator is the last byte of a
member (the high byte of its length: zero below 16 MiB; a longer record is closed by an empty member), so the files
are plain sequences of members, and large ones can be split.

Salvage reader. Files are cut into ranges of bytes, which tasks read whatever the file's name or compression suffix. A
task looks for openings in its range: the first bytes of a gzip member with any legal flags (name, extra field, comment,
header checksum), or the version line of a plain archive. An opening counts if what follows checks out, also past the
range: the member inflates to its checksum and end, version line and headers parse, the block has the stated length and
is closed by two line ends, the digest agrees. A member may hold several records. From the end of what is good the
search goes on; where nothing is good, at the next opening, so that later records are recovered. What lies inside a good
record (an archive in an archive) is no record of its own. Bytes that no good member or record covers are logged as gaps
with the reason; a member that inflates but of which some part is no record is a gap too, and keeps its good records.

A task holds one range and one record. Only (range, start, end) of what is good meets by file, so a file that is
damaged as a whole gathers nothing.

Nulls: a null payload is empty; a null key is written without number and read back as null (ordered last).
Repeated rows: all rows with the smallest key of a payload are responses. An empty table gives one empty file; empty files
give no rows. Long payloads are written and read whole.
"""

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, shared_path
from ..sources.growing import list_files, open_file
from .common import utf8

MAGIC, VERSION = b"\x1f\x8b\x08\x00", b"WARC/1."
EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"
LEVEL = 3
RECORD, GOOD, BAD = "record", "good", "bad"
#: Bytes of a range and what a task looks at beyond it; the longest head of a record; payload bytes held before they are sent.
RANGE_BYTES, OVERLAP, MOST_HEAD, HELD_BYTES = 16 << 20, 16, 1 << 20, 8 << 20
#: A member's magic, its method, and flags of which the upper three bits are reserved.
MEMBER_OPENING, PLAIN_OPENING = re.compile(rb"\x1f\x8b\x08[\x00-\x1f]"), re.compile(re.escape(VERSION))


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def record(key: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record. A revisit has no block, but tells digest and length of the payload it stands for."""
    one_line = lambda s: "".join(c if c not in "\r\n" else " " for c in s or "")
    block = b"" if revisit else payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if key is None else key}>",
        f"WARC-Target-URI: {one_line(url)}", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"X-Payload-Bytes: {len(payload)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    head += ["Content-Type: text/html", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member that ends with a zero byte."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    out = MAGIC + b"\x00\x00\x00\x00\x00\x03" + body + zlib.crc32(data).to_bytes(4, "little") + (len(data) & 0xFFFFFFFF).to_bytes(4, "little")
    return out if out[-1] == 0 else out + EMPTY_MEMBER


def parse(data: bytes, at: int = 0) -> tuple[dict | str, int]:
    """The record that begins at a place and the place behind it, or why there is none."""
    head_end = data.find(b"\r\n\r\n", at, at + MOST_HEAD)
    if not data.startswith(VERSION, at) or head_end < 0:
        return ("short" if data.startswith(VERSION, at) and len(data) < at + MOST_HEAD else "no version line or end of headers"), at
    fields: dict[str, str] = {}
    for line in data[at:head_end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return "header without colon", at
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    try:
        length = int(fields["content-length"])
    except (KeyError, ValueError):
        return "no content length", at
    begin, end = head_end + 4, head_end + 4 + length
    if length < 0 or len(data) < end + 4:
        return "short" if length >= 0 else "no content length", at
    if data[end: end + 4] != b"\r\n\r\n":
        return "length differs", at
    block, kind = data[begin:end], fields.get("warc-type", "")
    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind != "revisit" and stated and stated != digest(block):
        return "digest differs", at
    number = lambda name: int(x) if (x := fields.get(name, "").removeprefix("<urn:page:").rstrip(">")).lstrip("-").isdigit() else None
    size = fields.get("x-payload-bytes", "")
    return {
        "page_id": number("warc-record-id"), "url": fields.get("warc-target-uri"), "record_type": kind, "payload_digest": stated or digest(block),
        "payload_bytes": int(size) if size.isdigit() else length, "refers_to": number("warc-refers-to"), "payload": None if kind == "revisit" else block,
    }, end + 4


def inflate(feed: Iterator[bytes]) -> tuple[bytes | None, int | str]:
    """Contents of one gzip member and its length in bytes, or None and why not; reads no further than it has to."""
    one, out, fed = zlib.decompressobj(31), [], 0
    for block in feed:
        fed += len(block)
        try:
            out.append(one.decompress(block))
        except zlib.error:
            return None, "damaged member"
        if one.eof:
            return b"".join(out), fed - len(one.unused_data)
    return None, "member without end"


class Reader:
    """A file by places: a range that is held, and what lies behind it when asked for."""

    def __init__(self, path: str, start: int, stop: int, size: int) -> None:
        self.file, self.start, self.size = open_file(path), start, size
        self.held = self.file.read_at(min(stop - start + OVERLAP, size - start), start)

    def bytes(self, at: int, n: int) -> bytes:
        n = min(n, self.size - at)
        lo = at - self.start
        return self.held[lo: lo + n] if lo + n <= len(self.held) else self.file.read_at(n, at)

    def feed(self, at: int) -> Iterator[bytes]:
        step = 1 << 14
        while at < self.size:
            yield (block := self.bytes(at, step))
            at, step = at + len(block), min(step * 4, 1 << 20)

    def opening(self, at: int, stop: int, members: bool) -> int | None:
        """Place of the first opening in [at, stop)."""
        found = (MEMBER_OPENING if members else PLAIN_OPENING).search(self.held, at - self.start, min(stop - self.start + OVERLAP, len(self.held)))
        return None if found is None or found.start() + self.start >= stop else found.start() + self.start

    def good(self, at: int, members: bool) -> tuple[list[dict], int, str]:
        """(records, place behind, why): what begins at an opening. Nothing good gives back the opening's own place."""
        if members:
            plain, end = inflate(self.feed(at))
            if plain is None:
                return [], at, str(end)
            found, place, why = [], 0, ""
            while place < len(plain):
                got, behind = parse(plain, place)
                if isinstance(got, dict):
                    found.append(got)
                    place = behind
                else:
                    why = why or got
                    place = plain.find(VERSION, place + 1)
                    if place < 0:
                        break
            return found, at + int(end), why
        n = 1 << 16
        while True:  # a plain record is asked for in growing pieces, until its head tells its length
            data = self.bytes(at, n)
            got, behind = parse(data)
            if got != "short" or at + n >= self.size:
                return ([got], at + behind, "") if isinstance(got, dict) else ([], at, got)
            n *= 4


def write(pages: DataFrame, path: str | None = None, key: str = "page_id", url: str = "url", payload: str = "html") -> str:
    """Write the archives below `path` (unset: a new folder in the shared one) and return it."""
    spark = pages.sparkSession
    path = path or shared_path(spark, "warc")
    body = utf8(payload)
    ids = cut_lineage(pages.select(F.col(key).cast("long").alias("k"), F.sha1(body).alias("sha"), F.octet_length(body).alias("n")), "warc-digests")
    first = ids.groupBy("sha", "n").agg(F.min("k").alias("first"), F.min("k").isNotNull().alias("has"))
    # payloads stay where they are: only pages that revisit are listed
    again = ids.distinct().join(first, ["sha", "n"]).where(F.col("has") & (F.col("k").isNull() | (F.col("k") > F.col("first"))))
    again = cut_lineage(again.select("k", "sha", "first"), "warc-revisits")
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), body.alias("payload"), F.sha1(body).alias("s"))
    rows = rows.join(again, F.col("key").eqNullSafe(F.col("k")) & (F.col("s") == F.col("sha")), "left")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("key", "url", "payload", "first")]
            yield pa.RecordBatch.from_pydict({"value": pa.array([member(record(k, u, p, f, f is not None))[:-1] for k, u, p, f in zip(*cols, strict=True)], pa.binary())})

    packed = rows.select("key", "url", "payload", "first").mapInArrow(pack, "value binary")
    # the separator is the zero byte that every member ends with
    packed.select(F.col("value").cast("string")).write.option("lineSep", "\x00").text(path)
    return path


FIELDS = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"
FOUND = f"file string, range long, kind string, start long, end long, why string, {FIELDS}"
NAMES = [x.split()[0] for x in FIELDS.split(", ")]


def _found(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    parts = [x.split() for x in FOUND.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], kinds[k]) for c, k in parts], names=[c for c, _ in parts])


def search(ranges: DataFrame, members: bool, payloads: bool) -> DataFrame:
    """(file, start, stop, size) to FOUND: records, the extent of what is good, and the first failure of every run of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                reader, at, failing = Reader(r["file"], r["start"], r["stop"], r["size"]), r["start"], False
                place = {"file": r["file"], "range": r["start"]}
                out: list[dict] = []
                held = 0
                while at < r["stop"] and (start := reader.opening(at, r["stop"], members)) is not None:
                    records, end, why = reader.good(start, members)
                    for x in records:
                        held += len(x["payload"] or b"") if payloads else 0
                        out.append({**place, "kind": RECORD, "start": start, "end": end, **(x if payloads else {**x, "payload": None})})
                    if end > start and not why:
                        out.append({**place, "kind": GOOD, "start": start, "end": end})
                    elif not failing or end > start:
                        out.append({**place, "kind": BAD, "start": start, "end": end, "why": why})
                    failing = end == start
                    at = end if end > start else start + 1
                    if held > HELD_BYTES or len(out) > 2_000:
                        yield _found(out)
                        out, held = [], 0
                yield _found(out)

    return ranges.repartition("file", "start").select("file", "start", "stop", "size").mapInArrow(run, FOUND)


def read(spark: SparkSession, path: str, members: bool = True, payloads: bool = True, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(records, gaps): records have FIELDS; gaps have file, start, end (bytes) and reason."""
    files = list_files(spark, path, "*").select(F.col("path").alias("file"), "size")
    starts = F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))
    ranges = files.where("size > 0").select("file", "size", F.explode(starts).alias("start")).withColumn("stop", F.least(F.col("start") + range_bytes, "size"))
    ranges = cut_lineage(ranges, "warc-ranges")
    found = cut_lineage(search(ranges, members, payloads), "warc-found")

    # how far earlier ranges reach, and then earlier openings of the range: what begins before that is inside something good
    good = found.where(F.col("kind") == GOOD).select("file", "range", "start", "end")
    reach = good.groupBy("file", "range").agg(F.max("end").alias("reach"))
    ahead = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    reach = reach.withColumn("since", F.coalesce(F.max("reach").over(ahead), F.lit(0)))
    inside = Window.partitionBy("file", "range").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    placed = good.join(reach, ["file", "range"]).withColumn("since", F.greatest("since", F.coalesce(F.max("end").over(inside), F.lit(0))))
    placed = cut_lineage(placed.select("file", "start", "end", "since"), "warc-good")
    nested = placed.where("start < since").select("file", "start")
    spans = placed.where("start >= since")
    records = found.where(F.col("kind") == RECORD).join(nested, ["file", "start"], "left_anti").select(*NAMES)

    last = placed.groupBy("file").agg(F.max("end").alias("since"))
    tails = ranges.groupBy("file").agg(F.max("size").alias("start")).join(last, "file", "left").select("file", F.coalesce("since", F.lit(0)).alias("since"), "start")
    gaps = spans.select("file", "since", "start").unionByName(tails).where("since < start").select("file", F.col("since").alias("start"), F.col("start").alias("end"))
    # the reason of a gap is its first failure
    failed = found.where(F.col("kind") == BAD).select("file", F.col("start").alias("at"), "why")
    both = gaps.select("file", F.col("start").alias("at"), "start", "end", F.lit(None).cast("string").alias("why")).unionByName(failed, allowMissingColumns=True)
    along = Window.partitionBy("file").orderBy("at", F.col("start").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    known = both.withColumn("start", F.last("start", True).over(along)).withColumn("end", F.last("end", True).over(along)).where("at < end")
    return records, known.groupBy("file", "start", "end").agg(F.coalesce(F.min_by("why", F.when(F.col("why").isNotNull(), F.col("at"))), F.lit("no opening")).alias("reason"))
