"""Files that grow: read only the complete lines that were appended since the last run.

A cursor table keeps, for each file, its size and time at the last run and the offset behind its last complete line.
A run lists the files and compares them with the cursor:

* unchanged (same size and time, nothing left behind the offset): not read;
* grown: the bytes from the offset on are read;
* shrunk: the file was replaced; it is read from 0 again, as a new generation;
* gone or empty: its lines stay, and its cursor too, so that a file that comes back whole is not read twice;
* half a last line: stays behind the offset, and is read by the run that finds its end.

The bytes to read are cut into ranges of RANGE_BYTES and dealt out, so that one large file is read by many tasks; a line
belongs to the range in which it starts. A run writes its lines, then its cursor; the cursor is the commit. A run
that dies before it leaves lines of an uncommitted batch, which the next run replaces, and no reader sees.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .transcripts import describe_path

RANGE_BYTES = 32 << 20
READ_BYTES = 1 << 20
CURSOR = "path string, size long, modified timestamp, offset long, generation int"
LINES = "path string, generation int, line_no long, line string, end long"


def list_files(spark: SparkSession, root: str, glob: str = "*.jsonl") -> DataFrame:
    """(path, size, modified) of the files below `root`; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def plan_ranges(files: DataFrame, cursor: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, size, modified, generation, begin, start, stop): the byte ranges that a run has to read.

    `begin` is where the file's unread part starts. Unchanged files have no range.
    """
    known = cursor.select(F.col("path").alias("_path"), F.col("size").alias("_size"), F.col("modified").alias("_modified"), "offset", "generation")
    both = files.join(known, F.col("path") == F.col("_path"), "left")
    shrunk = F.coalesce(F.col("size") < F.col("_size"), F.lit(False))
    both = both.withColumn("begin", F.when(shrunk, 0).otherwise(F.coalesce("offset", F.lit(0))).cast("long"))
    both = both.withColumn("generation", (F.coalesce("generation", F.lit(0)) + shrunk.cast("int")).cast("int"))
    same = F.coalesce((F.col("size") == F.col("offset")) & (F.col("modified") == F.col("_modified")), F.lit(False))
    fresh = both.where(~same & (F.col("size") > F.col("begin")))
    starts = F.sequence("begin", F.col("size") - 1, F.lit(range_bytes).cast("long"))
    return fresh.select("path", "size", "modified", "generation", "begin", F.explode(starts).alias("start")).withColumn(
        "stop", F.least(F.col("start") + range_bytes, "size"))


def open_file(path: str) -> pa.NativeFile:
    """Open a path as Spark lists it (not percent-encoded): of the local file system, or of a store that Arrow reads."""
    scheme, host, name = re.fullmatch(r"(?:([a-z][a-z0-9+.-]*):)?(?://([^/]*))?(/.*)", path, re.DOTALL).groups()
    if scheme in (None, "file"):
        return fs.LocalFileSystem().open_input_file(name)
    store, base = fs.FileSystem.from_uri(f"{'s3' if scheme == 's3a' else scheme}://{host or ''}/")
    return store.open_input_file(base.rstrip("/") + name)


def complete_lines(path: str, begin: int, start: int, stop: int, size: int, read_bytes: int = READ_BYTES) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that start in [start, stop) and end before `size`; `begin` is known to start a line."""
    with open_file(path) as f:
        at = start if start == begin else start - 1  # the byte before tells whether a line starts at `start`
        f.seek(at)
        held, skip = b"", start != begin
        while True:
            block = f.read(min(read_bytes, size - at - len(held)))
            held += block
            lines = held.split(b"\n")
            held = lines.pop()
            for line in lines:
                if not skip:
                    if at >= stop:
                        return
                    yield at, line
                skip = False
                at += len(line) + 1
            if not block or at >= stop and not skip:
                return


def read_ranges(ranges: DataFrame) -> DataFrame:
    """LINES of the ranges: `line_no` is the offset of the line's first byte, `end` the offset behind its line end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                rows: list[tuple] = []
                held = 0
                for at, line in complete_lines(r["path"], r["begin"], r["start"], r["stop"], r["size"]):
                    rows.append((r["path"], r["generation"], at, line.decode("utf-8", "replace"), at + len(line) + 1))
                    held += len(line)
                    if held > 8 * READ_BYTES or len(rows) >= 10_000:
                        yield _batch(rows)
                        rows, held = [], 0
                yield _batch(rows)

    # ranges are of one size, so rows are dealt evenly whatever the files' sizes
    dealt = ranges.repartition(F.col("path"), F.col("start"))
    return dealt.select("path", "generation", "begin", "start", "stop", "size").mapInArrow(run, LINES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64()]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "generation", "line_no", "line", "end"])


class Ingest:
    """Lines of growing files, run by run. `state` holds cursors and lines, one folder per committed batch."""

    def __init__(self, spark: SparkSession, root: str, state: str, glob: str = "*.jsonl", range_bytes: int = RANGE_BYTES) -> None:
        self.spark, self.root, self.state, self.glob, self.range_bytes = spark, root, state.rstrip("/"), glob, range_bytes

    def committed(self) -> int:
        """Number of the last committed batch, 0 before the first."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.state}/cursor")
        store = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not store.exists(path):
            return 0
        done = [f.getPath() for f in store.listStatus(path) if store.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
        return max((int(p.getName().split("=")[1]) for p in done), default=0)

    def cursor(self, batch: int | None = None) -> DataFrame:
        batch = self.committed() if batch is None else batch
        if not batch:
            return self.spark.createDataFrame([], CURSOR)
        return self.spark.read.schema(CURSOR).parquet(f"{self.state}/cursor/batch={batch}")

    def run(self) -> int:
        """Read what is new and commit it; returns the number of the batch."""
        before = self.committed()
        batch, cursor = before + 1, self.cursor(before)
        files = cut_lineage(list_files(self.spark, self.root, self.glob), "growing-files")  # one listing for lines and cursor
        ranges = cut_lineage(plan_ranges(files, cursor, self.range_bytes), "growing-ranges")
        lines = f"{self.state}/lines/batch={batch}"
        read_ranges(ranges).write.mode("overwrite").parquet(lines)
        ends = self.spark.read.schema(LINES).parquet(lines).groupBy("path").agg(F.max("end").alias("end"))
        read = ranges.groupBy("path").agg(F.first("begin").alias("begin"), F.first("generation").alias("generation_read")).join(ends, "path", "left")
        known = cursor.select("path", F.col("offset").alias("offset_before"), F.col("generation").alias("generation_before"))
        now = files.join(read, "path", "left").join(known, "path", "left").select(
            "path", "size", "modified", F.coalesce("end", "begin", "offset_before", F.lit(0).cast("long")).alias("offset"),
            F.coalesce("generation_read", "generation_before", F.lit(0)).cast("int").alias("generation"))
        gone = cursor.join(files.select("path"), "path", "left_anti")
        now.unionByName(gone).write.mode("overwrite").parquet(f"{self.state}/cursor/batch={batch}")
        return batch

    def lines(self) -> DataFrame:
        """All committed lines with path columns; of a replaced file those of its last generation."""
        last = self.committed()
        if not last:
            return describe_path(self.spark.createDataFrame([], LINES).drop("end").withColumnRenamed("path", "file_path"))
        everything = self.spark.read.option("basePath", f"{self.state}/lines").schema(f"{LINES}, batch int").parquet(f"{self.state}/lines")
        latest = self.cursor(last).select(F.col("path").alias("_path"), F.col("generation").alias("_generation"))
        kept = everything.where((F.col("batch") <= last) & (F.col("line") != "")).join(latest, (F.col("path") == F.col("_path")) & (F.col("generation") == F.col("_generation")), "left_semi")
        return describe_path(kept.select(F.col("path").alias("file_path"), "generation", "batch", "line_no", "line"))
