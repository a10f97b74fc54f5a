"""Report tables: saving summaries, the baseline pointer, and loading several reports for a merge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REPORT_FAMILIES = {"baseline": "usage", "compare": "usage", "activity": "activity"}


class NoBaselineError(LookupError):
    """There is no saved baseline to compare against."""


class MergeInputError(ValueError):
    """The reports cannot be merged with each other."""


def report_id(prefix: str, at: Column) -> Column:
    """An id from a UTC time, such as `baseline-20240131T235959123Z`."""
    return F.concat(F.lit(f"{prefix}-"), F.date_format(at, "yyyyMMdd'T'HHmmssSSS'Z'"))


def save_report(tables: dict[str, DataFrame], root: str, report: str, mode: str, generated_at: str,
                file_format: str = "parquet", window_start: str | None = None, window_end: str | None = None,
                window_mode: str | None = None, baseline: str | None = None, sources: Sequence[str] = ()) -> None:
    """Write every table of a report below `root/<table>/report_id=<id>`, then its row in the `reports` index.

    Each partition is overwritten as a whole, so a repeated or retried save gives the same result; the index
    row comes last, so a report is only listed once it is complete. It also says which window and which sources the
    report is of, and the baseline that a comparison was made against.
    """
    for name, df in tables.items():
        df.write.mode("overwrite").format(file_format).save(f"{root}/{name}/report_id={report}")
    spark = next(iter(tables.values())).sparkSession
    index = spark.range(1).select(
        F.lit(mode).alias("mode"), F.lit(REPORT_FAMILIES[mode]).alias("family"),
        F.to_timestamp(F.lit(generated_at)).alias("generated_at"),
        F.to_timestamp(F.lit(window_start)).alias("window_start"), F.to_timestamp(F.lit(window_end)).alias("window_end"),
        F.lit(window_mode).cast("string").alias("window_mode"), F.lit(baseline).cast("string").alias("baseline"),
        F.array(*[F.lit(x) for x in sources]).cast("array<string>").alias("sources"),
    )
    index.write.mode("overwrite").parquet(f"{root}/reports/report_id={report}")


def load_table(spark: SparkSession, root: str, name: str, reports: Sequence[str] | None = None,
               file_format: str = "parquet") -> DataFrame:
    """One table of the saved reports; `reports` prunes to those partitions."""
    df = spark.read.option("basePath", f"{root}/{name}").format(file_format).load(f"{root}/{name}")
    return df if reports is None else df.filter(F.col("report_id").isin(*reports))


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether anything is stored below `path`; a table that cannot be read is another matter."""
    try:
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").limit(1)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def latest_baseline(spark: SparkSession, root: str) -> str:
    """Id of the last explicit baseline. Comparing never moves it."""
    if not _exists(spark, f"{root}/reports"):
        raise NoBaselineError("no baseline found: save one first")
    index = load_table(spark, root, "reports")
    row = index.filter(F.col("mode") == "baseline").agg(F.max_by("report_id", "generated_at").alias("id")).first()
    if row is None or row["id"] is None:
        raise NoBaselineError("no baseline found: save one first")
    return row["id"]


def check_mergeable(spark: SparkSession, root: str, reports: Sequence[str]) -> str:
    """The common family of the reports; an error for fewer than two, unknown ids or mixed families."""
    if len(reports) < 2:
        raise MergeInputError(f"a merge needs at least 2 reports, got {len(reports)}")
    index = load_table(spark, root, "reports", reports)
    row = index.agg(
        F.countDistinct("report_id").alias("found"), F.countDistinct("family").alias("families"),
        F.max("family").alias("family"),
    ).first()
    if row["found"] < len(set(reports)):
        raise MergeInputError("some of the reports do not exist")
    if row["families"] > 1:
        raise MergeInputError("reports of different families cannot be merged")
    return row["family"]
