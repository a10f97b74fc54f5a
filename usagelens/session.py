"""Session set-up and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_LOCAL_DIRS: dict[str, str] = {}  # application id -> folder, for local sessions without the setting


def build_session(app_name: str = "usagelens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on: UTC, AQE and skew-join handling.

    Shuffle width is left to the cluster: AQE coalesces from the configured number, so a large cluster
    sets `spark.sql.shuffle.partitions` high and small inputs still end up with few tasks.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.variant.allowDuplicateKeys": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster in `spark.checkpoint.dir`.

    Where the setting is absent the session must be a local one (tests), and a fresh temporary folder
    is used. On a cluster a machine-local folder would lose data with its executor, so that is refused.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY, None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a shared folder before using operators that cut lineage")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="usagelens-")
    return _LOCAL_DIRS[app]


def run_dir(spark: SparkSession) -> str:
    """The folder of this application below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/usagelens-{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, label: str) -> str:
    """A new, unused path in this application's folder."""
    return f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"


def remove_run(spark: SparkSession) -> None:
    """Remove what this application wrote to cut lineage. Call it when its results are stored elsewhere."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame, label: str = "step") -> DataFrame:
    """Write `df` to the shared folder and read it back, so later rounds do not recompute it.

    A written table rather than an RDD checkpoint: it stays columnar, carries exact sizes into the
    optimizer (so joins against it can be chosen by size) and survives the loss of any executor.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
