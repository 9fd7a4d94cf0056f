"""Session settings and the shared folder for intermediate tables."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}


def build_session(app_name="verdictflow", **settings) -> SparkSession:
    """A session with the settings the jobs are written for (UTC, AQE, skew join)."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors reach: `spark.checkpoint.dir`, or a temp folder in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="verdictflow-")
    return _local_dirs[app]


def run_dir(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder; never one that exists already."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/verdictflow-{app}/{label}-{uuid.uuid4().hex}"


def remove_staged(spark: SparkSession):
    """Remove what this application staged; for the end of a job, when no frame reads it any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/verdictflow-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once as Parquet and read it back.

    For a frame used several times: it cuts the lineage, survives the loss of
    executors, and lets each reader prune columns and push its filters down.
    """
    path = run_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def even_out(df: DataFrame, limit_bytes: int = 1 << 30) -> DataFrame:
    """Spread a small input over all cores before CPU-heavy work on its text.

    A large scan already has more splits than cores and is returned unchanged.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    if size > limit_bytes:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)
