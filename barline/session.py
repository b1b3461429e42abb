"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every operator relies on. Shuffle partition count is left to
# the cluster; AQE coalesces small partitions and splits skewed join partitions.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "Etc/UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session the caller owns."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    context = spark.sparkContext
    if context.master.startswith("local") and spark.conf.get("spark.sql.shuffle.partitions") == "200":
        # The default is far too many for one machine, above all for streaming state.
        spark.conf.set("spark.sql.shuffle.partitions", str(context.defaultParallelism))
    return spark


def build_session(master: str = "local[*]", app: str = "barline", **conf: str) -> SparkSession:
    """Local session for tests and the bench; clusters bring their own."""
    builder = SparkSession.builder.master(master).appName(app)
    defaults = {
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false",
        **RUNTIME_CONF,
        **conf,
    }
    for key, value in defaults.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_LOCAL_BASE: dict[str, str] = {}


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``.

    A cluster has to name that folder, since it must be visible to every
    executor. Only a local master may fall back to a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        if context.applicationId not in _LOCAL_BASE:
            _LOCAL_BASE[context.applicationId] = tempfile.mkdtemp(prefix="barline-")
        base = _LOCAL_BASE[context.applicationId]
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the working folder and read it back.

    For results that several later steps read: they are computed once, later scans
    prune columns, and a lost executor costs a re-read instead of a recomputation.
    """
    spark = df.sparkSession
    path = work_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
