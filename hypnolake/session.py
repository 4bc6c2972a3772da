"""Session defaults. A cluster's own settings win: only unset keys are filled in."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, app: str = "hypnolake", **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_fallback: list[str] = []
_written: list[str] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder the cluster names in ``spark.checkpoint.dir``; one local machine may do without (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _fallback:
        _fallback.append(tempfile.mkdtemp(prefix="hypnolake-ckpt-"))
        atexit.register(shutil.rmtree, _fallback[0], ignore_errors=True)
    return _fallback[0]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a reused intermediate once to the shared folder and read it back.

    The plan is truncated, the rows survive executor loss, and file sizes let the planner
    pick join strategies for what follows. ``drop_written`` removes the folders once results are saved.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/hypnolake-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession) -> None:
    """Delete what ``cut_lineage`` wrote in this process; frames built on it cannot be read afterwards."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)
