"""Session for local runs; on a cluster the submitter's settings win."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "quadlens") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("QUADLENS_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; a temporary one only where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            return current
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="quadlens-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one run below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/quadlens-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, drop: Iterable[DataFrame | None] = ()) -> DataFrame:
    """Write an intermediate table to shared storage and read it back.

    Later steps then neither repeat the work nor depend on the executors that did it, and the planner knows its size.
    ``drop``: tables of earlier calls that nothing reads once this one is written; their folders are deleted then.
    """
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._work_folder = path
    for old in drop:
        discard(old)
    return out


def discard(table: DataFrame | None) -> None:
    """Delete the folder of a table that ``cut`` wrote. Anything else is left alone."""
    path = getattr(table, "_work_folder", None)
    if path:
        spark = table.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
