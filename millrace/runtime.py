"""Session-level services that every job needs: sessions, shared storage and code shipping."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent


def session(app_name: str = "millrace", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators are written for; conf keys use __ for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from spark.checkpoint.dir.

    Only where that setting is absent and all tasks run in this process (tests, a laptop) is a local temporary folder
    used instead; on a cluster its absence is an error. Reliable checkpoints are directed to the same place.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("on a cluster, spark.checkpoint.dir must name a folder that all machines share")
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        folder = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(folder)
    elif not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder. It is the session's until `clean` or `discard` deletes it."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made(spark).add(path)
    return path


def _made(spark: SparkSession) -> set[str]:
    sc = spark.sparkContext
    if not hasattr(sc, "_millrace_scratch"):
        sc._millrace_scratch = set()
    return sc._millrace_scratch


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes scratch that no result reads any more."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        _made(spark).discard(path)


class Scratch:
    """Tables that one job stores for its own use, deleted together when the job needs them no more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def store(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        """df written as Parquet to the shared folder, and read from there."""
        self.paths.append(scratch_path(self.spark, name))
        df.write.option("compression", compression).parquet(self.paths[-1])
        return self.spark.read.parquet(self.paths[-1])

    def discard(self) -> None:
        discard(self.spark, *self.paths)
        self.paths = []


def clean(spark: SparkSession) -> None:
    """Deletes all scratch and checkpoints of this session: call it once no result of an operator is read any more."""
    discard(spark, *_made(spark))
    folder = spark.sparkContext._jsc.sc().getCheckpointDir()
    if folder.isDefined():  # the folder that Spark made for this application inside the shared one
        place = spark._jvm.org.apache.hadoop.fs.Path(folder.get())
        system = place.getFileSystem(spark._jsc.hadoopConfiguration())
        for child in system.listStatus(place):
            if child.getPath().getName().startswith("rdd-"):
                system.delete(child.getPath(), True)


def cut(df: DataFrame) -> DataFrame:
    """Compute df once into replicated storage and go on from the stored rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_millrace_shipped", False):
        return
    folder = Path(tempfile.mkdtemp(prefix="millrace-code-"))
    target = folder / "millrace_code.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(_PACKAGE.rglob("*.py")):
            archive.write(source, os.path.join(_PACKAGE.name, source.relative_to(_PACKAGE)))
    sc.addPyFile(str(target))
    sc._millrace_shipped = True
