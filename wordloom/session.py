"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Defaults that hold at any scale; sizes (shuffle partitions, memory) stay with the deployment.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with ``DEFAULTS``; keyword arguments replace dots by double underscores."""
    builder = SparkSession.builder.appName("wordloom")
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` materialised in the cluster's shared checkpoint folder, its lineage cut.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Where none is set, a session
    on one machine (tests) gets a temporary one; on a cluster that is an error.
    """
    _shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """As ``checkpointed``, for tables that are read several times: written by column to the same folder.

    The files are deleted when the application ends.
    """
    spark = df.sparkSession
    path = f"{_shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def _shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, set if it is not yet."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="wordloom-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, so that they need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_wordloom_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="wordloom-package-"), "wordloom.zip")
    with zipfile.ZipFile(archive, "w") as target:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    target.write(path, os.path.join("wordloom", os.path.relpath(path, root)))
    context.addPyFile(archive)
    context._wordloom_shipped = True
