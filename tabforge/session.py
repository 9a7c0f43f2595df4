"""Session helpers: defaults for new sessions and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "tabforge", **conf) -> SparkSession:
    """A session with adaptive execution and UTC times; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.scheduler.mode": "FAIR",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    # Workers of a local session are started by its JVM, which inherits this.
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        os.environ["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    session = builder.getOrCreate()
    if not session.sparkContext.master.startswith("local"):
        ship(session)
    return session


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, whose Python workers import functions from it by name."""
    package = os.path.dirname(os.path.abspath(__file__))
    with tempfile.TemporaryDirectory() as folder:
        name = os.path.basename(package)
        archive = shutil.make_archive(f"{folder}/{name}", "zip", os.path.dirname(package), name)
        spark.sparkContext.addPyFile(archive)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    A local session without the setting gets a temporary folder, which goes when the program ends; on a cluster the
    setting is required, since a folder of one machine is lost with that machine.
    """
    context = spark.sparkContext
    path = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the executors")
        path = tempfile.mkdtemp(prefix="tabforge-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    if not context.getCheckpointDir():
        context.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def scratch_done(context: SparkContext, path: str) -> None:
    """Deletes a scratch folder that nothing reads any more."""
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def spread(scan: DataFrame) -> DataFrame:
    """Spreads a table read from too few files or row groups over all cores.

    Large tables come in many splits and pass through unchanged.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def materialise(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives executor loss."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
