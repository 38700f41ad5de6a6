"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Every setting here is one a cluster operator may override; none is required
# for correctness except the UTC session time zone.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # Recording the Python call site of every column costs more than planning does.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


ARCHIVE = "lumenlog-package.zip"


def build_session(master: str | None = None, app: str = "lumenlog", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULT_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _own_folder(prefix: str) -> str:
    """A temporary folder of this process, removed when it ends."""
    folder = tempfile.mkdtemp(prefix=prefix)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per Spark application.

    Functions that run in Python workers are pickled by reference, so the workers must be able to import them.
    """
    sc = spark.sparkContext
    if any(name.endswith(ARCHIVE) for name in sc.listFiles):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(_own_folder("lumenlog-ship-"), ARCHIVE)
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(package)))
    sc.addPyFile(path)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset and
    the master is local (a test session) is a temporary folder made and written
    back, so later calls in the same session agree. A cluster without the setting
    is refused: a folder of one machine would silently hold a part of the rows.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = _own_folder("lumenlog-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below :func:`shared_dir`."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


def materialize(df, label: str):
    """Write ``df`` to the shared folder and read it back.

    Used where one expensive result feeds several later reads: the written
    table survives the loss of executors and cuts the lineage.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
