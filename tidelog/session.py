"""What jobs share on a session: the package on its workers, and folders that all executors see."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

#: Applications that have this package on their workers.
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives Python workers this package, wherever they and the driver were started."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp()  # the driver serves the file for as long as it runs
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.addPyFile(shutil.make_archive(f"{folder}/{root.name}", "zip", root.parent, root.name))
        _SHIPPED.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``. Only where that
    is unset (tests on one machine) it is a folder of this process's own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = os.path.join(tempfile.gettempdir(), f"tidelog-{os.getpid()}")
    if not os.path.isdir(folder):
        os.makedirs(folder)
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(context._jsc.hadoopConfiguration()), at


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A name for a new folder below the shared one; it goes when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    system, at = file_system(spark, path)
    system.mkdirs(at)
    system.deleteOnExit(at)
    return f"{path}/data"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes what has been read for the last time."""
    system, at = file_system(spark, path)
    system.delete(at, True)
