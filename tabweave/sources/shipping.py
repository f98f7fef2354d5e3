"""Sending this package to the executors' Python workers; the folder that driver and executors share."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path
from uuid import uuid4

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    name = f"{tempfile.mkdtemp(prefix='tabweave-ship-')}/{package.name}"
    spark.sparkContext.addPyFile(shutil.make_archive(name, "zip", package.parent, package.name))
    _shipped.add(app)


def scratch(spark: SparkSession) -> str:
    """A folder that driver and executors share, for written files that are read back."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file:{tempfile.gettempdir()}/tabweave"
    path = f"{base.rstrip('/')}/{uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path
