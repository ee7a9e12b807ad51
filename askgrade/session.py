"""Where intermediate tables go, and how lineage is cut.

Intermediate results that must outlive an executor are written to the shared
folder that the cluster names in ``spark.checkpoint.dir``.  Only a local session
without that setting (tests, benchmarks on one machine) gets a folder of its own.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def work_dir(spark: SparkSession) -> str:
    """Shared folder for written intermediates."""
    conf = spark.sparkContext.getConf()
    configured = conf.get(_SETTING) or spark.conf.get(_SETTING, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_SETTING} to a folder that all executors share")
    spark.conf.set(_SETTING, tempfile.mkdtemp(prefix="askgrade-"))
    return spark.conf.get(_SETTING)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; never reused, so nothing is overwritten."""
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    Used where several jobs read the same derived rows (folds, grid points):
    the files survive the loss of executors, and column pruning still works.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _plain(path: str) -> str:
    """A path without its scheme and trailing slashes."""
    return "/" + re.sub(r"^[A-Za-z0-9+.-]+:", "", path).strip("/")


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``materialise`` wrote and no job reads any more.

    Only a folder directly below the shared one is ever deleted.
    """
    spark = df.sparkSession
    root = _plain(work_dir(spark))
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        if os.path.dirname(_plain(folder)) == root:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers (what --py-files does)."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="askgrade-py-"), "askgrade.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, files in os.walk(root):
            for name in sorted(files):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(application)
