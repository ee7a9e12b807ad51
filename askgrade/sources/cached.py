"""Data sets kept on disk, keyed by the arguments and the input they were built from."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from askgrade.session import new_path, work_dir

MANIFEST = "_MANIFEST"


def _file_system(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def fingerprint(spark: SparkSession, inputs: Iterable[str]) -> str:
    """A digest of the names, sizes and times of all files below the inputs.

    It changes when a file is added, removed or written again. The driver lists the files and
    holds one digest, not the list. A missing input raises ``FileNotFoundError``.
    """
    total, count = 0, 0
    for place in inputs:
        system, path = _file_system(spark, place)
        if not system.exists(path):
            raise FileNotFoundError(place)
        files = system.listFiles(path, True)
        while files.hasNext():
            status = files.next()
            entry = f"{status.getPath()}|{status.getLen()}|{status.getModificationTime()}"
            # a sum of digests does not depend on the order in which files are listed
            total += int.from_bytes(hashlib.sha256(entry.encode()).digest(), "big")
            count += 1
    return hashlib.sha256(f"{count}|{total}".encode()).hexdigest()


def cached_dataset(
    spark: SparkSession,
    name: str,
    arguments: dict,
    build: Callable[[], DataFrame],
    inputs: Iterable[str] = (),
) -> DataFrame:
    """The stored data set for these arguments and the present state of ``inputs``; built if missing.

    It is written to a folder of its own with a manifest, then renamed into place in one step,
    so readers see a whole data set or none. Of several builders at once the first to rename
    wins; the others delete theirs and read the winner's. A builder that died leaves nothing
    that a reader would take for the data set. Renaming must be atomic and must not replace a
    folder, as on HDFS and local disks.
    """
    inputs = list(inputs)
    stated = {"arguments": arguments, "input": fingerprint(spark, inputs), "inputs": inputs}
    manifest = json.dumps(stated, sort_keys=True, default=str)
    key = hashlib.sha256(manifest.encode()).hexdigest()
    parent = f"{work_dir(spark)}/datasets"
    place = f"{parent}/{name}-{key[:32]}"
    system, target = _file_system(spark, place)
    if not system.exists(target):
        _publish(spark, build(), manifest, parent, place)
    return spark.read.parquet(f"{place}/data")


def _publish(spark: SparkSession, df: DataFrame, manifest: str, parent: str, place: str) -> None:
    draft = new_path(spark, "draft")
    system, source = _file_system(spark, draft)
    df.write.parquet(f"{draft}/data")
    out = system.create(_file_system(spark, f"{draft}/{MANIFEST}")[1], False)
    out.write(bytearray(manifest.encode()))
    out.close()
    system.mkdirs(_file_system(spark, parent)[1])
    target = _file_system(spark, place)[1]
    if not system.exists(target):
        system.rename(source, target)
    nested = _file_system(spark, f"{place}/{source.getName()}")[1]
    for left in (source, nested):  # some file systems move a folder into one that is there already
        system.delete(left, True)
