"""Whole folders in the file system of their path: what a task writes file by file becomes visible in one step."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _handle(spark: SparkSession, path: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, path: str) -> bool:
    system, folder = _handle(spark, path)
    return system.exists(folder)


def names(spark: SparkSession, path: str) -> list[str]:
    """The names of what a folder holds, in order; none if there is no such folder."""
    system, folder = _handle(spark, path)
    return sorted(entry.getPath().getName() for entry in system.listStatus(folder)) if system.exists(folder) else []


def remove(spark: SparkSession, path: str) -> None:
    system, folder = _handle(spark, path)
    system.delete(folder, True)


def rename(spark: SparkSession, path: str, target: str) -> bool:
    """Whether ``path`` is at ``target`` now, which must not exist before. The folder above is made if need be."""
    system, source = _handle(spark, path)
    place = _handle(spark, target)[1]
    if system.exists(place):
        return False
    system.mkdirs(place.getParent())
    return system.rename(source, place)


def replace(spark: SparkSession, new: str, path: str, before: str) -> None:
    """Put the folder ``new`` in the place of ``path``. What was there waits at ``before``, and comes back if that
    fails."""
    replaced = exists(spark, path)
    if replaced and not rename(spark, path, before):
        raise OSError(f"{path} cannot be replaced")
    if not exists(spark, new) or not rename(spark, new, path):
        if replaced:
            rename(spark, before, path)
        raise OSError(f"{new} cannot take the place of {path}")
    if replaced:
        remove(spark, before)
