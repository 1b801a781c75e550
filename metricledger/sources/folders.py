"""Folders of partitioned tables: what is there, and what is to go. Runs on the driver, through Hadoop's file system."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _at(spark, path)
    return files.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder with all it holds; one that is not there is no error."""
    files, place = _at(spark, path)
    files.delete(place, True)


def days(spark: SparkSession, path: str) -> list[dt.date]:
    """Days that a table partitioned by ``dt`` has folders for, in order."""
    files, place = _at(spark, path)
    names = [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []
    return sorted(dt.date.fromisoformat(name[3:]) for name in names if name.startswith("dt="))
