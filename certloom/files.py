"""Files of the tables, through the file system that Spark uses for their path."""

from __future__ import annotations

from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    jpath, fs = file_system(spark, path)
    return fs.exists(jpath)


def delete_path(spark: SparkSession, path: str) -> None:
    jpath, fs = file_system(spark, path)
    fs.delete(jpath, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename within one file system."""
    jtarget, fs = file_system(spark, target)
    fs.mkdirs(jtarget.getParent())
    if not fs.rename(file_system(spark, source)[0], jtarget):
        raise OSError(f"cannot move {source} to {target}")


def mark(spark: SparkSession, path: str) -> None:
    """An empty file at `path`."""
    jpath, fs = file_system(spark, path)
    fs.create(jpath, True).close()


def folder_names(spark: SparkSession, path: str) -> list[str]:
    jpath, fs = file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(jpath)) if fs.exists(jpath) else []
