"""Small files (manifests, catalogs, plans) on whatever file system Spark itself reads: Hadoop's API, never open().

Paths are URIs as Spark takes them. A file is written beside its place and renamed to it, so a reader sees all of it or nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

from ..errors import FactloomError


def system(spark: SparkSession, path: str):
    """The file system of a path, and the path, as the JVM has them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = system(spark, path)
    return fs.exists(at)


def read(spark: SparkSession, path: str) -> bytes:
    fs, at = system(spark, path)
    if not fs.exists(at):
        raise FactloomError(f"no file at {path}")
    stream = fs.open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def write(spark: SparkSession, path: str, data: bytes, replace: bool = False) -> bool:
    """Whether the file was written: not where there is one already, unless it is to be replaced."""
    fs, at = system(spark, path)
    if fs.exists(at) and not replace:
        return False
    _, beside = system(spark, f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(beside, True)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()
    if replace and fs.exists(at):
        fs.delete(at, False)
    if not fs.rename(beside, at):
        fs.delete(beside, False)
        if replace or not fs.exists(at):
            raise FactloomError(f"{path} could not be written")
        return False
    return True


def read_json(spark: SparkSession, path: str):
    return json.loads(read(spark, path))


def names(spark: SparkSession, path: str) -> list[str]:
    """Names directly under a folder; none where there is no folder."""
    fs, at = system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def delete(spark: SparkSession, path: str) -> bool:
    fs, at = system(spark, path)
    return fs.delete(at, True)
