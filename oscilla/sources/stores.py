"""Paths as Spark and as Python sources understand them: both must mean the same store."""

from __future__ import annotations

import re

from pyarrow import fs
from pyspark.sql import SparkSession


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme: what names none lies in Spark's default file system, which need not be the local one."""
    if re.match(r"s3[an]?://", path):
        return re.sub(r"^s3[an]?:", "s3:", path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return re.sub(r"^file:/+", "file:///", full)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; without a scheme the local one."""
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]+:/", path) else (fs.LocalFileSystem(), path)
