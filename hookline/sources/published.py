"""Published versions of a folder: written whole first, pointed to last.

    <root>/versions/<unique>/...    what a publication writes
    <root>/pointers/<number>        one line with the version's name, highest number counts

A pointer file is created under a number that nobody has taken and never
changes, so there is nothing to replace in place: readers see the old version
until the new one is complete, on object stores as well as on HDFS. A
publication that fails leaves no pointer.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _pointers(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """(number, path) of all pointers, latest first."""
    fs, p = _fs(spark, f"{root}/pointers")
    if not fs.exists(p):
        return []
    names = [s.getPath() for s in fs.listStatus(p)]
    return sorted(((int(n.getName()), n.toString()) for n in names if n.getName().isdigit()), reverse=True)


def current(spark: SparkSession, root: str) -> str | None:
    """Folder of the latest complete version, None if there is none."""
    for _, path in _pointers(spark, root):
        fs, p = _fs(spark, path)
        stream = fs.open(p)
        try:
            line = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        if line.endswith("\n"):   # else its publisher is writing it just now
            return f"{root}/versions/{line.strip()}"
    return None


def publish(spark: SparkSession, root: str, write: Callable[[str], None]) -> str:
    """Let ``write`` fill a new version folder, then point to it; returns the folder."""
    version = uuid.uuid4().hex
    folder = f"{root}/versions/{version}"
    write(folder)
    number = next((n for n, _ in _pointers(spark, root)), 0) + 1
    while True:
        fs, p = _fs(spark, f"{root}/pointers/{number:012d}")
        if not fs.exists(p):
            try:
                out = fs.create(p, False)   # fails if another publisher has taken the number meanwhile
            except Exception:
                if not fs.exists(p):
                    raise
            else:
                out.write(bytearray(f"{version}\n".encode()))
                out.close()
                return folder
        number += 1
