"""Working tables in the folder that all executors share, with an owner and a release step.

A working table is compressed Parquet and holds only the columns it is given. Whoever makes
one drops it with ``dropped_after`` (a block whose tables go when it ends) or leaves it to
``release``, which removes all that this application has made and not yet dropped.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from callboard import session

_FOLDERS: dict[str, list[str]] = {}


def _owned(spark: SparkSession) -> list[str]:
    return _FOLDERS.setdefault(spark.sparkContext.applicationId, [])


def folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder below the shared one (see ``session.shared_folder``)."""
    path = f"{session.shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _owned(spark).append(path)
    return path


def resolve(spark: SparkSession, path: str):
    """Hadoop's path object and the file system it lies on."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def drop(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    hadoop, system = resolve(spark, path)
    system.delete(hadoop, True)


def release(spark: SparkSession) -> None:
    """Delete all working folders of this application; call it once results are stored."""
    for path in _FOLDERS.pop(spark.sparkContext.applicationId, []):
        drop(spark, path)


@contextmanager
def dropped_after(spark: SparkSession) -> Iterator[None]:
    """Working folders made in this block are deleted when it ends."""
    before = set(_owned(spark))
    try:
        yield
    finally:
        for path in [p for p in _owned(spark) if p not in before]:
            drop(spark, path)
            _owned(spark).remove(path)


def written(frame: DataFrame, path: str) -> DataFrame:
    """The frame as a table at ``path``: later steps read it and recompute nothing."""
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def table(frame: DataFrame, name: str) -> DataFrame:
    """The frame as a new working table."""
    return written(frame, folder(frame.sparkSession, name))


def children(spark: SparkSession, path: str) -> list[str]:
    """Names directly below a folder; none if it isn't there."""
    hadoop, system = resolve(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(hadoop)) if system.exists(hadoop) else []


def exists(spark: SparkSession, path: str) -> bool:
    hadoop, system = resolve(spark, path)
    return system.exists(hadoop)


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """Write one small file under another name and then give it its own, so that it is there whole or not at all."""
    part, system = resolve(spark, f"{path}.part")
    out = system.create(part, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    if not system.rename(part, resolve(spark, path)[0]):
        raise FileExistsError(path)


def get(spark: SparkSession, path: str) -> bytes | None:
    """The content of a small file; None if it isn't there."""
    hadoop, system = resolve(spark, path)
    if not system.exists(hadoop):
        return None
    source = system.open(hadoop)
    try:
        return bytes(source.readAllBytes())
    finally:
        source.close()
