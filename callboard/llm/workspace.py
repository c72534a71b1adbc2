"""Working files of the text operators; tables come from ``sources.working``."""

from __future__ import annotations

from pyspark.sql import SparkSession

from callboard.sources import working
from callboard.sources.working import drop, folder, release, written

__all__ = ["arrow_uri", "drop", "folder", "made", "named", "put", "release", "uri", "written"]


def uri(spark: SparkSession, path: str) -> str:
    """The full address of a path, with its scheme, as tasks need it."""
    hadoop, system = working.resolve(spark, path)
    return system.makeQualified(hadoop).toString()


def made(spark: SparkSession, path: str) -> str:
    """Make a folder that task code writes files into; returns its full address."""
    hadoop, system = working.resolve(spark, path)
    system.mkdirs(hadoop)
    return system.makeQualified(hadoop).toString()


def named(spark: SparkSession, path: str, ending: str, name) -> list[str]:
    """Give the files below ``path`` with this ending the paths name(0), name(1), ...; returns their full addresses."""
    hadoop, system = working.resolve(spark, path)
    found, places, out = system.listFiles(hadoop, True), [], []
    while found.hasNext():
        places.append(found.next().getPath())
    for place in sorted((p for p in places if p.getName().endswith(ending)), key=lambda p: p.toString()):
        target = working.resolve(spark, name(len(out)))[0]
        system.rename(place, target)
        out.append(system.makeQualified(target).toString())
    return out


def put(spark: SparkSession, path: str, data: bytes) -> str:
    """Write one small file into the shared folder; returns its full address."""
    hadoop, system = working.resolve(spark, path)
    out = system.create(hadoop, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    return system.makeQualified(hadoop).toString()


#: Schemes of Hadoop's file systems under the names that Arrow knows them by.
_ARROW_SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss", "hdfs": "hdfs", "file": "file", "s3": "s3"}


def arrow_uri(address: str) -> str:
    """The address of a file as Arrow's file systems take it; others than those above are an error that names them."""
    scheme, colon, rest = address.partition(":")
    if not colon or scheme not in _ARROW_SCHEMES:
        raise ValueError(f"task code can't write to {address}; set spark.checkpoint.dir to one of {', '.join(_ARROW_SCHEMES)}")
    return f"{_ARROW_SCHEMES[scheme]}:{rest}"
