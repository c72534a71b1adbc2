"""Append and snapshot sinks on Parquet folders."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callboard.sources import working


class VersionTaken(RuntimeError):
    """Another writer has committed the version that this one was about to commit."""


def append(df: DataFrame, path: str) -> None:
    """Add rows to a Parquet table."""
    df.write.mode("append").parquet(path)


# A snapshot table is a folder of data folders with names of their own and a ``manifest``
# folder with one small file per version that names its data. Making that file is the commit.


def _entry(spark: SparkSession, root: str, version: int) -> str | None:
    """The data folder of a version; None if its entry is missing or was never finished."""
    path, system = working.resolve(spark, f"{root}/manifest/{version:09d}")
    if not system.exists(path):
        return None
    source = system.open(path)
    try:
        text = bytes(source.readAllBytes()).decode()
    finally:
        source.close()
    return f"{root}/{text.strip()}" if text.endswith("\n") else None


def _versions(spark: SparkSession, root: str) -> list[int]:
    return [int(n) for n in working.children(spark, f"{root}/manifest") if n.isdigit()]


def current_version(spark: SparkSession, root: str) -> int:
    """Newest committed version, 0 when the table has none."""
    for version in sorted(_versions(spark, root), reverse=True):
        if _entry(spark, root, version):
            return version
    return 0


def write_snapshot(df: DataFrame, root: str, cluster_by: tuple[str, ...] = ()) -> str:
    """Replace a table's content: write the data, then commit it as the next version.

    The data goes into a folder that only the manifest names, so a crash before the commit
    leaves a folder that nobody reads and blocks nothing. The version is fixed before the
    data is written and the commit never overwrites: of two writers that started from the
    same version the second gets ``VersionTaken``. ``cluster_by`` range-partitions and sorts
    the files so that row-group statistics prune later key filters.
    """
    spark = df.sparkSession
    version = max(_versions(spark, root), default=0) + 1
    name = f"data-{uuid.uuid4().hex}"
    if cluster_by:
        df = df.repartitionByRange(*cluster_by).sortWithinPartitions(*cluster_by)
    df.write.mode("errorifexists").parquet(f"{root}/{name}")
    commit(spark, root, version, name)
    return f"{root}/{name}"


def commit(spark: SparkSession, root: str, version: int, name: str) -> None:
    """Name the data folder of a version, once and for all."""
    path, system = working.resolve(spark, f"{root}/manifest/{version:09d}")
    try:
        out = system.create(path, False)
    except Exception as taken:
        if "already exists" in str(taken) or "FileAlreadyExists" in str(taken):
            raise VersionTaken(f"version {version} of {root} was committed by another writer") from taken
        raise
    try:
        out.write(bytearray(f"{name}\n".encode()))
    finally:
        out.close()


def read_snapshot(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """Read one committed version of a snapshot table, the newest by default."""
    version = version or current_version(spark, root)
    path = _entry(spark, root, version) if version else None
    if path is None:
        raise FileNotFoundError(f"no snapshot {version or ''} under {root}")
    return spark.read.parquet(path)


# A partitioned table is a plain folder of Parquet partitions. Replacing some of them goes in three
# steps: the new rows are staged in a hidden folder; one small file decides the switch; Spark's
# dynamic partition overwrite carries it out. Whatever fails, the table is as before the file or can be brought to
# the state after it.


def write_partitioned(df: DataFrame, root: str, by: Sequence[str]) -> None:
    """Store a table in one folder per value of the ``by`` columns."""
    df.repartition(*by, F.pmod(F.xxhash64(*df.columns), F.lit(8))).write.mode("errorifexists").partitionBy(*by).parquet(root)


def replace_partitions(df: DataFrame, root: str, by: Sequence[str], folders: Sequence[str]) -> None:
    """Put the rows of ``df`` in place of all rows in its partitions; of ``folders``, those that it leaves empty go.

    ``folders`` are paths below the root such as ``status=F``. Other partitions' files aren't
    touched. A reader may see some partitions before and others after; use snapshots where
    that matters. One writer at a time.
    """
    spark = df.sparkSession
    recover_partitions(spark, root)
    staged = f"_staged-{uuid.uuid4().hex}"
    df.repartition(*by, F.pmod(F.xxhash64(*df.columns), F.lit(8))).write.partitionBy(*by).parquet(f"{root}/{staged}")
    emptied = [f for f in folders if not working.exists(spark, f"{root}/{staged}/{f}")]
    decided = {"staged": staged, "by": list(by), "emptied": emptied, "schema": df.schema.jsonValue()}
    working.put(spark, f"{root}/_switch", json.dumps(decided).encode())
    recover_partitions(spark, root)


def recover_partitions(spark: SparkSession, root: str) -> None:
    """Finish a decided switch and remove what an undecided one has staged."""
    text = working.get(spark, f"{root}/_switch")
    if text is not None:
        decided = json.loads(text)
        staged = spark.read.schema(T.StructType.fromJson(decided["schema"])).parquet(f"{root}/{decided['staged']}")
        switched = staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        switched.partitionBy(*decided["by"]).parquet(root)
        for folder in decided["emptied"]:
            working.drop(spark, f"{root}/{folder}")
        working.drop(spark, f"{root}/_switch")
    for name in working.children(spark, root):
        if name.startswith("_staged-"):
            working.drop(spark, f"{root}/{name}")


#: Folders of a split that is written batch by batch, each with its own number.
BATCH = "_batch"


def write_split(checked: DataFrame, path: str, flag: str = "is_valid") -> None:
    """Write valid and quarantined rows in one pass, as two folders of one table."""
    checked.write.mode("errorifexists").partitionBy(flag).parquet(path)


def read_split(spark: SparkSession, path: str, flag: str = "is_valid") -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with their violations); each side reads its own folder."""
    # A folder name is read back as text, and this comparison prunes folders.
    stored = spark.read.parquet(path).drop(BATCH)
    valid = stored.where(F.col(flag) == "true").drop(flag, "violations")
    return valid, stored.where(F.col(flag) == "false").drop(flag)
