"""Jobs over unbounded input whose results equal those of their batch forms.

The reference flows are event-driven: rows are validated as they arrive, every change
leaves an audit row, every action counts in a running summary. Each job reads any
streaming DataFrame and keeps its progress in ``checkpoint``, a folder that all
executors share. What a job remembers is Structured Streaming's own keyed state, in RocksDB.

Keyed jobs handle the rows that one batch brings for a key in one task. ``read_files`` bounds
a batch by its bytes, so a hot key's share of a batch is bounded too.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from callboard.operators.quality import VIOLATION, AnyRule, Unique, check
from callboard.sources import sinks

AVAILABLE = {"availableNow": True}
_STORE = "spark.sql.streaming.stateStore.providerClass"


#: Bytes of files in one batch unless a stream says otherwise.
BATCH_BYTES = 512 << 20


def off_heap_state(spark: SparkSession) -> None:
    """Keep streaming state in RocksDB unless the session names a store: state outgrows the heap."""
    if _STORE not in spark.conf.getAll:
        spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def read_files(
    spark: SparkSession, path: str, schema, files_per_batch: int | None = None, bytes_per_batch: int = BATCH_BYTES
) -> DataFrame:
    """Parquet files as a stream in batches of bounded bytes or of a number of files, oldest files first.

    A file that is larger alone makes a batch of its own. ``path`` is a folder, or a glob,
    which may also match single files.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        return reader.option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return reader.option("maxBytesPerTrigger", bytes_per_batch).parquet(path)


def _file_sink(rows: DataFrame, path: str, checkpoint: str, trigger: Mapping, by: Sequence[str] = ()) -> StreamingQuery:
    """An exactly-once Parquet sink."""
    writer = rows.writeStream.format("parquet").partitionBy(*by) if by else rows.writeStream.format("parquet")
    return writer.option("path", path).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _keyed_sink(
    checked: DataFrame, rule: Unique, order_by: Sequence[str], path: str, checkpoint: str, trigger: Mapping
) -> StreamingQuery:
    """A batch's rows, later copies of a key marked, under the batch's own number.

    Streaming deduplication says which keys a batch brings for the first time; its state is one
    entry per key. Of a new key's rows the first in order stays; the number of a row settles ties.
    A batch repeated after a failure overwrites its own rows.
    """
    off_heap_state(checked.sparkSession)
    keys = [f"k{i}" for i in range(len(rule.key))]
    shaped = checked.select(
        F.struct("*").alias("row"), F.struct(*order_by).alias("place"), *[F.col(c).alias(k) for c, k in zip(rule.key, keys)]
    )
    known = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    arrived = shaped.unionByName(shaped.where(known).select(*keys).dropDuplicates(), allowMissingColumns=True)
    broken = F.array(F.struct(F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.message).alias("message"))).cast(f"array<{VIOLATION}>")

    def store(batch: DataFrame, epoch: int) -> None:
        held = batch.withColumn("id", F.monotonically_increasing_id()).persist()
        try:
            real = F.col("row").isNotNull()
            first = held.where(known).groupBy(*keys).agg(
                F.min(F.when(real, F.struct("place", "id"))).alias("first"), F.max(~real).alias("new")
            )
            leads = first.where("new").select(F.col("first.id").alias("lead"))
            marked = held.where(real).join(leads, F.col("id") == F.col("lead"), "left")
            copy = F.expr(known) & F.col("lead").isNull()
            violations = F.when(copy, F.concat("row.violations", broken)).otherwise(F.col("row.violations"))
            out = marked.select("row.*", violations.alias("_now")).drop("violations", "is_valid")
            out = out.withColumnRenamed("_now", "violations").withColumn("is_valid", F.size("violations") == 0)
            out.write.mode("overwrite").partitionBy("is_valid").parquet(f"{path}/{sinks.BATCH}={epoch}")
        finally:
            held.unpersist()

    return arrived.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def quarantine(
    rows: DataFrame,
    rules: Sequence[AnyRule],
    path: str,
    checkpoint: str,
    refs: Mapping[str, DataFrame] | None = None,
    trigger: Mapping = AVAILABLE,
    order_by: Sequence[str] = (),
) -> StreamingQuery:
    """Mark rows on arrival and file them under ``is_valid=true`` or ``is_valid=false``.

    Row rules are one projection. Reference rules join the stream to a static parent table.
    One key rule may be among the rules: the first row of a key in the order of ``order_by``
    stays, later ones break the rule, where batches arrive in that order; a key that holds a
    NULL is never a copy. Which keys were seen is state, one entry per key. Both sides go into one
    exactly-once file sink, or with a key rule into a folder per batch; ``sinks.read_split`` reads either.
    """
    keys = [rule for rule in rules if isinstance(rule, Unique)]
    if len(keys) > 1 or keys and not order_by:
        raise ValueError("a stream takes one key rule, with the order that says which row is first")
    checked = check(rows, [rule for rule in rules if rule not in keys], refs)
    if keys:
        return _keyed_sink(checked, keys[0], order_by, path, checkpoint, trigger)
    return _file_sink(checked, path, checkpoint, trigger, ["is_valid"])


def running_summary(
    rows: DataFrame,
    key: str,
    measures: Mapping[str, Column],
    path: str,
    checkpoint: str,
    trigger: Mapping = AVAILABLE,
) -> StreamingQuery:
    """Per-key aggregates over all of history, kept up to date.

    The totals are the state of a streaming aggregation: one row per key, without a watermark,
    because the summary covers every row ever seen. A batch writes the new totals of the keys
    it changed and nothing else, under its own number; a batch repeated after a failure overwrites its own
    rows. ``latest_summary`` reads the newest row per key.
    """
    off_heap_state(rows.sparkSession)
    grouped = rows.groupBy(key).agg(*[m.alias(n) for n, m in measures.items()])

    def store(batch: DataFrame, epoch: int) -> None:
        # One column holds the row, so that no name meets that of the folder.
        batch.select(F.struct("*").alias("totals")).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return (
        grouped.writeStream.outputMode("update")
        .foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def latest_summary(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The newest row per key of a running summary: one aggregate over the rows that batches have written."""
    written = spark.read.parquet(path)
    newest = written.groupBy(F.col(f"totals.{key}").alias("_key")).agg(F.max_by("totals", "epoch").alias("totals"))
    return newest.select("totals.*")


class _Changes(StatefulProcessor):
    """Value changes of one key; its last value is the state."""

    def __init__(self, order_by: Sequence[str], kept: T.StructType):
        self.order, self.kept = list(order_by), kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", self.kept)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable", na_position="first")
        known, value = batch["known"].to_numpy(bool), batch["new_value"].to_numpy(object)
        was, old = self.last.get() if self.last.exists() else (False, None)
        known_before, before = np.r_[bool(was), known[:-1]], np.r_[np.array([old], object), value[:-1]]
        both = known & known_before
        changed = both.copy()
        changed[both] = before[both] != value[both]
        self.last.update((bool(known[-1]), value[-1] if known[-1] else None))
        yield batch[changed].assign(old_value=before[changed])[[*batch.columns[:-2], "old_value", "new_value"]]

    def close(self) -> None:
        pass


def change_audit(
    rows: DataFrame,
    key: str,
    order_by: Sequence[str],
    value: str,
    path: str,
    checkpoint: str,
    trigger: Mapping = AVAILABLE,
) -> StreamingQuery:
    """Value changes per key as they arrive, across batch boundaries, in one exactly-once file sink.

    Batches must arrive in time order; rows within a batch may come in any order and are
    sorted per key. A key's last value is Structured Streaming's own state: one entry per key.
    A null value changes nothing, before or after. ``read_changes`` reads the result.
    """
    off_heap_state(rows.sparkSession)
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    # Whole numbers with nulls would become floats in pandas; ``known`` tells nulls apart instead.
    whole = isinstance(kinds[value], T.IntegralType)
    shown = F.coalesce(F.col(value), F.lit(0).cast(kinds[value])) if whole else F.col(value)
    picked = rows.where(F.col(key).isNotNull()).select(key, *order_by, F.col(value).isNotNull().alias("known"), shown.alias("new_value"))
    named = [T.StructField(c, kinds[c]) for c in (key, *order_by)]
    out = T.StructType([*named, T.StructField("old_value", kinds[value]), T.StructField("new_value", kinds[value])])
    kept = T.StructType([T.StructField("known", T.BooleanType()), T.StructField("kept", kinds[value])])
    changes = picked.groupBy(key).transformWithStateInPandas(_Changes(order_by, kept), out, "Append", "None")
    return _file_sink(changes, path, checkpoint, trigger)


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    """All changes that a change audit has found so far."""
    return spark.read.parquet(path)
