"""Row changes as transforms from one table snapshot to the next, with change audits.

Nothing is updated in place: an operator takes the current frames and returns the next
ones, which ``sources.sinks.write_snapshot`` stores as a new version.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callboard.functions import scalars as S
from callboard.operators.aggregates import first_by
from callboard.operators.joins import having_match, join_on, without_match
from callboard.sources import sinks, working
from callboard.sources.model import NO_DEFAULT, NOW, Ref, Table

# Inserts ---------------------------------------------------------------------------


def with_ids(base: DataFrame, new: DataFrame, id_column: str, order_by: Sequence[str]) -> DataFrame:
    """New rows numbered from the base's highest id, in the order of a unique key.

    Rows are range-partitioned and sorted, and each remembers its place within its
    partition. That layout is kept in a working table, so the count of rows per partition
    and the rows themselves agree even if an executor is lost in between. The offsets frame
    has one row per partition, which bounds both its window and its broadcast.
    """
    place = F.monotonically_increasing_id()
    laid_out = working.table(
        new.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .withColumn("_place", place)
        .withColumn("_part", F.shiftright("_place", 33))
        .withColumn("_row", F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_place"),
        "numbered",
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = laid_out.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    offsets = offsets.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    highest = base.agg(F.coalesce(F.max(id_column), F.lit(0)).alias("m")).scalar()
    number = (highest + F.col("_offset") + F.col("_row") + 1).cast(base.schema[id_column].dataType)
    numbered = laid_out.join(F.broadcast(offsets), "_part").withColumn(id_column, number)
    return numbered.select(id_column, *[c for c in new.columns if c != id_column])


def append_with_ids(base: DataFrame, new: DataFrame, id_column: str, order_by: Sequence[str]) -> DataFrame:
    """The base and the new rows with their ids; columns missing in one side are NULL."""
    return base.unionByName(with_ids(base, new, id_column, order_by), allowMissingColumns=True)


def insert_ignore(
    base: DataFrame,
    new: DataFrame,
    key: Sequence[str],
    order_by: Sequence[str] = (),
    collation: str | None = None,
) -> DataFrame:
    """Base plus the new rows whose key is not there yet; of equal new keys the first wins.

    ``order_by`` says which of them is first (all columns by default). A ``collation``
    makes text keys compare without regard to case or accents. A key that holds a NULL
    equals no other, so all rows with such keys arrive.
    """
    order = list(order_by) or [c for c in new.columns if c not in key] or list(key)
    open_key = reduce(Column.__or__, [F.col(k).isNull() for k in key])
    keyless, new = new.where(open_key), new.where(~open_key)
    if collation is None:
        fresh = without_match(first_by(new, key, order), base, {k: k for k in key})
        return base.unionByName(fresh).unionByName(keyless)

    def compared(df: DataFrame) -> DataFrame:
        text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
        return df.withColumns({f"_c_{k}": F.collate(k, collation) if k in text else F.col(k) for k in key})

    collated = [f"_c_{k}" for k in key]
    fresh = first_by(compared(new), collated, [*order, *key])
    fresh = without_match(fresh, compared(base), {c: c for c in collated})
    return base.unionByName(fresh.drop(*collated)).unionByName(keyless)


def insert_select(target: DataFrame, parent: DataFrame, on: Mapping[str, str], copied: Mapping[str, str]) -> DataFrame:
    """New rows that take attributes from their parent; rows without a parent are not inserted."""
    picked = parent.select(*on.values(), *[F.col(source).alias(f"_{name}") for name, source in copied.items()])
    joined = join_on(target, picked, on, "inner", [f"_{name}" for name in copied], spread=True)
    kept = [c for c in target.columns if c not in copied]
    return joined.select(*kept, *[F.col(f"_{name}").alias(name) for name in copied])


def fill_defaults(df: DataFrame, table: Table, now: dt.datetime | None = None) -> DataFrame:
    """Columns absent from the frame get their declared default; a NULL given as such stays."""
    columns = []
    for c in table.columns:
        if c.name in df.columns:
            value = F.col(c.name)
        elif c.default is NO_DEFAULT:
            value = F.lit(None)
        else:
            value = F.lit(now) if c.default is NOW else F.lit(c.default)
        kind = df.schema[c.name].dataType if c.name in df.columns else c.type
        columns.append(value.cast(kind).alias(c.name))
    return df.select(*columns)


def ingest_with_list(
    base: DataFrame,
    new: DataFrame,
    id_column: str,
    order_by: Sequence[str],
    list_column: str,
    item: str,
    fixed: Mapping[str, object] | None = None,
    sep: str = ",",
    default_list: str | None = None,
    collation: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """New parents with ids and ``fixed`` columns, and one child row per list entry.

    The ids are freshly made, so the children cannot clash with stored ones and repeats
    within a list are dropped in the row itself, without a shuffle. No entry, no child.
    """
    numbered = with_ids(base, new, id_column, order_by)
    parents = numbered.drop(list_column).withColumns({c: F.lit(v) for c, v in (fixed or {}).items()})
    text = F.col(list_column) if default_list is None else F.coalesce(F.col(list_column), F.lit(default_list))
    children = numbered.select(id_column, F.explode(S.split_list(text, sep, collation)).alias(item))
    return parents, children


def ingest_location_cost(base: DataFrame, requests: DataFrame, order_by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """New locations with ids, and a shooting row each with its day count and cost.

    A missing end date means seven days after the start. Negative rates and ends before
    the start are turned down; a missing rate or date is not.
    """
    dated = requests.withColumn("shooting_end", S.end_or_default("shooting_start", "shooting_end", 7))
    bad = (F.col("cost_per_day") < 0) | (F.col("shooting_end") < F.col("shooting_start"))
    numbered = with_ids(base, dated.where(~F.coalesce(bad, F.lit(False))), "location_id", order_by)
    locations = numbered.select("location_id", "name", "city", "country", "cost_per_day")
    shootings = numbered.select(
        "film_id",
        "location_id",
        "shooting_start",
        "shooting_end",
        S.inclusive_days("shooting_start", "shooting_end").alias("total_days"),
        S.stay_cost("shooting_start", "shooting_end", "cost_per_day").alias("total_cost"),
    )
    return locations, shootings


# Updates ---------------------------------------------------------------------------


def one_per_key(
    updates: DataFrame, key: Sequence[str], columns: Sequence[str], order_by: Sequence[str] = ()
) -> DataFrame:
    """The last update of each key, in the order of ``order_by`` and then of the values.

    A map-side combine: a key updated very often sends one row per task.
    """
    moment = F.struct(*order_by, *[F.col(c).alias(f"_{c}") for c in columns])
    last = updates.groupBy(*key).agg(F.max_by(F.struct(*columns), moment).alias("_new"))
    return last.select(*key, *[F.col(f"_new.{c}").alias(c) for c in columns])


def apply_updates(
    base: DataFrame,
    updates: DataFrame,
    key: Sequence[str],
    columns: Sequence[str],
    touched: str | None = None,
    now: Column | dt.datetime | None = None,
    order_by: Sequence[str] = (),
) -> DataFrame:
    """Sets ``columns`` of the rows named by ``updates``.

    Of several updates of one key the last counts, see ``one_per_key``, so no row of the
    base is ever multiplied. A NULL in the update is set as NULL, an update without a key
    matches nothing. ``touched`` is set to ``now`` on the rows where a value really changed.
    """
    return _with_updates(base, one_per_key(updates, key, columns, order_by), key, columns, touched, now)


def _with_updates(
    base: DataFrame, updates: DataFrame, key: Sequence[str], columns: Sequence[str], touched: str | None, now: Column | dt.datetime | None
) -> DataFrame:
    """``apply_updates`` with one update per key."""
    updates = updates.select(*key, F.struct(*columns).alias("_new"))
    arriving = updates.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], "_new")
    joined = base.join(arriving, [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(key)], "left")
    hit = F.col("_new").isNotNull()
    changed = F.lit(False)
    for c in columns:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"_new.{c}"))
    result = []
    for c in base.columns:
        if c in columns:
            value = F.when(hit, F.col(f"_new.{c}")).otherwise(F.col(c))
        elif c == touched:
            moment = now if isinstance(now, Column) else F.lit(now)
            value = F.when(hit & changed, moment).otherwise(F.col(c))
        else:
            value = F.col(c)
        result.append(value.cast(base.schema[c].dataType).alias(c))
    return joined.select(*result)


def audit_changes(
    old: DataFrame,
    new: DataFrame,
    key: Sequence[str],
    tracked: Mapping[str, str] | None = None,
    carry: Sequence[str] = (),
    skip_equal: int | None = None,
) -> DataFrame:
    """Audit rows between two snapshots of one table with a unique key.

    Gives one INSERT or DELETE row per key found on one side only, and per ``tracked``
    column that differs one row with that column's action name. A value that is or
    becomes NULL is no change. Columns in ``carry`` come along as ``old_*`` and ``new_*``.

    ``skip_equal`` names a number of key ranges. Ranges in which both snapshots have the same
    digests are left out before the join (see ``unequal_ranges``), which pays where few
    rows have changed.
    """
    tracked = dict(tracked or {})
    seen = list(dict.fromkeys([*tracked, *carry]))
    if skip_equal:
        differs = unequal_ranges(old, new, key, list(tracked), skip_equal)
        old, new = old.where(differs), new.where(differs)

    def side(df: DataFrame, name: str) -> DataFrame:
        # The key inside the struct makes it non-NULL exactly where the row exists.
        return df.select(
            *[F.col(k).alias(f"{name}k{i}") for i, k in enumerate(key)], F.struct(key[0], *seen).alias(name)
        )

    match = [F.col(f"_ok{i}") == F.col(f"_nk{i}") for i in range(len(key))]
    both = side(old, "_o").join(side(new, "_n"), match, "full_outer")

    def entry(action: str, field: str | None = None) -> Column:
        before, after = (F.col(f"_o.{field}"), F.col(f"_n.{field}")) if field else (F.lit(None), F.lit(None))
        return F.struct(
            F.lit(action).alias("action"),
            F.lit(field).cast("string").alias("field"),
            before.cast("string").alias("old_value"),
            after.cast("string").alias("new_value"),
        )

    entries = F.array_compact(
        F.array(
            F.when(F.col("_o").isNull(), entry("INSERT")),
            F.when(F.col("_n").isNull(), entry("DELETE")),
            *[F.when(F.col(f"_o.{c}") != F.col(f"_n.{c}"), entry(action, c)) for c, action in tracked.items()],
        )
    )
    keys = [F.coalesce(f"_ok{i}", f"_nk{i}").alias(k) for i, k in enumerate(key)]
    carried = [F.col(f"_{s[0]}.{c}").alias(f"{s}_{c}") for c in carry for s in ("old", "new")]
    rows = both.select(*keys, *carried, F.explode(entries).alias("_e"))
    return rows.select(*key, "_e.action", "_e.field", "_e.old_value", "_e.new_value", *[c for c in rows.columns
        if c not in key and c != "_e"])


def rewrite_partitions(
    spark: SparkSession, root: str, by: Sequence[str], keys: DataFrame, change: Callable[[DataFrame], DataFrame]
) -> list[str]:
    """Change the rows of some keys in a partitioned table by rewriting only the partitions they are in or move to.

    ``keys`` holds the key columns. ``change`` gets rows of the table and gives the rows they
    become; it leaves rows of other keys as they are. Finding the partitions reads the key
    columns alone. Returns the folders that were rewritten or emptied. A crash leaves the
    table as it was or in a state that the next call, or ``sinks.recover_partitions``, completes.
    """
    sinks.recover_partitions(spark, root)
    base = spark.read.parquet(root)
    on = {k: k for k in keys.columns}
    # A file's folders name its partition, in the escaped form that Spark gives them.
    folder = F.slice(F.split(F.col("_metadata.file_path"), "/"), -len(by) - 1, len(by))
    placed = base.withColumn("_folder", F.array_join(folder, "/"))
    hit = working.table(having_match(placed, keys, on, spread=True), "hit")
    before = hit.select("_folder", *by).distinct()
    after = change(hit.drop("_folder")).select(*by).distinct()
    old, new = before.collect(), after.collect()  # partitions of the table at most
    values = {tuple(r[b] for b in by) for r in [*old, *new]}
    if not values:
        return []
    chosen = reduce(Column.__or__, [reduce(Column.__and__, [F.col(b).eqNullSafe(F.lit(x)) for b, x in zip(by, v)]) for v in sorted(values, key=repr)])
    folders = [unquote(r["_folder"]) for r in old]
    # Rows of a partition that only receives rows aren't touched by ``change``, but stand beside those that arrive.
    sinks.replace_partitions(change(base.where(chosen)), root, by, folders)
    return folders


def update_partitions(
    spark: SparkSession, root: str, by: Sequence[str], updates: DataFrame, key: Sequence[str], columns: Sequence[str],
    touched: str | None = None, now: Column | dt.datetime | None = None, order_by: Sequence[str] = (),
) -> list[str]:
    """``apply_updates`` on a partitioned table; a row whose partition column changes moves."""
    last = working.table(one_per_key(updates.dropna(subset=list(key)), key, columns, order_by), "updates")
    return rewrite_partitions(spark, root, by, last.select(*key), lambda df: _with_updates(df, last, key, columns, touched, now))


def delete_from_partitions(spark: SparkSession, root: str, by: Sequence[str], keys: DataFrame) -> list[str]:
    """Rows of these keys leave a partitioned table; a partition without rows goes."""
    kept = working.table(keys.dropna().distinct(), "keys")
    return rewrite_partitions(spark, root, by, kept, lambda df: without_match(df, kept, {k: k for k in keys.columns}))


#: Conditions at most that a pruned audit filters its scans by; nearby ranges are put together beyond it.
SCAN_RANGES = 64


def unequal_ranges(old: DataFrame, new: DataFrame, key: Sequence[str], columns: Sequence[str], ranges: int) -> Column:
    """A condition on the key that holds for all rows in which two snapshots can differ.

    The first key column is cut into ``ranges`` parts: equal widths of whole numbers and dates, so
    that the condition prunes row groups of files clustered by key, else hash buckets. Each
    snapshot is reduced, map-side first, to one row per part: the count, and two 64-bit hashes
    with seeds of their own over key and columns, combined by exclusive-or. Parts equal in all
    three are taken for equal. Were they not, the 128 bits would have to agree by chance: odds of
    2**-128 a part for hashes that behave as random, none against someone who picks the
    values. Leave ``skip_equal`` off where that isn't enough. Rows with a null in the key are never skipped.
    """
    first, kind = key[0], old.schema[key[0]].dataType
    whole = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType))
    # The number that stands for a key; differences of numbers may not fit 64 bits.
    number = (F.unix_date(first) if isinstance(kind, T.DateType) else F.col(first)).cast("decimal(20,0)")
    if whole:
        ends = old.select(number.alias("n")).unionByName(new.select(number.alias("n"))).agg(F.min("n"), F.max("n")).first()
        low, high = (int(e) if e is not None else 0 for e in ends)
        width = (high - low) // ranges + 1
        part = F.floor((number - F.lit(low).cast("decimal(20,0)")) / F.lit(width).cast("decimal(20,0)")).cast("int")
    else:
        part = F.pmod(F.xxhash64(first), F.lit(ranges)).cast("int")

    def digests(df: DataFrame, name: str) -> DataFrame:
        shown = [x for c in dict.fromkeys([*key, *columns]) for x in (F.col(c), F.col(c).isNull())]
        return df.where(F.col(first).isNotNull()).groupBy(part.alias(f"{name}part")).agg(
            F.count(F.lit(1)).alias(f"{name}n"),
            F.bit_xor(F.xxhash64(*shown)).alias(f"{name}x"),
            F.bit_xor(F.xxhash64(F.lit("second seed"), *shown)).alias(f"{name}y"),
        )

    both = digests(old, "_o").join(digests(new, "_n"), F.col("_opart") == F.col("_npart"), "full_outer")
    same = (F.col("_on") == F.col("_nn")) & (F.col("_ox") == F.col("_nx")) & (F.col("_oy") == F.col("_ny"))
    parts = both.where(~F.coalesce(same, F.lit(False))).select(F.coalesce("_opart", "_npart").alias("part"))
    found = sorted(r["part"] for r in parts.collect())  # ``ranges`` numbers at most
    differs = reduce(Column.__or__, [F.col(k).isNull() for k in key])
    if not whole:
        return differs | part.isin(found) if found else differs
    spans: list[list[int]] = []
    for p in found:
        if spans and spans[-1][1] == p - 1:
            spans[-1][1] = p
        else:
            spans.append([p, p])
    while len(spans) > SCAN_RANGES:  # close the smallest gap; what lies in it is compared for nothing
        at = min(range(len(spans) - 1), key=lambda i: spans[i + 1][0] - spans[i][1])
        spans[at : at + 2] = [[spans[at][0], spans[at + 1][1]]]
    for begin, end in spans:
        limits = [min(low + begin * width, high), min(low + (end + 1) * width - 1, high)]
        if isinstance(kind, T.DateType):
            limits = [dt.date(1970, 1, 1) + dt.timedelta(days=n) for n in limits]
        differs = differs | F.col(first).between(*[F.lit(n).cast(kind) for n in limits])
    return differs


def audit_from_log(log: DataFrame, key: str, order_by: Sequence[str], value: str) -> DataFrame:
    """Value changes per key over a history in time order: the new row with ``old_value``.

    The history is range-partitioned on key and time together, so the rows of a hot key
    spread over many tasks (a window partitioned by key would hold them in one). Each task
    compares neighbours as Arrow batches and also emits its first and last row. Those two
    rows per task are kept with the changes in one working table, and a small window over
    them finds the changes that fall on a task boundary.
    """
    columns = [key, *order_by, value]
    rows = log.where(F.col(key).isNotNull()).select(*columns)
    kinds = [T.StructField(f.name, f.dataType) for f in rows.schema.fields]
    old_value = T.StructField("old_value", rows.schema[value].dataType)
    out = T.StructType([*kinds, old_value, T.StructField("_kind", T.IntegerType())])

    def neighbours(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shaped(table: pa.Table, before: pa.ChunkedArray | None, kind: int) -> Iterator[pa.RecordBatch]:
            old = pa.nulls(table.num_rows, table.schema.field(value).type) if before is None else before
            table = table.append_column("old_value", old)
            yield from table.append_column("_kind", pa.array([kind] * table.num_rows, pa.int32())).to_batches()

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if last is None:
                yield from shaped(table.slice(0, 1), None, HEAD)
                run = table
            else:
                run = pa.concat_tables([last, table])
            before, after = run.slice(0, run.num_rows - 1), run.slice(1)
            same_key = pc.equal(before[key], after[key])
            changed = pc.and_(same_key, pc.not_equal(before[value], after[value]))
            yield from shaped(after.filter(changed), before[value].filter(changed), CHANGE)
            last = table.slice(table.num_rows - 1, 1)
        if last is not None:
            yield from shaped(last, None, TAIL)

    spread = rows.repartitionByRange(key, *order_by).sortWithinPartitions(key, *order_by)
    found = working.table(spread.mapInArrow(neighbours, out), "audit")
    edges = found.where(F.col("_kind") != CHANGE)
    in_time = Window.partitionBy(key).orderBy(*order_by, "_kind")
    crossing = edges.withColumn("old_value", F.lag(value).over(in_time)).where(
        (F.col("_kind") == HEAD) & (F.col("old_value") != F.col(value))
    )
    changes = found.where(F.col("_kind") == CHANGE).unionByName(crossing)
    return changes.select(key, *order_by, "old_value", F.col(value).alias("new_value"))


CHANGE, HEAD, TAIL = 0, 1, 2


def status_update(
    base: DataFrame,
    updates: DataFrame,
    key: str,
    status: str,
    title: str,
    budget: str,
    include_procedure_row: bool = False,
    touched: str | None = None,
    now: Column | dt.datetime | None = None,
    order_by: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """Bulk status change: the next snapshot and the audit rows.

    Of several updates of one key the last counts, for the snapshot and the audit alike.
    ``touched`` is set to ``now`` where the status really changes.

    Only updated keys can be audited, so the audit joins the updates to the base and not
    two whole snapshots. There is one STATUS_CHANGE row per real change; with
    ``include_procedure_row`` also one STATUS_UPDATE row per update, without budgets.
    """
    updates = one_per_key(updates, [key], [status], order_by)
    after = _with_updates(base, updates, [key], [status], touched, now)
    asked = updates.select(F.col(key).alias("_k"), F.col(status).alias("new_status"))
    before = base.select(key, F.col(title).alias("film_title"), F.col(status).alias("old_status"), F.col(budget).alias("_b"))
    hit = before.join(asked, F.col(key) == F.col("_k"))

    def row(action: str, money: Column) -> Column:
        return F.struct(F.lit(action).alias("action"), money.alias("old_budget"), money.alias("new_budget"))

    nothing = F.lit(None).cast(base.schema[budget].dataType)
    entries = [F.when(F.col("old_status") != F.col("new_status"), row("STATUS_CHANGE", F.col("_b")))]
    if include_procedure_row:
        entries.append(row("STATUS_UPDATE", nothing))
    audit = hit.select(
        key, "film_title", "old_status", "new_status", F.explode(F.array_compact(F.array(*entries))).alias("_e")
    )
    # Fixed value: the message text.
    text = S.message("Film status updated from {} to {}", "old_status", "new_status")
    return after, audit.select(
        key, "film_title", "old_status", "new_status", "_e.old_budget", "_e.new_budget", "_e.action",
        text.alias("message"),
    )


def append_audit(
    log: DataFrame, rows: DataFrame, table: Table, order_by: Sequence[str], now: dt.datetime
) -> DataFrame:
    """An audit table with new rows appended: declared columns, running ids and a time.

    Columns the rows lack take their declared default, so ``timestamp`` is ``now`` unless
    the rows bring one. ``order_by`` is the unique order in which ids are given.
    """
    (id_column,) = table.key
    shaped = fill_defaults(rows.drop(id_column), table, now)
    extra = [c for c in order_by if c not in shaped.columns]
    if extra:
        raise ValueError(f"{table.name} has no columns {extra} to number by")
    return append_with_ids(log, shaped.drop(id_column), id_column, order_by)


# Deletes ---------------------------------------------------------------------------


def delete_cascade(
    tables: Mapping[str, DataFrame],
    root: str,
    keys: DataFrame,
    refs: Sequence[tuple[str, Ref]],
) -> dict[str, DataFrame]:
    """All tables after deleting the root rows named by ``keys``.

    Follows the foreign keys parents first: a cascading key drops the child rows (and so
    on downwards), a set-null key clears the column. ``refs`` lists (child, key) pairs
    with parents before children, as ``sources.model.references`` does. The deleted keys of
    each level that has children are kept in a working table.
    """
    left = dict(tables)
    pk = keys.columns
    left[root] = without_match(tables[root], keys, {k: k for k in pk})
    gone: dict[str, DataFrame] = {root: having_match(tables[root], keys, {k: k for k in pk})}
    parents = {r.table for _, r in refs}
    reached = {r.table: sorted({x.parent for _, x in refs if x.table == r.table}) for _, r in refs}
    for child in dict.fromkeys(c for c, _ in refs):
        if child not in tables:
            continue
        dropped: DataFrame | None = None
        for ref in (r for c, r in refs if c == child and r.table in gone):
            on, dead = {ref.column: ref.parent}, gone[ref.table]
            if ref.on_delete == "set null":
                left[child] = set_null(left[child], ref.column, dead, ref.parent)
                continue
            left[child] = without_match(left[child], dead, on, spread=True)
            if child in parents:
                part = having_match(tables[child], dead, on, spread=True)
                dropped = part if dropped is None else dropped.unionByName(part)
        if dropped is not None:
            # Written once: all tables below join these keys instead of finding them again.
            gone[child] = working.table(dropped.select(*reached[child]).distinct(), "gone")
    return left


def set_null(df: DataFrame, column: str, dead: DataFrame, parent: str) -> DataFrame:
    """Clears a reference to deleted parents."""
    names = dead.select(parent).distinct().withColumn("_dead", F.lit(True))
    joined = join_on(df, names, {column: parent}, "left", ["_dead"], spread=True)
    cleared = F.when(F.col("_dead").isNull(), F.col(column))
    return joined.withColumn(column, cleared).select(*df.columns)


# Accounts --------------------------------------------------------------------------


def login_rows(attempts: DataFrame) -> DataFrame:
    """Activity-log rows for login attempts (``username, success, ip_address, timestamp``)."""
    # Action names and descriptions.
    return attempts.select(
        "username",
        F.when(F.col("success"), "LOGIN_SUCCESS").otherwise("LOGIN_FAILED").alias("action_type"),
        F.when(F.col("success"), "User logged in successfully")
        .otherwise("Failed login attempt")
        .alias("action_description"),
        "ip_address",
        "timestamp",
    )


def last_logins(
    accounts: DataFrame, log: DataFrame, key: str = "username", at: str = "timestamp", success: str = "LOGIN_SUCCESS"
) -> DataFrame:
    """Accounts with ``last_login`` moved to their latest success in the log."""
    latest = log.where(F.col("action_type") == success).groupBy(F.col("username").alias("_k")).agg(F.max(at).alias("_at"))
    joined = accounts.join(latest, F.col(key) == F.col("_k"), "left")
    return joined.withColumn("last_login", F.coalesce("_at", "last_login")).select(*accounts.columns)


def account_log_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """Activity-log rows for created accounts and for changes of state or role."""
    audit = audit_changes(
        old, new, ["username"], {"is_active": "USER_STATUS_CHANGE", "role": "USER_ROLE_CHANGE"}, ["role", "is_active"]
    )
    # Action names and description texts.
    text = (
        F.when(
            F.col("action") == "INSERT", S.message("User {} created with role {}", "username", "new_role")
        )
        .when(
            F.col("action") == "USER_STATUS_CHANGE",
            S.message(
                "User {} status changed to {}", "username", F.when(F.col("new_is_active"), "ACTIVE").otherwise("INACTIVE")
            ),
        )
        .otherwise(S.message("User {} role changed from {} to {}", "username", "old_role", "new_role"))
    )
    action = F.when(F.col("action") == "INSERT", "USER_CREATED").otherwise(F.col("action"))
    kept = audit.where(F.col("action") != "DELETE")
    return kept.select("username", action.alias("action_type"), text.alias("action_description"))


def create_accounts(accounts: DataFrame, requests: DataFrame, key: str = "username") -> tuple[DataFrame, DataFrame]:
    """Accounts with the requested ones added, and the requests turned down.

    A request is turned down if its name exists, or if an earlier request of the batch (in
    the order of all columns) has it, or if it has none.
    """
    named = requests.where(F.col(key).isNotNull())
    taken = having_match(requests, accounts, {key: key}, spread=True)
    free = without_match(named, accounts, {key: key}, spread=True)
    # Rows get numbers that stay, so that one of several equal requests can be told from the others.
    free = working.table(free.withColumn("_row", F.monotonically_increasing_id()), "requests")
    others = [c for c in requests.columns if c != key]
    won = free.groupBy(key).agg(F.min(F.struct(*others, "_row")).alias("_won"))
    fresh = won.select(key, "_won.*").select(*requests.columns)
    repeats = join_on(free, won.select(key, "_won._row"), {key: key, "_row": "_row"}, "left_anti").select(*requests.columns)
    rejected = taken.unionByName(repeats).unionByName(requests.where(F.col(key).isNull()))
    return accounts.unionByName(fresh, allowMissingColumns=True), rejected


def guarded_delete(accounts: DataFrame, keys: DataFrame, key: str = "username") -> DataFrame:
    """Bulk account deletion, adding ``outcome``: kept, deleted or rejected (see ``guarded``)."""
    return guarded(accounts, keys, key, "deleted")


def guarded_deactivate(accounts: DataFrame, keys: DataFrame, key: str = "username") -> DataFrame:
    """Bulk deactivation with ``outcome``; accounts that it is carried out for become inactive."""
    judged = guarded(accounts, keys, key, "deactivated")
    return judged.withColumn("is_active", F.col("is_active") & (F.col("outcome") != "deactivated"))


def guarded(accounts: DataFrame, keys: DataFrame, key: str, done: str) -> DataFrame:
    """Accounts with ``outcome``: kept, ``done`` or rejected.

    A batch that holds an administrator is carried out only if there was more than one
    active administrator and one remains; otherwise none of it is. The guard is one
    aggregate read as a scalar subquery, not a driver-side count.
    """
    named = keys.select(key).distinct().withColumn("_asked", F.lit(True))
    joined = join_on(accounts, named, {key: key}, "left", ["_asked"])
    asked = F.col("_asked").isNotNull()
    admin = F.col("role") == "admin"
    active = admin & F.col("is_active")
    counts = joined.agg(
        F.count_if(asked & admin).alias("admins_asked"),
        F.count_if(active).alias("active_before"),
        F.count_if(active & ~asked).alias("active_after"),
    )
    allowed = counts.select(
        (F.col("admins_asked") == 0) | ((F.col("active_before") > 1) & (F.col("active_after") >= 1))
    ).scalar()
    outcome = F.when(~asked, "kept").when(allowed, done).otherwise("rejected")
    return joined.withColumn("outcome", outcome).drop("_asked")
