"""Merkle manifest of a table: a tree of SHA-256 digests per group, and one over the groups.

The leaf of a row digests its columns. Within a group leaves stand in the order of a key;
every ``FANOUT`` consecutive nodes become one, the SHA-256 of their digests as hex text,
until one is left, the group's subroot. The subroots, ordered by group, make a tree of the
same kind, whose last node is the root.

A parent keeps a copy of its hash state from before each child slot. Folding a replaced
child resumes the state of its slot with the replacement and the siblings to its right only;
what stands to the left is never hashed again.

Tasks work on aligned subtrees of ``SPAN`` nodes: one pass up makes the subtree's digest,
the same pass over those digests the next, until one node a group is left, about log(n) /
log(SPAN) passes over ever smaller tables. On the way down each subtree gets the siblings of
its own path to the root, as one row that precedes its nodes, builds its parents with their
states, and hands each node's path on, or folds its leaves. So however large a group is, a
task sees SPAN nodes and a path, and nothing goes through the driver but the number of passes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callboard.llm import workspace
from callboard.llm.blocks import starts, whole_runs

#: Nodes that become one.
FANOUT = 3
#: Levels, and nodes at most, of the subtree that is worked on as one run.
LEVELS = 5
SPAN = FANOUT**LEVELS


def row_digest(columns: Sequence[str | Column]) -> Column:
    """The leaf of a row as 32 bytes: SHA-256 over ``-`` for null, else UTF-8 byte count, ``:`` and the value, per column."""
    shown = []
    for c in columns:
        value = (F.col(c) if isinstance(c, str) else c).cast("string")
        shown.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*shown).cast("binary"), 256))


class Parent:
    """An inner node: its digest as hex, and for each child slot the hash state from before it and what follows."""

    __slots__ = ("digest", "others", "right", "states")

    def __init__(self, children: Sequence[bytes]):
        state, self.states = hashlib.sha256(), []
        for child in children:
            self.states.append(state.copy())
            state.update(child)
        self.digest = state.hexdigest().encode()
        self.right = [b"".join(children[i + 1 :]) for i in range(len(children))]
        self.others = [b"".join(children[:i]) + r for i, r in enumerate(self.right)]

    def fold(self, slot: int, replacement: bytes) -> bytes:
        """The digest with another child in ``slot``: the kept state, the replacement, the right siblings."""
        state = self.states[slot].copy()
        state.update(replacement + self.right[slot])
        return state.hexdigest().encode()


def subtree(nodes: Sequence[bytes], first: bool) -> list[list[Parent]]:
    """Levels of parents over a run of nodes. Only a ``first`` run may be all its group has and end early."""
    levels: list[list[Parent]] = []
    for _ in range(LEVELS):
        if first and len(nodes) == 1:
            break
        levels.append([Parent(nodes[i : i + FANOUT]) for i in range(0, len(nodes), FANOUT)])
        nodes = [p.digest for p in levels[-1]]
    return levels


def packed(levels: Sequence[Sequence[Parent]], place: int) -> bytes:
    """The way up from a node: per level its slot, the number of siblings, and their digests left to right."""
    out = []
    for level in levels:
        slot, others = place % FANOUT, level[place // FANOUT].others[place % FANOUT]
        out.append(bytes([slot, len(others) // 64]) + bytes.fromhex(others.decode()))
        place //= FANOUT
    return b"".join(out)


def unpacked(path: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """(slot, siblings) of every level of a packed way, siblings as hex."""
    at = 0
    while at < len(path):
        slot, count = path[at], path[at + 1]
        at += 2
        yield slot, [path[at + 32 * k : at + 32 * k + 32].hex().encode() for k in range(count)]
        at += 32 * count


def _hex(column: pa.ChunkedArray) -> list[bytes | None]:
    return [v if v is None else v.hex().encode() for v in column.to_pylist()]


# Places within a group ---------------------------------------------------------------


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition, the place within the group there, and whether it is the partition's first group."""
    part, last, place, head = TaskContext.get().partitionId(), None, 0, True
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        new = starts(table, ["g"])
        goes_on = last is not None and len(starts(pa.concat_tables([last, table.slice(0, 1).select(["g"])]), ["g"])) == 1
        run = np.zeros(batch.num_rows, np.int64)
        run[new[1:]] = 1
        run = np.cumsum(run)
        counted = np.arange(batch.num_rows) - new[run] + np.where(run == 0, place if goes_on else 0, 0)
        head = head and (last is None or goes_on)
        heads = (run == 0) & head
        head, place = bool(heads[-1]), int(counted[-1]) + 1
        last = table.slice(table.num_rows - 1).select(["g"])
        table = table.append_column("part", pa.array(np.full(batch.num_rows, part, np.int32)))
        table = table.append_column("place", pa.array(counted)).append_column("head", pa.array(heads))
        yield from table.to_batches()


def numbered(nodes: DataFrame, order: Sequence[str], path: str) -> DataFrame:
    """The nodes with ``pos``, their place within the group ``g`` in this order, kept as a table at ``path``.

    Rows are range-partitioned on group and order together, so a group may span any number
    of partitions. Only a partition's first group can have rows in earlier ones; how many is
    one number per partition, which bounds what is broadcast.
    """
    added = [T.StructField("part", T.IntegerType()), T.StructField("place", T.LongType()), T.StructField("head", T.BooleanType())]
    sorted_ = nodes.repartitionByRange("g", *order).sortWithinPartitions("g", *order)
    laid = workspace.written(sorted_.mapInArrow(_placed, T.StructType([*nodes.schema.fields, *added])), path)
    runs = laid.groupBy("g", "part").agg(F.count(F.lit(1)).alias("n"), F.bool_or("head").alias("head"))
    earlier = F.sum("n").over(Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    begun = runs.withColumn("before", earlier).where("head AND before > 0").select("part", "head", "before")
    joined = laid.join(F.broadcast(begun), ["part", "head"], "left")
    return joined.select(*nodes.columns, (F.col("place") + F.coalesce("before", F.lit(0))).alias("pos"))


# Up and down --------------------------------------------------------------------------


def _in_runs(nodes: DataFrame) -> DataFrame:
    return nodes.repartition("g", "run").sortWithinPartitions("g", "run", "pos")


def _up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table, at in whole_runs(batches, ["g", "run"]):
        nodes, run = _hex(table["digest"]), table["run"].to_numpy()[at].tolist()
        tops = []
        for begin, end, r in zip(at.tolist(), [*at[1:].tolist(), table.num_rows], run):
            levels = subtree(nodes[begin:end], r == 0)
            tops.append(bytes.fromhex((levels[-1][0].digest if levels else nodes[begin]).decode()))
        firsts = table["g"].take(pa.array(at)).combine_chunks()
        yield pa.RecordBatch.from_arrays([firsts, pa.array(run, pa.int64()), pa.array(tops, pa.binary())], ["g", "pos", "digest"])


def tree(nodes: DataFrame, path: str) -> list[DataFrame]:
    """``nodes`` (g, pos, digest) and the subtree digests above them, pass by pass, the last with one node a group."""
    passes = [nodes.select("g", "pos", "digest")]
    while (passes[-1].agg(F.max("pos")).first()[0] or 0) > 0:
        runs = _in_runs(passes[-1].withColumn("run", F.expr(f"pos div {SPAN}")))
        passes.append(workspace.written(runs.mapInArrow(_up, passes[-1].schema), f"{path}-{len(passes)}"))
    return passes


_WAY = "way binary, subroot binary, root binary"


def _under(nodes: DataFrame, ways: DataFrame, *payload: str) -> DataFrame:
    """The nodes in their runs, each run led by one row with the way up from it."""
    led = ways.withColumnRenamed("pos", "run").withColumn("pos", F.lit(-1).cast("bigint"))
    rows = nodes.select("g", F.expr(f"pos div {SPAN}").alias("run"), "pos", "digest", *payload)
    return _in_runs(rows.unionByName(led, allowMissingColumns=True))


def _down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table, at in whole_runs(batches, ["g", "run"]):
        nodes, run = _hex(table["digest"]), table["run"].to_numpy()[at].tolist()
        ways = table["way"].to_pylist()
        found, led = [], []
        for begin, end, r in zip(at.tolist(), [*at[1:].tolist(), table.num_rows], run):
            levels = subtree(nodes[begin + 1 : end], r == 0)
            found += [packed(levels, k) + ways[begin] for k in range(end - begin - 1)]
            led += [begin] * (end - begin - 1)
        inner = table.filter(pa.array(table["pos"].to_numpy() >= 0))
        heads = table.select(["subroot", "root"]).take(pa.array(led, pa.int64()))
        columns = [inner["g"], inner["pos"], pa.array(found, pa.binary()), heads["subroot"], heads["root"]]
        yield from pa.table(columns, ["g", "pos", "way", "subroot", "root"]).to_batches()


def ways_down(passes: Sequence[DataFrame], top: DataFrame) -> DataFrame:
    """(g, pos, way, subroot, root) for every subtree right above the leaves, from ``top``, which has it per group."""
    ways = top
    for nodes in reversed(passes[1:-1]):
        ways = _under(nodes, ways).mapInArrow(_down, ways.schema)
    return ways


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table, at in whole_runs(batches, ["g", "run"]):
        nodes, given = _hex(table["digest"]), _hex(table["given"])
        run, ways = table["run"].to_numpy()[at].tolist(), table["way"].to_pylist()
        subroots, roots = _hex(table["subroot"]), _hex(table["root"])
        out: list[list[str]] = [[], [], [], [], []]
        for begin, end, r in zip(at.tolist(), [*at[1:].tolist(), table.num_rows], run):
            levels = subtree(nodes[begin + 1 : end], r == 0)
            above = []
            for slot, siblings in unpacked(ways[begin]):
                above.append((slot, Parent([*siblings[:slot], b"", *siblings[slot:]])))
            beyond = b"".join(p.others[slot] for slot, p in above)
            for k in range(end - begin - 1):
                node, place, siblings = given[begin + 1 + k], k, []
                for level in levels:
                    parent, slot = level[place // FANOUT], place % FANOUT
                    siblings.append(parent.others[slot])
                    node, place = parent.fold(slot, node), place // FANOUT
                for slot, parent in above:
                    node = parent.fold(slot, node)
                proof = hashlib.sha256(b"".join(siblings) + beyond).hexdigest()
                for column, value in zip(out, (nodes[begin + 1 + k], subroots[begin], roots[begin], proof.encode(), node)):
                    column.append(value.decode())
        inner = table.filter(pa.array(table["pos"].to_numpy() >= 0))
        columns = [inner["row"], *[pa.array(c, pa.string()) for c in out]]
        yield from pa.table(columns, ["row", "leaf", "subroot", "root", "proof_sha256", "folded_root"]).to_batches()


@dataclass(frozen=True)
class Manifest:
    """Leaves (row, g, pos, digest, given), tree passes over each group, and the way from each group's subroot to the root."""

    leaves: DataFrame
    passes: list[DataFrame]
    top: DataFrame

    def roots(self) -> DataFrame:
        """(group, subroot, root), both as hex, one row per group."""
        return self.top.select(F.col("g").alias("group"), F.lower(F.hex("subroot")).alias("subroot"), F.lower(F.hex("root")).alias("root"))

    def verify(self) -> DataFrame:
        """Every row's kept columns, its proof, and the root folded from its given leaf (see ``build``).

        Adds ``leaf, subroot, root, proof_sha256, folded_root, verified`` in place of kept columns of these names.
        """
        kept = self.leaves.schema["row"]
        fields = [kept, *[T.StructField(n, T.StringType()) for n in ("leaf", "subroot", "root", "proof_sha256", "folded_root")]]
        under = _under(self.leaves, ways_down(self.passes, self.top), "given", "row")
        folded = under.mapInArrow(_folded, T.StructType(fields))
        results = [f.name for f in fields[1:]] + ["verified"]
        shown = [F.col("row").getField(n).alias(n) for n in kept.dataType.names if n not in results]
        return folded.select(*shown, *results[:-1], (F.col("folded_root") == F.col("root")).alias("verified"))


def build(
    rows: DataFrame,
    columns: Sequence[str],
    group: str,
    order: Sequence[str],
    keep: Sequence[str] = (),
    given: Mapping[str, Column] | None = None,
) -> Manifest:
    """The manifest of a table, its leaves and passes kept in the shared folder.

    ``columns`` make the leaf, ``keep`` come along (``order`` by default). ``given`` replaces
    columns by what was handed in for checking; ``Manifest.verify`` folds the leaf of that.
    Null is a value of its own in every column, and as a group it is the first; equal keys
    stand in the order of their leaves, repeated rows are leaves of their own; an empty table has no
    root and no rows. Other columns aren't read, so they may bear any name.
    """
    spark = rows.sparkSession
    base = workspace.folder(spark, "merkle")
    leaf = row_digest(columns)
    other = row_digest([given[c] if given and c in given else c for c in columns]) if given else leaf
    hashed = rows.select(
        F.struct(*(keep or order)).alias("row"), F.col(group).alias("g"), F.struct(*order).alias("k"), leaf.alias("digest"), other.alias("given")
    )
    # Written first: a range partitioning reads its input twice, and texts are read once.
    hashed = workspace.written(hashed, f"{base}/hashed")
    leaves = numbered(hashed, ["k", "digest", "given"], f"{base}/leaves")
    passes = tree(leaves, f"{base}/tree")
    subroots = passes[-1].select(F.lit(0).alias("g"), F.col("g").alias("group"), "digest")
    upper = numbered(subroots, ["group"], f"{base}/subroots")
    heads = tree(upper, f"{base}/top")
    root = heads[-1].select("g", "pos", F.lit(b"").alias("way"), F.lit(None).cast("binary").alias("subroot"), F.col("digest").alias("root"))
    ways = root if len(heads) == 1 else _under(heads[0], ways_down(heads, root)).mapInArrow(_down, root.schema)
    found = upper.select("pos", "group", "digest").join(ways.select("pos", "way", "root"), "pos")
    top = found.select(F.col("group").alias("g"), F.lit(0).cast("bigint").alias("pos"), "way", F.col("digest").alias("subroot"), "root")
    return Manifest(leaves, passes, workspace.written(top, f"{base}/ways"))
