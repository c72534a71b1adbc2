"""Near-duplicate vectors: exact pairs over a cosine threshold by cover-tree dual traversal.

Unit vectors with cosine c lie sqrt(2 - 2c) apart, so pairs over a threshold are pairs within
a radius. Equal vectors are brought together by one aggregate first and counted. The distinct
ones hang below a bounded number of centres, taken from the data by hash: the top level of
the tree, with the radius each centre covers. A centre with more vectors than a block holds is split by
further centres among its own, again taken by hash: the second level, of cells with radii of
their own. A cell's vectors are dealt into blocks of bounded size, however many it has. Pairs of
centres, and then of cells, that are further apart than both covering radii plus the link
radius are skipped before any vector moves.

Every block carries a cover tree, built once: nested levels whose radii halve, every node a
vector of the block, its children within the level's radius. For a pair of blocks that is
left, a task walks the two trees together. A pair of nodes is pruned where the distance of their vectors
exceeds both covering radii plus the link radius, else their children are paired; leaves are
compared exactly in double precision. A task reports how many vectors each vector links to
and a spanning forest of the links, never all pairs of a dense group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callboard.llm import components, workspace
from callboard.operators import joins

#: Centres of the top level at most, and bytes of their vectors at most.
CENTRES = 256
CENTRE_BYTES = 8 << 20
#: Vectors of a block, about.
BLOCK_ROWS = 4096
#: Cells of a centre at most, and bytes of the vectors of all cells at most, about.
CELLS = 64
CELL_BYTES = 64 << 20
#: Nodes with so few vectors are compared whole.
LEAF = 64
_SLACK = 1e-9


def _unit(lists: pa.Array) -> np.ndarray:
    """Rows of an array column of equal lengths, scaled to length 1 in double precision."""
    values = np.asarray(lists.flatten(), np.float64).reshape(len(lists), -1)
    scaled = values / np.abs(values).max(axis=1, keepdims=True)  # so that no square overflows
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


class Tree:
    """A cover tree over the rows of a block, as arrays.

    Node i has its vector ``centre[i]``, covers ``order[low[i]:high[i]]`` (itself too), the
    furthest of them ``radius[i]`` away, and has ``count[i]`` children from ``first[i]`` on.
    Node 0 is the root. A level is a power of two and at most half its parent node's radius.
    """

    FIELDS = (("centre", np.int32), ("low", np.int32), ("high", np.int32), ("first", np.int32), ("count", np.int32), ("radius", np.float64))

    def __init__(self, order: np.ndarray, **arrays: np.ndarray):
        self.order = order
        for name, _ in self.FIELDS:
            setattr(self, name, arrays[name])

    @classmethod
    def over(cls, points: np.ndarray) -> Tree:
        order = np.arange(len(points), dtype=np.int32)
        centre, low, high, first, count, radius = [0], [0], [len(points)], [0], [0], [0.0]
        pending = [(0, 2.0)]
        while pending:
            node, level = pending.pop()
            start, stop = low[node], high[node]
            if stop - start > 1:
                away = _distance(points[centre[node]][None, :], points[order[start:stop]])[0]
                radius[node] = float(away.max())
            if stop - start <= LEAF or radius[node] <= 1e-6:
                continue
            while level > radius[node] / 2:
                level /= 2
            # The node itself is its first child; each next one is a vector no child covers yet.
            rest, seat, place = order[start:stop].copy(), centre[node], start
            first[node] = len(centre)
            while len(rest):
                near = _distance(points[seat][None, :], points[rest])[0] <= level
                near[rest == seat] = True
                mine = rest[near]
                order[place : place + len(mine)] = mine
                for column, value in ((centre, seat), (low, place), (high, place + len(mine)), (first, 0), (count, 0), (radius, 0.0)):
                    column.append(value)
                pending.append((len(centre) - 1, level / 2))
                place += len(mine)
                rest = rest[~near]
                if len(rest):
                    seat = int(rest[0])
            count[node] = len(centre) - first[node]
        values = {"centre": centre, "low": low, "high": high, "first": first, "count": count, "radius": radius}
        return cls(order, **{name: np.array(values[name], kind) for name, kind in cls.FIELDS})

    def packed(self) -> bytes:
        head = np.array([len(self.order), len(self.centre)], np.int64).tobytes()
        return head + self.order.tobytes() + b"".join(getattr(self, name).tobytes() for name, _ in self.FIELDS)

    @classmethod
    def unpacked(cls, data: bytes) -> Tree:
        rows, nodes = np.frombuffer(data, np.int64, 2)
        order, at = np.frombuffer(data, np.int32, rows, 16), 16 + 4 * int(rows)
        arrays = {}
        for name, kind in cls.FIELDS:
            arrays[name] = np.frombuffer(data[at : at + int(nodes) * np.dtype(kind).itemsize], kind)
            at += arrays[name].nbytes
        return cls(order, **arrays)

    def members(self, node: int) -> np.ndarray:
        return self.order[self.low[node] : self.high[node]]

    def below(self, node: int) -> np.ndarray:
        """The node's children, or the node where it has none."""
        return np.arange(self.first[node], self.first[node] + self.count[node]) if self.count[node] else np.array([node])


class Links:
    """What a dual traversal finds between two blocks: link counts and a spanning forest."""

    def __init__(self, a: np.ndarray, b: np.ndarray, weight_a: np.ndarray, weight_b: np.ndarray, same: bool, threshold: float):
        self.a, self.b, self.same, self.threshold = a, b, same, threshold
        self.weight_a, self.weight_b = weight_a, weight_b
        self.count_a, self.count_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        self.group = np.arange(len(b))
        self.edges: list[tuple[int, int]] = []
        self.reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + _SLACK
        self.rough_a = a.astype(np.float32)
        self.rough_b = self.rough_a if same else b.astype(np.float32)

    def _leaves(self, mine: np.ndarray, theirs: np.ndarray, within: bool) -> None:
        """Compare all of ``mine`` with all of ``theirs``; ``within``: both are one leaf."""
        close = self.a[mine] @ self.b[theirs].T >= self.threshold
        if within:
            close &= mine[:, None] < theirs[None, :]
        if not close.any():
            return
        np.add.at(self.count_a, mine, close @ self.weight_b[theirs])
        np.add.at(self.count_b, theirs, self.weight_a[mine] @ close)
        for i in np.flatnonzero(close.any(axis=1)):
            hits = theirs[close[i]]
            if self.same:
                hits = np.r_[mine[i], hits]
            met, seat = np.unique(self.group[hits], return_index=True)
            if self.same and len(met) == 1:
                continue
            self.edges += [(int(mine[i]), int(hits[j])) for j in seat if not self.same or hits[j] != mine[i]]
            if len(met) > 1:
                self.group[np.isin(self.group, met)] = met[0]

    def walk(self, left: Tree, right: Tree) -> None:
        """Pair nodes from the roots down; pairs out of reach are pruned with all below them."""
        pending = [(0, 0)]
        while pending:
            x, y = pending.pop()
            itself = self.same and x == y
            if not left.count[x] and not right.count[y]:
                self._leaves(left.members(x), right.members(y), itself)
                continue
            # Descend on the wider node, or on both where both are of like width.
            wide_x, wide_y = left.radius[x], right.radius[y]
            mine = left.below(x) if itself or not right.count[y] or wide_x >= wide_y / 2 else np.array([x])
            theirs = right.below(y) if itself or not left.count[x] or wide_y >= wide_x / 2 else np.array([y])
            for i, near in self._near(left, right, mine, theirs, itself):
                leaf = right.count[near] == 0 if not left.count[i] else np.zeros(len(near), bool)
                if self.same:
                    leaf &= near != i
                if leaf.any():  # one leaf against all its near ones at once
                    self._leaves(left.members(i), np.concatenate([right.members(j) for j in near[leaf]]), False)
                pending += [(int(i), int(j)) for j in near[~leaf]]

    def _near(self, left: Tree, right: Tree, mine: np.ndarray, theirs: np.ndarray, upper: bool) -> Iterator[tuple[int, np.ndarray]]:
        """For every node of ``mine`` those of ``theirs`` within reach; ``upper``: each pair once.

        Single precision with room for its error decides what is pruned; two unit vectors are
        within r of each other where their cosine is at least 1 - r * r / 2.
        """
        # Single vectors, most of a scattered block, are apart from wider nodes: their reach is short.
        for some in _by_width(left, mine):
            for others in _by_width(right, theirs):
                yield from self._close(left, right, some, others, upper)

    def _close(self, left: Tree, right: Tree, mine: np.ndarray, theirs: np.ndarray, upper: bool) -> Iterator[tuple[int, np.ndarray]]:
        ours = self.rough_b[right.centre[theirs]]
        wide = right.radius[theirs]
        step = max(1, (1 << 20) // len(theirs))
        for at in range(0, len(mine), step):
            part = mine[at : at + step]
            reach = left.radius[part].max() + wide.max() + self.reach
            cosines = self.rough_a[left.centre[part]] @ ours.T
            close = cosines >= np.float32(1 - reach * reach / 2 - 1e-5)
            if not close.any():
                continue
            rows, columns = np.nonzero(close)
            exact = left.radius[part[rows]] + wide[columns] + self.reach
            good = cosines[rows, columns] >= 1 - exact * exact / 2 - 1e-5
            if upper:
                good &= part[rows] <= theirs[columns]
            rows, columns = rows[good], columns[good]
            cuts = np.flatnonzero(np.r_[True, np.diff(rows) > 0, True]) if len(rows) else [0]
            for low, high in zip(cuts, cuts[1:]):
                yield int(part[rows[low]]), theirs[columns[low:high]]


def _by_width(tree: Tree, nodes: np.ndarray) -> list[np.ndarray]:
    single = tree.radius[nodes] == 0
    return [part for part in (nodes[single], nodes[~single]) if len(part)]


def _assign(centres: np.ndarray):
    """To each vector its nearest centre and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            away = _distance(_unit(batch.column(1)), centres) if len(batch) else np.zeros((0, 1))
            best = away.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best.astype(np.int32)), pa.array(away[np.arange(len(best)), best])], ["id", "v", "n", "centre", "away"])

    return run


def _settle(cells: np.ndarray, first: np.ndarray):
    """To each vector the nearest cell of its centre, cells first[c] to first[c + 1], and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _unit(batch.column(1)) if len(batch) else np.zeros((0, cells.shape[1]))
            centre = batch.column(3).to_numpy()
            cell, away = np.zeros(len(batch), np.int32), np.zeros(len(batch))
            for c in np.unique(centre).tolist():
                mine = np.flatnonzero(centre == c)
                far = _distance(points[mine], cells[first[c] : first[c + 1]])
                cell[mine], away[mine] = first[c] + far.argmin(axis=1), far.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(cell), pa.array(away)], ["id", "v", "n", "centre", "away"])

    return run


def _close(cells: np.ndarray, first: np.ndarray, radius: np.ndarray, reach: float):
    """Pairs of cells, of pairs of centres, that can hold a link; empty cells have radius -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = slice(first[i], first[i + 1]), slice(first[j], first[j + 1])
                near = _distance(cells[a], cells[b]) <= radius[a, None] + radius[None, b] + reach
                near &= (radius[a, None] >= 0) & (radius[None, b] >= 0)
                left, right = np.nonzero(np.triu(near) if i == j else near)
                yield pa.RecordBatch.from_arrays([pa.array((x + y).astype(np.int32)) for x, y in ((left, first[i]), (right, first[j]))], ["centre_a", "centre_b"])

    return run


def _blocks(table: pa.Table) -> pa.Table:
    """One row for the block that a group of vectors is: ids, weights and values side by side."""
    rows = table.num_rows
    values = np.asarray(table.column("v").combine_chunks().flatten(), np.float32)
    columns = {
        "centre": pa.array([table.column("centre")[0].as_py()], pa.int32()),
        "part": pa.array([table.column("part")[0].as_py()], pa.int32()),
        "rows": pa.array([rows], pa.int32()),
        "ids": pa.array([np.asarray(table.column("id"), np.int64).tobytes()], pa.binary()),
        "weights": pa.array([np.asarray(table.column("n"), np.int64).tobytes()], pa.binary()),
        "values": pa.array([values.tobytes()], pa.binary()),
        "tree": pa.array([Tree.over(_unit(table.column("v").combine_chunks())).packed()], pa.binary()),
        "away": pa.array([float(np.max(np.asarray(table.column("away"))))], pa.float64()),
    }
    return pa.table(columns)


_BLOCK_DDL = "centre int, part int, rows int, ids binary, weights binary, values binary, tree binary, away double"


def _compare(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                same = batch.column("same")[row].as_py()
                read = lambda name, kind: np.frombuffer(batch.column(name)[row].as_py(), kind)
                side = {}
                for s in "a" if same else "ab":
                    ids = read(f"ids_{s}", np.int64)
                    values = read(f"values_{s}", np.float32).astype(np.float64).reshape(len(ids), -1)
                    values = values / np.abs(values).max(axis=1, keepdims=True)
                    points = values / np.linalg.norm(values, axis=1, keepdims=True)
                    side[s] = ids, read(f"weights_{s}", np.int64), points, Tree.unpacked(batch.column(f"tree_{s}")[row].as_py())
                (ids_a, weight_a, a, left), (ids_b, weight_b, b, right) = side["a"], side.get("b", side["a"])
                links = Links(a, b, weight_a, weight_b, same, threshold)
                links.walk(left, right)
                ends = [(int(ids_a[i]), int(ids_b[j]), 0) for i, j in links.edges]
                for ids, counts in ((ids_a, links.count_a), (ids_b, links.count_b)):
                    ends += [(int(ids[i]), None, int(counts[i])) for i in np.flatnonzero(counts)]
                yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in ends], pa.int64()) for k in range(3)], ["a", "b", "n"])

    return run


def _cells(placed: DataFrame, centres: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, dict[int, float]]:
    """The cells' vectors, where each centre's begin, and each used centre's radius.

    Of a centre's vectors about as many are taken as it needs blocks, twice over, by a bound on
    their hash; so what the driver gets is ``CELLS`` times ``CENTRES`` vectors at most, give or take chance.
    """
    found = placed.groupBy("centre").agg(F.count(F.lit(1)).alias("rows"), F.max("away").alias("away")).collect()  # one row per centre
    most = max(1, min(CELLS, CELL_BYTES // (8 * size * len(centres))))
    steps, share = 1 << 40, F.lit(0)
    for row in found:
        wanted = min(most, 2 * (row["rows"] // BLOCK_ROWS))
        if wanted > 1:
            share = F.when(F.col("centre") == row["centre"], F.lit(steps * wanted // row["rows"])).otherwise(share)
    taken = placed.where(F.pmod(F.xxhash64("v", F.lit("cell")), F.lit(steps)) < share).select("centre", "v").toArrow()
    of = taken["centre"].to_numpy()
    points = _unit(taken["v"].combine_chunks()) if len(of) else np.zeros((0, centres.shape[1]))
    cells, first = [], [0]
    for c in range(len(centres)):
        mine = points[of == c]
        cells.append(mine if len(mine) else centres[c : c + 1])
        first.append(first[-1] + len(cells[-1]))
    return np.concatenate(cells), np.array(first), {r["centre"]: r["away"] for r in found}


_PARTS = ("ids", "weights", "values", "tree")


def _block_pairs(distinct: DataFrame, size: int, rows: int, threshold: float, base: str) -> tuple[DataFrame, DataFrame]:
    """Blocks of the distinct vectors of one dimension, and the pairs of blocks that can hold a link."""
    spark = distinct.sparkSession
    most = max(1, min(CENTRES, CENTRE_BYTES // (8 * size), rows // BLOCK_ROWS + 1))
    picked = distinct.orderBy(F.xxhash64("v"), "id").limit(most).select("v").toArrow()["v"].combine_chunks()
    centres = _unit(picked)
    placed = distinct.mapInArrow(_assign(centres), "id bigint, v array<float>, n bigint, centre int, away double")
    placed = workspace.written(placed, f"{base}/placed")
    cells, first, far = _cells(placed, centres, size)
    settled = placed.mapInArrow(_settle(cells, first), "id bigint, v array<float>, n bigint, centre int, away double")
    settled = workspace.written(settled, f"{base}/settled")
    sizes = settled.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_ROWS)).cast("int").alias("parts"))
    dealt = settled.join(F.broadcast(sizes), "centre")  # one row per cell
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts").cast("bigint")).cast("int"))
    blocks = dealt.select("centre", "part", "id", "v", "n", "away").groupBy("centre", "part").applyInArrow(_blocks, _BLOCK_DDL)
    blocks = workspace.written(blocks, f"{base}/blocks")
    radius = np.full(len(cells), -1.0)
    for row in blocks.groupBy("centre").agg(F.max("away").alias("away")).collect():  # one row per cell
        radius[row["centre"]] = row["away"]
    apart = _distance(centres, centres)
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + _SLACK
    near = [(i, j) for i in far for j in far if i <= j and apart[i, j] <= far[i] + far[j] + reach]
    count = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    wanted = spark.createDataFrame(near, "a int, b int").repartition(min(count, len(near)), "a", "b")  # at most CENTRES squared
    wanted = workspace.written(wanted.mapInArrow(_close(cells, first, radius, reach), "centre_a int, centre_b int"), f"{base}/near")
    marks = blocks.select("centre", "part", "away")
    left = marks.select(F.col("centre").alias("centre_a"), F.col("part").alias("part_a"))
    right = marks.select(F.col("centre").alias("centre_b"), F.col("part").alias("part_b"))
    return blocks, left.join(wanted, "centre_a").join(right, "centre_b").where("centre_a <> centre_b OR part_a <= part_b")


def _links(distinct: DataFrame, size: int, rows: int, threshold: float, base: str) -> DataFrame:
    """(a, b, n) over distinct vectors of one dimension: forest edges, and counts where b is null."""
    blocks, pairs = _block_pairs(distinct, size, rows, threshold, base)
    count = max(1, int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pairs = pairs.repartition(count, "centre_a", "part_a", "centre_b", "part_b")
    for s in "ab":
        full = blocks.select("centre", "part", *[F.col(c).alias(f"{c}_{s}") for c in _PARTS])
        pairs = joins.join_on(pairs, full, {f"centre_{s}": "centre", f"part_{s}": "part"}, "inner", [f"{c}_{s}" for c in _PARTS], spread=True)
    same = (F.col("centre_a") == F.col("centre_b")) & (F.col("part_a") == F.col("part_b"))
    named = [f"{c}_{s}" for s in "ab" for c in _PARTS]
    return pairs.select(same.alias("same"), *named).mapInArrow(_compare(threshold), "a bigint, b bigint, n bigint")


def near_duplicates(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """One row per vector: key, ``n_links``, ``component_id``, ``kept``.

    ``n_links`` counts the other rows linked directly, copies included; ``component_id`` is
    the smallest key reachable, itself included; ``kept`` says that it is the row's own.
    Null, empty and zero vectors and ones with null or non-finite components link with
    nothing, as do vectors of different dimensions. Rows that repeat a key are rows of their
    own and link like any others; a null key stands for itself alone unless its class has a
    key. An empty table gives no rows. Components are single precision, as tables have them.
    """
    spark = rows.sparkSession
    base = workspace.folder(spark, "covertree")
    v = F.col(vector).cast("array<float>")
    good = F.exists(v, lambda x: x != 0) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    marked = rows.select(F.col(key).cast("bigint").alias("key"), F.when(F.coalesce(good, F.lit(False)), v).alias("v"))
    zero = F.transform("v", lambda x: x + F.lit(0).cast("float"))  # -0.0 and 0.0 are one
    marked = marked.withColumn("v", zero).withColumn("h", F.xxhash64("v"))
    classes = marked.where("v IS NOT NULL").groupBy("h", "v").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("n"))
    # Classes get ids of their own: keys may repeat or be null.
    classes = classes.select("h", "v", "least", "n", F.monotonically_increasing_id().alias("id"))
    classes = workspace.written(classes, f"{base}/classes")
    found = None
    for row in classes.groupBy(F.size("v").alias("size")).count().orderBy("size").collect():  # one row per dimension
        distinct = classes.where(F.size("v") == row["size"]).select("id", "v", "n")
        part = _links(distinct, row["size"], row["count"], threshold, f"{base}/{row['size']}")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "a bigint, b bigint, n bigint")
    found = workspace.written(found, f"{base}/links")
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("linked"))
    hung = components.connected(found.where("b IS NOT NULL"), "a", "b")
    known = joins.lookup(classes.select("id", "h", "v", "least", "n"), counts, {"id": "id"}, ["linked"])
    known = joins.lookup(known, hung, {"id": "node"}, ["root"]).withColumn("root", F.coalesce("root", "id"))
    smallest = known.groupBy("root").agg(F.min("least").alias("component"))
    known = joins.lookup(known, smallest, {"root": "root"}, ["component"], spread=True)
    known = known.select("h", F.col("v").alias("w"), F.col("component"), (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    out = marked.join(known.withColumnRenamed("h", "g"), (F.col("h") == F.col("g")) & (F.col("v") == F.col("w")), "left")
    component = F.coalesce("component", "key")
    return out.select(
        F.col("key").alias(key),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        component.eqNullSafe(F.col("key")).alias("kept"),
    )
