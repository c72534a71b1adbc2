"""Connected components of an edge table by alternating large and small stars.

Every round rewires the edges of each node to the smallest node it knows: first those to
larger neighbours (large star), then those to smaller ones (small star). Both keep the
components and both are one aggregate and one join on whole tables. After a number of
rounds that grows with the logarithm of the longest path, each node hangs on the smallest
node of its component. A node with very many edges costs one partial aggregate and a join
whose hot partition AQE can split; no neighbour list is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callboard.llm import workspace
from callboard.operators import joins


def _stars(edges: DataFrame) -> DataFrame:
    """Large star: neighbours above ``u`` move to the smallest node around ``u``."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    large = joins.join_on(both.where("v > u"), least, {"u": "u"}, "inner", ["m"], spread=True)
    down = large.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    # Small star: all edges now lead down; they move to the smallest of them.
    floor = down.groupBy("u").agg(F.min("v").alias("m"))
    small = joins.join_on(down, floor, {"u": "u"}, "inner", ["m"], spread=True)
    moved = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
    return moved.where("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
    return row["n"], row["x"]


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the smallest node of its component for every node that isn't it itself.

    ``a`` and ``b`` are long columns. Loops, repeated and reversed edges and edges with a
    null end change nothing; an empty edge table gives an empty result. The rounds are
    written to the shared folder, each in place of the one before the last.
    """
    spark = edges.sparkSession
    base = workspace.folder(spark, "components")
    start = edges.select(F.col(a).cast("bigint").alias("u"), F.col(b).cast("bigint").alias("v")).where("u <> v")
    start = start.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    current = workspace.written(start, f"{base}/0")
    mark, turn = _mark(current), 0
    while mark[0]:
        turn += 1
        following = workspace.written(_stars(current), f"{base}/{turn}")
        now = _mark(following)
        workspace.drop(spark, f"{base}/{turn - 1}")
        current = following
        if now == mark:
            break
        mark = now
    return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
