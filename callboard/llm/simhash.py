"""SimHash near-duplicates: exact links between fingerprints, compared tile against tile.

A document's words are its runs of bytes other than ASCII white space, after A-Z are
lower-cased; its shingles are all runs of ``width`` words joined by one space (with fewer
words the whole sequence, with none no shingle). Bit i of the fingerprint is 1 where over
half of the shingles' XXH64 values (seed 42) have it.

Equal fingerprints are brought together by one aggregate first. The distinct ones are cut
into tiles by the population counts of the four 16-bit quarters: two words that differ in
at most ``radius`` bits have counts whose differences add up to at most ``radius``, so any
other pair of tiles is skipped. Tiles are keyed by the counts of two quarters and, where a
key holds many fingerprints, dealt out further by hash, so no tile grows with the input.
Inside a tile pair the other two counts skip once more, then numpy takes the exclusive-or
and counts bits. A tile pair reports a spanning forest of its links, never all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callboard.llm import components, workspace
from callboard.llm.blocks import free_names
from callboard.operators import joins

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
TILE = 8192
_PIECE = 1 << 16


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The SimHash of one text as an unsigned number; 0 without words or text."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    count = max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    stops = ends[-count:].tolist()
    starts = [0, *(ends[: count - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, count, _PIECE):
        part = [digest(joined[s:e], seed) for s, e in zip(starts[at : at + _PIECE], stops[at : at + _PIECE])]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > count, bitorder="little").view("<u8")[0])


def _fingerprints(width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), width, seed) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), *batch.columns[2:]], ["id", "fp", *batch.schema.names[2:]])

    return run


def with_fingerprints(docs: DataFrame, key: str, text: str, width: int = 3, seed: int = 42, digest: str | None = None) -> DataFrame:
    """(id, fp): the key of every row and its fingerprint as a signed 64-bit number; also the column ``digest``."""
    kind = docs.schema[key].dataType.simpleString()
    more = [digest] if digest else []
    return docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"), *more).mapInArrow(
        _fingerprints(width, seed), f"id {kind}, fp bigint" + "".join(f", {c} bigint" for c in more)
    )


def _counts(values: np.ndarray) -> np.ndarray:
    """Population counts of the four 16-bit quarters, one row per word."""
    return np.bitwise_count(values.view("<u2").reshape(-1, 4)).astype(np.int16)


def forest(left: np.ndarray, right: np.ndarray, same: bool, radius: int) -> list[tuple[int, int]]:
    """Links within ``radius`` bits between two tiles of 64-bit words, as a spanning forest.

    ``same`` says that both are one tile. Words are compared in blocks of equal quarter
    counts; blocks whose counts are too far apart are skipped.
    """
    if not len(left) or not len(right):
        return []
    left, right = (x[np.lexsort(_counts(x).T)] for x in (left, right))
    mine, theirs = _counts(left), _counts(right)
    cuts = np.flatnonzero(np.r_[True, (mine[1:] != mine[:-1]).any(axis=1), True])
    group = np.arange(len(right))
    edges: list[tuple[int, int]] = []
    blocks = range(len(cuts) - 1) if len(left) * len(right) > 1 << 20 else [None]
    for block in blocks:
        if block is None:
            low, high, near = 0, len(left), np.arange(len(right))
        else:
            low, high = cuts[block], cuts[block + 1]
            near = np.flatnonzero(np.abs(theirs - mine[low]).sum(axis=1) <= radius)
        step = max(1, (1 << 20) // max(1, len(near)))
        for at in range(low, high, step):
            rows = left[at : min(at + step, high)]
            close = np.bitwise_count(rows[:, None] ^ right[near][None, :]) <= radius
            if same:
                close &= near[None, :] > np.arange(at, at + len(rows))[:, None]
            for i in np.flatnonzero(close.any(axis=1)):
                hits = near[close[i]]
                if same:
                    hits = np.r_[at + i, hits]
                met, first = np.unique(group[hits], return_index=True)
                word = int(rows[i])
                edges += [(word, int(right[hits[j]])) for j in first if int(right[hits[j]]) != word]
                if len(met) > 1:
                    group[np.isin(group, met)] = met[0]
    return edges


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for same, left, right in zip(*(batch.column(k) for k in range(3))):
                a, b = (np.asarray(x.values).view(np.uint64) for x in (left, right))
                found += forest(a, b, same.as_py(), radius)
            ends = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

    return run


def _quarter(at: int) -> Column:
    return F.expr(f"bit_count(shiftrightunsigned(fp, {16 * at}) & 65535L)").cast("int")


def links(distinct: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """(a, b): a spanning forest of all links between distinct fingerprints ``fp``.

    At most 17 x 17 keys of quarter counts exist, so the directory of keys and the pairs of
    neighbouring keys are small by construction whatever the input.
    """
    keyed = distinct.select("fp", (_quarter(0) * 17 + _quarter(1)).alias("cell"))
    sizes = keyed.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("parts"))
    dealt = keyed.join(F.broadcast(sizes), "cell").select(
        "cell", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("parts").cast("bigint")).cast("int").alias("part"), "fp"
    )
    base = workspace.folder(distinct.sparkSession, "tiles")
    tiles = workspace.written(dealt.groupBy("cell", "part").agg(F.collect_list("fp").alias("words")), base)
    marks = tiles.select("cell", "part")
    near = [(x, y) for x in range(-radius, radius + 1) for y in range(-radius, radius + 1) if abs(x) + abs(y) <= radius and (x, y) >= (0, 0)]
    steps = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in near])
    other = marks.select("cell", "part", F.explode(steps).alias("s")).where(
        (F.col("cell") % 17 + F.col("s.y")).between(0, 16)
    )
    other = other.select("cell", "part", (F.col("cell") + F.col("s.x") * 17 + F.col("s.y")).alias("cell2"))
    right = marks.select(F.col("cell").alias("cell2"), F.col("part").alias("part2"))
    pairs = other.join(right, "cell2").where("cell <> cell2 OR part <= part2")
    count = max(1, int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pairs = pairs.repartition(count, "cell", "part", "cell2", "part2")
    left = tiles.select("cell", "part", F.col("words").alias("a"))
    found = joins.join_on(pairs, left, {"cell": "cell", "part": "part"}, "inner", ["a"], spread=True)
    right = tiles.select("cell", "part", F.col("words").alias("b"))
    found = joins.join_on(found, right, {"cell2": "cell", "part2": "part"}, "inner", ["b"], spread=True)
    same = (F.col("cell") == F.col("cell2")) & (F.col("part") == F.col("part2"))
    return found.select(same.alias("same"), "a", "b").mapInArrow(_compare(radius), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """One row per document: key, ``fingerprint`` (16 hex digits) and ``component_id``.

    ``component_id`` is the smallest key reachable over links of at most ``radius`` bits.
    Null and word-less texts have fingerprint zero and link like any other; rows with equal
    text share a class; a null key is never the smallest unless its class has no other;
    repeated keys give repeated rows; an empty table gives no rows.
    """
    out = _components(docs, key, text, width, radius)
    return out.select(F.col("id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _components(docs: DataFrame, key: str, text: str, width: int, radius: int, digest: str | None = None) -> DataFrame:
    """What ``with_fingerprints`` gives, with ``component_id``."""
    spark = docs.sparkSession
    base = workspace.folder(spark, "simhash")
    marked = workspace.written(with_fingerprints(docs, key, text, width, digest=digest), f"{base}/marked")
    distinct = workspace.written(marked.groupBy("fp").agg(F.min("id").alias("least")), f"{base}/distinct")
    hung = components.connected(links(distinct, radius), "a", "b")
    rooted = joins.lookup(distinct, hung, {"fp": "node"}, ["root"]).withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = joins.lookup(rooted, smallest, {"root": "root"}, ["component_id"], spread=True)
    return joins.lookup(marked, named, {"fp": "fp"}, ["component_id"], spread=True)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """The documents that bear their component's smallest key; all columns stay.

    Rows go by key and text, so of rows that share a key those with other texts are judged
    by their own components; rows that repeat the kept key stay with it.
    """
    (digest,) = free_names([*docs.columns, "id", "fp", "component_id"], "digest_")
    hashed = docs.withColumn(digest, F.xxhash64(F.col(text).cast("string")))
    found = _components(hashed, key, text, width, radius, digest)
    gone = found.where(F.col("id") != F.col("component_id")).select("id", digest).distinct()
    return joins.without_match(hashed, gone, {key: "id", digest: digest}, spread=True).select(*docs.columns)
