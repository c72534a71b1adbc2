"""Benchmark decontamination by Wu-Manber multi-pattern search.

The words of a text are its runs of ASCII letters, digits and bytes above 127, with A-Z
lower-cased. A benchmark item gives every window of ``width`` consecutive words, an item
with fewer words one window of all. Normalised, a text is its words with one space before,
between and after, so a window occurs exactly where its normalised bytes do.

Windows are cut into blocks of a bounded size by their hash. Spark writes the blocks to the
shared folder and hands them to the executors as files; a task holds the tables of one block
at a time, so neither the driver nor a task ever holds a whole benchmark. Where there are several
blocks, a task holds ``HELD`` bytes of text and takes each block past all of it. For each block:

* windows of like length share a shift table, keyed by the hash of the ``BLOCK`` bytes that
  end at a position: how far the search may jump because no window can end sooner;
* where the shift is 0, a bucket keyed by a hash of the suffix that all windows of the group
  are long enough for, 64 bytes and more for most, selects lengths of windows, and a hash of that many bytes
  the windows themselves: so thousands of windows that end alike cost a look-up each, not a comparison;
* a direct comparison of all bytes confirms each occurrence.

Hashes of any stretch of a buffer come from one running sum over it, modulo 2**64.

A batch's texts stand in one buffer. It is cut into lanes whose positions jump together as
numpy arrays; a lane reports the occurrences that end in it and may look back before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callboard.llm import workspace
from callboard.llm.blocks import free_names

#: Bytes of window text in one block of patterns at most, about.
BLOCK_BYTES = 16 << 20
#: Bytes that the shift tables look at.
BLOCK = 4
_BITS = 18
#: Bytes of normalised text searched together.
PART = 1 << 20
#: Bytes of normalised text that wait for all blocks of patterns.
HELD = 48 << 20
_LANES = 2048

_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256)
)


def normalised(text: str | None) -> bytes:
    """The words with one space before, between and after; b"" without words."""
    words = (text or "").encode().translate(_TABLE).split()
    return b" " + b" ".join(words) + b" " if words else b""


class Patterns:
    """Shift and bucket tables of one block of normalised windows, and the items of each."""

    def __init__(self, windows: list[bytes], items: list[list[str]]):
        self.windows, self.items = windows, items
        self.groups = []
        sizes = np.array([len(w) for w in windows], np.int64)
        low = 0
        for high in (8, 16, 32, 64, 128, 1 << 62):
            chosen = np.flatnonzero((sizes >= low) & (sizes < high))
            if len(chosen):
                self.groups.append(_Group([windows[i] for i in chosen.tolist()], chosen))
            low = high

    def search(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ends (exclusive) and pattern numbers of all occurrences in a buffer."""
        buffer = np.frombuffer(text, np.uint8)
        sums = _Sums(buffer)
        found = [g.search(text, buffer, sums) for g in self.groups]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


#: An odd number and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Sums:
    """Hashes of stretches of a buffer: the sum of byte * base**-place, moved to place 0."""

    def __init__(self, buffer: np.ndarray):
        factors = np.full(len(buffer), _INVERSE, np.uint64)
        if len(factors):
            factors[0] = 1
        weights = np.cumprod(factors)
        weights *= buffer.astype(np.uint64) + np.uint64(1)
        self.sums = np.zeros(len(buffer) + 1, np.uint64)
        np.cumsum(weights, out=self.sums[1:])
        factors[1:] = _BASE
        self.back = np.cumprod(factors, out=factors)

    def hashes(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.back[start]


def _mixed(value: np.ndarray, bits: int) -> np.ndarray:
    return ((value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def _ending(buffer: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` bytes that end at each position, as one number."""
    value = np.zeros(len(at), np.uint64)
    for k in range(size):
        value = (value << np.uint64(8)) | buffer[at - (size - 1 - k)]
    return value


class _Group:
    """Windows of like length under one shift table."""

    def __init__(self, windows: list[bytes], numbers: np.ndarray):
        self.windows, self.numbers = windows, numbers
        self.least = min(map(len, windows))
        self.block = min(BLOCK, self.least)
        text = np.frombuffer(b"".join(windows), np.uint8)
        stops = np.cumsum([len(w) for w in windows])
        starts = stops - np.array([len(w) for w in windows])
        widest = self.least - self.block + 1
        self.shift = np.full(1 << _BITS, widest, np.int32)
        # A window's tail of ``least`` bytes decides: all windows of the group end within reach.
        for back in range(widest - 1, -1, -1):
            slot = _mixed(_ending(text, stops - 1 - back, self.block), _BITS)
            self.shift[slot] = np.minimum(self.shift[slot], back)
        self.sizes = stops - starts
        sums = _Sums(text)
        tail, whole = sums.hashes(stops - self.least, stops), sums.hashes(starts, stops)
        # Buckets by suffix hold the lengths of their windows; buckets by whole hash the windows.
        pairs = np.unique(np.rec.fromarrays([tail, self.sizes], names="tail,size"))
        self.suffixes, first = np.unique(pairs["tail"], return_index=True)
        self.length_at, self.length = np.r_[first, len(pairs)], pairs["size"].astype(np.int64)
        self.bucket = np.argsort(whole, kind="stable")
        self.wholes, first = np.unique(whole[self.bucket], return_index=True)
        self.bucket_at = np.r_[first, len(windows)]

    def search(self, text: bytes, buffer: np.ndarray, sums: _Sums) -> tuple[np.ndarray, np.ndarray]:
        first = self.least - 1
        if len(buffer) <= first:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lanes = min(_LANES, max(1, (len(buffer) - first) // 64))
        edges = np.linspace(first, len(buffer), lanes + 1).astype(np.int64)
        at, stop = edges[:-1].copy(), edges[1:].copy()
        ends, hits = [], []
        while True:
            going = at < stop
            if not going.all():
                at, stop = at[going], stop[going]
                if not len(at):
                    break
            shift = self.shift[_mixed(_ending(buffer, at, self.block), _BITS)]
            stand = at[shift == 0] + 1
            if len(stand):
                slot, good = _found(self.suffixes, sums.hashes(stand - self.least, stand))
                stand, slot = stand[good], slot[good]
                count = self.length_at[slot + 1] - self.length_at[slot]
                end = np.repeat(stand, count)
                size = self.length[np.arange(len(end)) + np.repeat(self.length_at[slot] - (np.cumsum(count) - count), count)]
                end, size = end[end >= size], size[end >= size]
                slot, good = _found(self.wholes, sums.hashes(end - size, end))
                for e, k in zip(end[good].tolist(), slot[good].tolist()):
                    for i in self.bucket[self.bucket_at[k] : self.bucket_at[k + 1]].tolist():
                        if e >= self.sizes[i] and text.endswith(self.windows[i], 0, e):
                            ends.append(e)
                            hits.append(int(self.numbers[i]))
            at = at + np.maximum(shift, 1)
        return np.array(ends, np.int64), np.array(hits, np.int64)


def _found(known: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the asked values among the known ascending ones, and which of them are there."""
    place = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    return place, np.flatnonzero(known[place] == asked)


@lru_cache(maxsize=1)
def _block(name: str) -> Patterns:
    table = pq.read_table(SparkFiles.get(name))
    return Patterns([w.encode() for w in table["window"].to_pylist()], table["items"].to_pylist())


def windows(items: DataFrame, key: str = "item_id", text: str = "text", width: int = 13) -> DataFrame:
    """(window, item): every normalised window of every item, with native functions.

    Null and word-less items have no window; equal windows stay with each of their items.
    """
    plain = F.regexp_replace(
        F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "
    )
    words = F.filter(F.split(plain, " "), lambda w: w != "")
    listed = items.select(F.col(key).cast("string").alias("item"), words.alias("words")).where("size(words) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - width + 1, F.lit(1)))
    cut = F.transform(starts, lambda i: F.concat(F.lit(" "), F.array_join(F.slice("words", i, width), " "), F.lit(" ")))
    return listed.select("item", F.explode(cut).alias("window"))


def publish(items: DataFrame, key: str = "item_id", text: str = "text", width: int = 13) -> list[str]:
    """Write the benchmark's windows in blocks, one file each, and hand these to all executors.

    Returns the files' names in the session. The driver learns the number of bytes and no window.
    """
    spark = items.sparkSession
    found = windows(items, key, text, width)
    base = workspace.folder(spark, "windows")
    kept = workspace.written(
        found.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items")), f"{base}/all"
    )
    size = kept.agg(F.sum(F.octet_length("window") + F.octet_length(F.array_join("items", ",")))).first()[0] or 0
    blocks = size // BLOCK_BYTES + 1
    dealt = kept.withColumn("block", F.pmod(F.xxhash64("window"), F.lit(blocks)).cast("int"))
    dealt.repartition(blocks, "block").write.partitionBy("block").parquet(f"{base}/blocks")
    name = base.rsplit("/", 1)[1]
    files = workspace.named(spark, f"{base}/blocks", ".parquet", lambda k: f"{base}/{name}-{k}.parquet")
    for file in files:
        spark.sparkContext.addFile(file)
    return [file.rsplit("/", 1)[1] for file in files]


class _Part:
    """Normalised texts in one buffer, with what was found in each so far."""

    def __init__(self, texts: list[bytes]):
        self.starts = np.cumsum([0, *map(len, texts)])
        self.whole = b"".join(texts)
        self.spaces = np.flatnonzero(np.frombuffer(self.whole, np.uint8) == 32)
        self.words = [max(0, t.count(b" ") - 1) for t in texts]
        self.spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        self.items: list[set[str]] = [set() for _ in texts]

    def judge(self, patterns: Patterns) -> None:
        ends, hits = patterns.search(self.whole)
        rows = np.searchsorted(self.starts, ends - 1, side="right") - 1
        for end, hit, row in zip(ends.tolist(), hits.tolist(), rows.tolist()):
            begin = end - len(patterns.windows[hit])
            if begin >= self.starts[row]:
                zero = np.searchsorted(self.spaces, self.starts[row])
                low, high = np.searchsorted(self.spaces, (begin, end - 1)) - zero
                self.spans[row].append((int(low), int(high)))
                self.items[row].update(patterns.items[hit])

    def found(self) -> list[dict]:
        """Per text: its words, the spans of hit words and their number, the items found."""
        out = []
        for n, spans, items in zip(self.words, map(_union, self.spans), self.items):
            shown = [{"start": a, "stop": b} for a, b in spans]
            out.append({"n_words": n, "spans": shown, "n_hit": sum(b - a for a, b in spans), "items": sorted(items)})
        return out


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])
_FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(_SPAN)),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)
_ARROW = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("n_hit", pa.int64()), ("items", pa.list_(pa.string()))])


def occurrences(docs: DataFrame, blocks: list[str], text: str = "text", found: str = "found", keep_text: bool = False) -> DataFrame:
    """All columns (the text only with ``keep_text``) and ``found``: words, spans of hit words, their number, item ids.

    Spans are merged half-open ranges of word numbers; items are sorted as text. Null and
    empty texts have no words; repeated rows are judged alike; an empty table or benchmark
    gives no hits.
    """
    kept = [c for c in docs.columns if c not in (text, found)]
    picked = docs.select(*kept, F.col(text).cast("string").alias(text))
    shown = len(kept) + keep_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.RecordBatch, list[_Part]]] = []
        waiting = 0

        def judged() -> Iterator[pa.RecordBatch]:
            for name in blocks:
                patterns = _block(name)
                for _, parts in held:
                    for part in parts:
                        part.judge(patterns)
            for batch, parts in held:
                out = pa.array([row for part in parts for row in part.found()], _ARROW)
                yield pa.RecordBatch.from_arrays([*batch.columns[:shown], out], schema=pa.schema([*list(batch.schema)[:shown], pa.field(found, _ARROW)]))
            held.clear()

        for batch in batches:
            parts: list[_Part] = []
            texts: list[bytes] = []
            size = 0
            for value in batch.column(batch.num_columns - 1):
                texts.append(normalised(value.as_py()))
                size += len(texts[-1])
                if size > PART:
                    parts.append(_Part(texts))
                    waiting, texts, size = waiting + size, [], 0
            parts.append(_Part(texts))
            waiting += size
            held.append((batch, parts))
            if len(blocks) < 2 or waiting > HELD:
                yield from judged()
                waiting = 0
        yield from judged()

    return picked.mapInArrow(run, T.StructType([*picked.schema.fields[:shown], T.StructField(found, _FOUND)]))


def contaminated(found: str = "found") -> Column:
    """The rule: some word is hit, and hit words are at least a twentieth of all."""
    return (F.col(f"{found}.n_hit") > 0) & (F.col(f"{found}.n_hit") * 20 >= F.col(f"{found}.n_words"))


def clean(docs: DataFrame, items: DataFrame, key: str = "item_id", text: str = "text", width: int = 13) -> DataFrame:
    """The documents that aren't contaminated, with all their columns."""
    (found,) = free_names(docs.columns, "found_")
    judged = occurrences(docs, publish(items, key, width=width), text, found, keep_text=True)
    return judged.where(~contaminated(found)).select(*docs.columns)


def items_digest(items: Column) -> Column:
    return F.sha2(F.array_join(items, ",").cast("binary"), 256)
