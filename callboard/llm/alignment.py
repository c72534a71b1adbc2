"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how often corpus-wide.

Both tokenizers cut the same bytes. A task takes a block of texts, lays their tokens on one
line of byte offsets, sorts the tokens of both sides together by start (lexsort) and carries
the largest end so far along (maximum.accumulate): a group begins where a start reaches that
maximum, which is where tokens of both sides have ended. Within a group the overlapping
pairs are spread out; there are n_a + n_b - 1 of them.

Counts of pairs over all texts are one aggregate. A block asks for each of its pairs once,
however often it links it, so the questions are a fraction of the links and a pair that all
texts share is one row a block. The answers come back as one row per block, which leads the
block's texts through a second task that adds them up per text. Texts travel as links (two
or four bytes each), never as pairs of their own.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callboard.llm import bpe, workspace
from callboard.llm.blocks import whole_runs

#: Bytes of text in a block, but for a text that is longer alone.
BLOCK_BYTES = 2_000_000
#: Pairs that a block asks for in one row.
PAIRS_A_ROW = 50_000
RESULTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


class Side:
    """One tokenizer: ids of texts, and the bytes of its tokens."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.at = np.r_[0, np.cumsum(self.sizes)]
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> bytes:
        return bpe.spread_out(self.at, self.flat, ids)[0].tobytes()


class ByteSide(Side):
    """A byte-level BPE vocabulary file (json); special tokens in a text are plain text."""

    def __init__(self, path: str):
        arrays = bpe.read_vocabulary(path)
        at, flat = arrays["piece_at"], arrays["piece_bytes"].tobytes()
        tokens = [flat[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
        if not (np.diff(arrays["pair_id"][np.argsort(arrays["pair_rank"])]) > 0).all():
            raise ValueError(f"{path}: ids don't ascend with the merges")
        super().__init__(tokens)
        special = set(json.loads(arrays["special"].tobytes()).values())
        ranks = {t: i for i, t in enumerate(tokens) if t and i not in special}
        self.coding = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        return [np.array(self.coding.encode_ordinary(" " + t), np.int64) for t in texts]


class PieceSide(Side):
    """A sentencepiece model; it adds the leading space itself."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        super().__init__([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int64) for ids in self.model.encode(list(texts), num_threads=1)]


def laid_out(side: Side, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a block and the ends of their bytes on one line."""
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    return flat, np.cumsum(side.sizes[flat])


def coalesced(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The group of every A and B token, and the number of groups."""
    count_a, count_b = len(ends_a), len(ends_b)
    start = np.concatenate([[0], ends_a[:-1], [0], ends_b[:-1]]) if count_a and count_b else np.zeros(0, np.int64)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    end = np.concatenate([ends_a, ends_b])
    order = np.lexsort((np.repeat([0, 1], [count_a, count_b]), start))
    reach = np.maximum.accumulate(end[order])
    begins = np.ones(len(order), bool)
    begins[1:] = start[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(begins) - 1
    return group[:count_a], group[count_a:], int(group.max()) + 1


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in A, in B) of all pairs of tokens that share a byte, by A's place and then B's."""
    starts_a, starts_b = np.r_[0, ends_a[:-1]][: len(ends_a)], np.r_[0, ends_b[:-1]][: len(ends_b)]
    first = np.searchsorted(ends_b, starts_a, "right")
    count = np.searchsorted(starts_b, ends_a, "left") - first
    left = np.repeat(np.arange(len(ends_a)), count)
    right = np.arange(len(left)) + np.repeat(first - (np.cumsum(count) - count), count)
    return left, right


@lru_cache(maxsize=1)
def _numerals(most: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal numbers below ``most``, each with one byte left free behind it."""
    shown = [f"{i}," for i in range(most)]
    return np.r_[0, np.cumsum([len(s) for s in shown])], np.frombuffer("".join(shown).encode(), np.uint8)


def written_groups(ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes ``a1,a2|b1;a3|b2,b3;`` of all groups, and where each group's bytes end."""
    groups = int(group_a[-1]) + 1 if len(group_a) else 0
    in_a, in_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    place_a = np.arange(len(ids_a)) + (np.cumsum(in_b) - in_b)[group_a]
    place_b = np.arange(len(ids_b)) + np.cumsum(in_a)[group_b]
    both = np.empty(len(ids_a) + len(ids_b), np.int64)
    both[place_a], both[place_b] = ids_a, ids_b
    text, sizes = bpe.spread_out(*_numerals(most), both)
    text = text.copy()
    ends = np.cumsum(sizes)
    last_b = np.cumsum(in_a + in_b) - 1
    text[ends[last_b - in_b] - 1] = ord("|")
    text[ends[last_b] - 1] = ord(";")
    return text, ends[last_b]


@lru_cache(maxsize=1)
def _sides(a: str, b: str) -> tuple[ByteSide, PieceSide]:
    return ByteSide(SparkFiles.get(a)), PieceSide(SparkFiles.get(b))


def align(texts: Sequence[str | None], a: Side, b: Side) -> tuple[dict[str, list], np.ndarray, np.ndarray]:
    """Per text n_a, n_b, n_groups, n_links, groups_sha256 and links; the block's pairs and their counts.

    ``links`` are places in the sorted distinct pairs, packed; a pair is A's id * 2**32 + B's.
    """
    given = [t or "" for t in texts]
    ids_a, ids_b = a.encode(given), b.encode(given)
    none = np.zeros(0, np.int64)
    for k, text in enumerate(given):
        wanted = b" " + text.encode("utf-8", "surrogatepass")
        if not text or a.bytes_of(ids_a[k]) != wanted or b.bytes_of(ids_b[k]) != wanted:
            ids_a[k] = ids_b[k] = none
    count_a, count_b = (np.fromiter(map(len, ids), np.int64, len(ids)) for ids in (ids_a, ids_b))
    (flat_a, ends_a), (flat_b, ends_b) = laid_out(a, ids_a), laid_out(b, ids_b)
    group_a, group_b, groups = coalesced(ends_a, ends_b)
    left, right = overlaps(ends_a, ends_b)
    pairs, link, counts = np.unique((flat_a[left] << 32) + flat_b[right], return_inverse=True, return_counts=True)
    shown, shown_ends = written_groups(flat_a, flat_b, group_a, group_b, max(len(a.tokens), len(b.tokens)))
    stop_a = np.cumsum(count_a)
    group_stop = np.r_[group_a, groups][stop_a] if groups else np.zeros(len(given), np.int64)
    link_stop = np.searchsorted(left, stop_a, "left")
    text_stop = np.r_[0, shown_ends][group_stop]
    packed = link.astype("<u2" if len(pairs) <= 1 << 16 else "<u4")
    out: dict[str, list] = {"n_a": count_a.tolist(), "n_b": count_b.tolist()}
    out["n_groups"] = np.diff(group_stop, prepend=0).tolist()
    out["n_links"] = np.diff(link_stop, prepend=0).tolist()
    view = memoryview(shown)
    spans = zip([0, *text_stop[:-1].tolist()], text_stop.tolist())
    out["groups_sha256"] = [hashlib.sha256(view[i : j - 1]).hexdigest() if j > i else "" for i, j in spans]
    out["links"] = [packed[i:j].tobytes() for i, j in zip([0, *link_stop[:-1].tolist()], link_stop.tolist())]
    return out, pairs, counts


_FOUND = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, links binary"
_ASKED = "first bigint, pairs array<bigint>, counts array<bigint>"


def _aligned(a: str, b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, task, number = _sides(a, b), TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            done = 0
            for part in _slices(batch.column(1)):
                texts = batch.column(1).slice(done, part).to_pylist()
                found, pairs, counts = align(texts, *sides)
                block = pa.array([task + number] * part, pa.int64())
                nulls = [pa.nulls(part, t) for t in (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))]
                columns = [pa.array(v, pa.binary() if k == "links" else pa.string() if k == "groups_sha256" else pa.int64()) for k, v in found.items()]
                names = ["row", "block", *found, "first", "pairs", "counts"]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, part), block, *columns, *nulls], names)
                for first in range(0, len(pairs), PAIRS_A_ROW):
                    asked = [pa.array([x[first : first + PAIRS_A_ROW]], pa.list_(pa.int64())) for x in (pairs, counts)]
                    kinds = [batch.schema.field(0).type, None, *[c.type for c in columns]]
                    empty = [pa.nulls(1, t) for t in kinds if t is not None]
                    yield pa.RecordBatch.from_arrays([empty[0], block[:1], *empty[1:], pa.array([first], pa.int64()), *asked], names)
                done, number = done + part, number + 1

    return run


def _slices(texts: pa.Array) -> Iterator[int]:
    count = size = 0
    for n in pc.binary_length(texts).to_pylist():
        if count and size + (n or 0) > BLOCK_BYTES:
            yield count
            count = size = 0
        count += 1
        size += n or 0
    if count:
        yield count


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the answers in a block's leading row up over the links of its texts."""
    for table, at in whole_runs(batches, ["block"]):
        links, leads = table["links"].to_pylist(), table["lead"].to_pylist()
        answers = table["answers"].chunk(0)
        bounds, told = answers.offsets.to_numpy(), answers.values
        place, counts, tops = (told.field(i).to_numpy(zero_copy_only=False) for i in range(3))
        sums, best, texts = [], [], []
        count = top = np.zeros(0, np.int64)
        for k in range(table.num_rows):
            if leads[k]:
                part = slice(bounds[k], bounds[k + 1])
                count, top = np.empty(len(place[part]), np.int64), np.empty(len(place[part]), np.int64)
                count[place[part]], top[place[part]] = counts[part], tops[part]
                continue
            link = np.frombuffer(links[k], "<u2" if len(count) <= 1 << 16 else "<u4")
            texts.append(k)
            sums.append(int(count[link].sum()) if len(link) else 0)
            best.append(int(top[link].sum()) if len(link) else 0)
        rows = table.take(pa.array(texts, pa.int64()))
        columns = [rows["row"], rows["n_a"], rows["n_b"], rows["n_groups"], rows["n_links"], pa.array(best, pa.int64()), pa.array(sums, pa.int64())]
        yield from pa.table([*columns, rows["groups_sha256"]], ["row", *RESULTS]).to_batches()


def pair_counts(asked: DataFrame) -> DataFrame:
    """(pair, count, best): links of every pair over all texts, and whether no pair of its B id has more."""
    counted = asked.groupBy("pair").agg(F.sum("n").alias("count"))
    counted = workspace.written(counted, workspace.folder(asked.sparkSession, "pairs"))
    most = counted.groupBy((F.col("pair") % (1 << 32)).alias("id_b")).agg(F.max("count").alias("most"))
    joined = counted.withColumn("id_b", F.col("pair") % (1 << 32)).join(most, "id_b")
    return joined.select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def aligned(docs: DataFrame, a_path: str, b_path: str, text: str = "text", columns: Sequence[str] = ()) -> DataFrame:
    """``columns`` of every row, and ``RESULTS`` in place of columns of these names.

    A is a byte-level BPE file and reads a space and the text; B is a sentencepiece model that
    adds the space. Null and empty texts, and texts whose bytes a tokenizer changes, have no
    tokens: zeros and an empty digest. Equal texts get equal results; an empty table gives none.
    Columns not asked for are neither read nor returned, so they may bear any name.
    """
    spark = docs.sparkSession
    base = workspace.folder(spark, "alignment")
    for path in (a_path, b_path):
        spark.sparkContext.addFile(path)
    names = [p.rsplit("/", 1)[-1] for p in (a_path, b_path)]
    kept = [F.col(c) for c in columns if c not in RESULTS] or [F.lit(0).alias("_")]
    picked = docs.select(F.struct(*kept).alias("row"), F.col(text).cast("string").alias("text"))
    fields = [T.StructField("row", picked.schema["row"].dataType), *T.StructType.fromDDL(f"block bigint, {_FOUND}, {_ASKED}")]
    found = workspace.written(picked.mapInArrow(_aligned(*names), T.StructType(fields)), base)
    asking = found.where("first IS NOT NULL").select("block", "first", "pairs", "counts")
    asked = asking.select("block", "first", F.explode(F.arrays_zip("pairs", "counts")).alias("p"))
    counted = pair_counts(asked.select(F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n")))
    placed = asking.select("block", F.posexplode("pairs").alias("k", "pair"), "first").withColumn("place", (F.col("first") + F.col("k")).cast("int"))
    answered = placed.join(counted, "pair").groupBy("block").agg(F.collect_list(F.struct("place", "count", "best")).alias("answers"))
    answers = answered.withColumn("lead", F.lit(True))
    texts = found.where("n_a IS NOT NULL").select("row", "block", *T.StructType.fromDDL(_FOUND).names)
    led = texts.unionByName(answers, allowMissingColumns=True)
    led = led.repartition("block").sortWithinPartitions("block", F.col("lead").asc_nulls_last())
    out = [fields[0], *[T.StructField(n, T.StringType() if n == "groups_sha256" else T.LongType()) for n in RESULTS]]
    summed = led.mapInArrow(_summed, T.StructType(out))
    return summed.select(*[F.col("row").getField(c).alias(c) for c in columns if c not in RESULTS], *RESULTS)
