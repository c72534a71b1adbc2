"""Byte-level BPE encoding and decoding with a memory-mapped transducer of frequent words.

A first pass counts the words of all documents. The most frequent ones are compiled, with
their ids, into a minimal acyclic transducer (``transducer``); vocabulary, merges and
lexicon go into one file that Spark hands to every executor, whose tasks map it into memory
and share its pages. A batch looks its distinct words up there; the others are cut by the
tokenizer's pattern, looked up again, and what is still unseen is merged exactly, many words
in step. The size of the lexicon changes speed, never ids.

Words are cut at single spaces: a token can hold a space only as its first character or in
a run of white space, so every space that has a neighbour other than white space begins a
token. Texts with a space inside a run of white space are cut by the pattern as a whole.
"""

from __future__ import annotations

import heapq
import json
import re
import uuid
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callboard.llm import transducer, workspace
from callboard.llm.blocks import free_names

#: Words in the lexicon at most; bounds the file, and what the driver sees of the corpus.
LEXICON_WORDS = 1 << 15
#: Characters of text whose distinct words are looked up together.
SLICE_CHARS = 12_000_000
#: Characters of a text group whose ids are laid out together.
GROUP_CHARS = 1_000_000
#: Words up to so many bytes are merged in step; longer ones one by one.
STEP_BYTES = 48
#: Words of a table of distinct words that a task counts before it hands counts on.
COUNT_WORDS = 200_000

# Fixed value: the pattern that cuts text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CUT = regex.compile(PATTERN)
_INNER_SPACE = re.compile(r"\s \s")
_NONE = np.iinfo(np.int32).max


def _byte_of_char() -> dict[str, int]:
    """Vocabulary files print bytes as characters: visible ones as they are, others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def read_vocabulary(path: str) -> dict[str, np.ndarray]:
    """Arrays of a byte-level BPE file: piece bytes by id, byte ids, merges by pair, special tokens.

    The pair of a merge is the key left * 2**32 + right; keys ascend.
    """
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    chars = _byte_of_char()
    ids = model["model"]["vocab"]
    special = {t["content"]: t["id"] for t in model["added_tokens"]}
    pieces = {i: bytes(chars[c] for c in p) for p, i in ids.items() if p not in special}
    pieces |= {i: p.encode() for p, i in special.items()}
    flat = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
    merges = {}
    for rank, merge in enumerate(model["model"]["merges"]):
        left, right = merge if isinstance(merge, list) else merge.split(" ")
        merges.setdefault((ids[left] << 32) + ids[right], (rank, ids[left + right]))
    pairs = sorted(merges)
    single = {p[0]: i for i, p in pieces.items() if len(p) == 1}
    slots, bits = _hashed(np.array(pairs, np.int64))
    return {
        "piece_at": np.cumsum([0, *map(len, flat)]),
        "piece_bytes": np.frombuffer(b"".join(flat), np.uint8),
        "byte_ids": np.array([single[b] for b in range(256)], np.int32),
        "pairs": np.array(pairs, np.int64),
        "pair_rank": np.array([merges[p][0] for p in pairs], np.int32),
        "pair_id": np.array([merges[p][1] for p in pairs], np.int32),
        "slots": slots,
        "slot_bits": np.array([bits], np.int64),
        "special": np.frombuffer(json.dumps(special).encode(), np.uint8),
    }


def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
    mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


def _hashed(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """An open hash table of the places of distinct keys, -1 where it is free; a quarter full at most."""
    bits = max(4, int(4 * len(keys) - 1).bit_length())
    slots = np.full(1 << bits, -1, np.int32)
    slot, waiting = _slot(keys, bits), np.arange(len(keys))
    while len(waiting):
        here = slot[waiting]
        free = slots[here] < 0
        first = np.unique(here[free], return_index=True)[1]
        taken = waiting[free][first]
        slots[slot[taken]] = taken
        waiting = np.setdiff1d(waiting, taken)
        slot[waiting] = (slot[waiting] + 1) & ((1 << bits) - 1)
    return slots, bits


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    """One file of named arrays, each at an aligned place, so that it can be mapped into memory."""
    at, index, body = 0, {}, []
    for name, array in arrays.items():
        data = np.ascontiguousarray(array).tobytes()
        index[name] = (at, len(array), array.dtype.str)
        body.append(data + b"\0" * (-len(data) % 16))
        at += len(body[-1])
    head = json.dumps(index).encode()
    head += b" " * (-(len(head) + 16) % 16)
    return len(head).to_bytes(16, "little") + head + b"".join(body)


def mapped(path: str) -> dict[str, np.ndarray]:
    """The arrays of a packed file, mapped into memory and read where they are used."""
    whole = np.memmap(path, np.uint8, "r")
    size = int.from_bytes(whole[:16].tobytes(), "little")
    index = json.loads(whole[16 : 16 + size].tobytes())
    start = 16 + size
    return {k: whole[start + at : start + at + n * np.dtype(t).itemsize].view(t) for k, (at, n, t) in index.items()}


def spread_out(at: np.ndarray, data: np.ndarray, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs data[at[i]:at[i + 1]] of all picked i after one another, and their lengths."""
    sizes = at[picked + 1] - at[picked]
    total = int(sizes.sum())
    if not total:
        return data[:0], sizes
    ends = np.cumsum(sizes)
    place = np.arange(total)
    place += np.repeat(at[picked] - (ends - sizes), sizes)
    return data[place], sizes


class Coder:
    """Encodes and decodes with the arrays of one packed file."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.a = arrays
        self.special: dict[str, int] = json.loads(arrays["special"].tobytes())
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pairs, self.slots, self.bits = arrays["pairs"], arrays["slots"], int(arrays["slot_bits"][0])
        self.ranks = np.r_[arrays["pair_rank"], _NONE]
        self.ids = np.r_[arrays["pair_id"], -1].astype(np.int64)  # place -1: no merge
        byte_ids = arrays["byte_ids"].astype(np.int64)
        first = (byte_ids[:, None] << 32) + byte_ids[None, :]
        self.first_rank = self._look(first.ravel())[0].reshape(256, 256)

    def _look(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of the merge of each pair; an endless rank where there is none."""
        slot = _slot(wanted, self.bits)
        place = self.slots[slot]
        open_ = np.flatnonzero((place >= 0) & (self.pairs[place] != wanted))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            place[open_] = self.slots[slot[open_]]
            open_ = open_[(place[open_] >= 0) & (self.pairs[place[open_]] != wanted[open_])]
        return self.ranks[place], self.ids[place]

    def _merge_one(self, word: bytes) -> list[int]:
        """Exact merges of one long word: always the lowest rank, the leftmost first."""
        ids = self.a["byte_ids"][np.frombuffer(word, np.uint8)].tolist()
        before, after = list(range(-1, len(ids) - 1)), [*range(1, len(ids)), -1]
        known: dict[int, tuple[int, int]] = {}

        def merge_of(i: int) -> tuple[int, int]:
            key = (ids[i] << 32) + ids[after[i]]
            if key not in known:
                rank, new = self._look(np.array([key]))
                known[key] = int(rank[0]), int(new[0])
            return known[key]

        heap = [(merge_of(i)[0], i, ids[i], ids[i + 1]) for i in range(len(ids) - 1)]
        heap = [x for x in heap if x[0] != _NONE]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue
            ids[i] = merge_of(i)[1]
            ids[j] = -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and merge_of(k)[0] != _NONE:
                    heapq.heappush(heap, (merge_of(k)[0], k, ids[k], ids[after[k]]))
        return [i for i in ids if i >= 0]

    def _merge_step(self, words: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words up to ``size`` bytes and their counts, with one merge of each word per step.

        Each row is a linked list with a guard at either end; a merge unlinks its right part.
        """
        n, wide = len(words), size + 2
        count = np.fromiter(map(len, words), np.int64, n)
        text = np.frombuffer(b"".join(w.ljust(size, b"\0") for w in words), np.uint8).reshape(n, size)
        column = np.arange(wide)
        ids = np.full((n, wide), -1, np.int64)
        ids[:, 1:-1] = self.a["byte_ids"][text]
        ids[column[None, :] > count[:, None]] = -1
        rank = np.full((n, wide), _NONE, np.int32)
        rank[:, 1:-2] = self.first_rank[text[:, :-1], text[:, 1:]]
        rank[column[None, :] >= count[:, None]] = _NONE
        ids, rank = ids.ravel(), rank.ravel()
        following = np.tile(column + 1, n) + np.repeat(np.arange(n) * wide, wide)
        before = following - 2
        live = np.arange(n)
        while len(live):
            view = rank.reshape(n, wide) if len(live) == n else rank.reshape(n, wide)[live]
            at = view.argmin(axis=1) + live * wide
            go = rank[at] != _NONE
            live, at = live[go], at[go]
            if not len(live):
                break
            right = following[at]
            new = self._look((ids[at] << 32) + ids[right])[1]
            beyond, left = following[right], before[at]
            ids[at], ids[right], rank[right] = new, -1, _NONE
            following[at], before[beyond] = beyond, at
            rank[at] = self._look((new << 32) + ids[beyond])[0]
            rank[left] = self._look((ids[left] << 32) + new)[0]
        alive = ids >= 0
        return ids[alive], alive.reshape(n, wide).sum(axis=1)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of words of at least one byte, merged without the lexicon."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order, flat, counts = [], [], []
        low = 0
        for high in (4, 6, 8, 10, 12, 16, 24, STEP_BYTES):
            group = np.flatnonzero((sizes > low) & (sizes <= high))
            for part in np.array_split(group, len(group) * high // 100_000 + 1):
                if len(part):
                    ids, count = self._merge_step([words[i] for i in part.tolist()], high)
                    order.append(part)
                    flat.append(ids)
                    counts.append(count)
            low = high
        for i in np.flatnonzero(sizes > low).tolist():
            order.append([i])
            flat.append(np.array(self._merge_one(words[i]), np.int64))
            counts.append([len(flat[-1])])
        if not order:
            return np.zeros(1, np.int64), np.zeros(0, np.int64)
        at = np.r_[0, np.cumsum(np.concatenate(counts))]
        place = np.empty(len(words), np.int64)
        place[np.concatenate(order)] = np.arange(len(words))
        out, sizes = spread_out(at, np.concatenate(flat), place)
        return np.r_[0, np.cumsum(sizes)], out

    def _known(self, words: list[bytes]) -> np.ndarray:
        return transducer.ranks(self.a, words) if "keys" in self.a else np.full(len(words), -1, np.int64)

    def _word_ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of distinct words: from the lexicon, else merged."""
        rank = self._known(words)
        unseen = np.flatnonzero(rank < 0)
        at, ids = self.merge([words[i] for i in unseen.tolist()])
        base = len(self.a["lexicon_at"]) - 1 if "lexicon_at" in self.a else 0
        where = rank.copy()
        where[unseen] = base + np.arange(len(unseen))
        if not base:
            return at, ids
        ends = np.r_[self.a["lexicon_at"], self.a["lexicon_at"][-1] + at[1:]]
        flat, sizes = spread_out(ends, np.r_[self.a["lexicon_ids"], ids], where)
        return np.r_[0, np.cumsum(sizes)], flat

    def table(self, keys: list) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of a slice's distinct keys, see ``cut``."""
        chunks = [" " + k if type(k) is str else k[0] if type(k) is tuple else "" for k in keys]
        known = self._known([c.encode() for c in chunks])
        words = _Codes()
        number = words.__getitem__
        codes: list[int] = []
        at = [0]
        for chunk, rank in zip(chunks, known.tolist()):
            if rank >= 0 or chunk[1:].isalpha() and chunk[0] == " ":
                codes.append(number(chunk))  # one token of letters, whatever they are
            elif chunk[1:-1].isalpha() and chunk[0] == " " and chunk[-1] in ".,;:!?":
                codes.append(number(chunk[:-1]))
                codes.append(number(chunk[-1]))
            else:
                codes += map(number, _CUT.findall(chunk))
            at.append(len(codes))
        flat, sizes = spread_out(*self._word_ids([w.encode() for w in words]), np.array(codes, np.int64))
        ends = np.r_[0, np.cumsum(sizes)][np.array(at)]
        marks = [(i, k) for i, k in enumerate(keys) if isinstance(k, int)]
        if marks:  # special tokens come behind the words
            extra = np.array([k for _, k in marks], np.int64)
            ends = np.r_[ends, ends[-1] + 1 + np.arange(len(marks))]
            flat = np.r_[flat, extra]
        return ends, flat

    def cut(self, text: str) -> list:
        """Keys of a text: words that follow a space, tuples of ones that don't, special ids."""
        keys: list = []
        for part in self.split.split(text) if self.split and self.split.search(text) else (text,):
            if part in self.special:
                keys.append(self.special[part])
            elif _INNER_SPACE.search(part):
                keys += [(w,) for w in _CUT.findall(part)]
            elif part:
                first, *rest = part.split(" ")
                keys.append((first,))
                keys += rest
        return keys

    def encode(self, texts: Sequence[str | None]) -> Iterator[np.ndarray]:
        """The ids of every text in turn, as unsigned 32-bit numbers; null is empty."""
        start = 0
        while start < len(texts):
            stop, size = start, 0
            while stop < len(texts) and (stop == start or size + len(texts[stop] or "") <= SLICE_CHARS):
                size += len(texts[stop] or "")
                stop += 1
            yield from self._encode_slice(texts[start:stop])
            start = stop

    def _encode_slice(self, texts: Sequence[str | None]) -> Iterator[np.ndarray]:
        codes = _Codes()
        number = codes.__getitem__
        rows = []
        for text in texts:
            keys = self.cut(text) if text else []
            rows.append(np.fromiter(map(number, keys), np.int32, len(keys)))
        keys = list(codes)
        at, ids = self.table(keys)
        ids = ids.astype("<u4")
        place = np.arange(len(keys))  # a special token's run stands behind all words
        marks = [i for i, k in enumerate(keys) if isinstance(k, int)]
        place[marks] = len(keys) + np.arange(len(marks))
        group: list[np.ndarray] = []
        size = 0
        for row in [*rows, None]:
            if group and (row is None or size + len(row) > GROUP_CHARS // 4):
                flat, sizes = spread_out(at, ids, place[np.concatenate(group)])
                ends = np.r_[0, np.cumsum(sizes)]
                stops = ends[np.cumsum([len(r) for r in group])].tolist()
                for begin, end in zip([0, *stops[:-1]], stops):
                    yield flat[begin:end]
                group, size = [], 0
            if row is not None:
                group.append(row)
                size += len(row)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that aren't UTF-8 become replacement characters."""
        pieces = spread_out(self.a["piece_at"], self.a["piece_bytes"], ids.astype(np.int64))[0]
        return pieces.tobytes().decode("utf-8", errors="replace")


class _Codes(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = code = len(self)
        return code


@lru_cache(maxsize=2)
def _coder(name: str) -> Coder:
    return Coder(mapped(SparkFiles.get(name)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def flushed() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])
        counts.clear()
        return out

    for batch in batches:
        for text in batch.column(0):
            counts.update((text.as_py() or "").split(" ")[1:])
            if len(counts) > COUNT_WORDS:
                yield flushed()
    yield flushed()


def frequent_words(docs: DataFrame, text: str = "text", words: int = LEXICON_WORDS) -> list[str]:
    """The most frequent words that follow a space, ``words`` at most, counted over all documents.

    Tasks count before the shuffle. A histogram of the counts in steps of an eighth of a
    doubling, a few hundred rows, says from which count on words are taken; so the driver gets
    that histogram and the words themselves and no candidates. Words seen once are left out.
    """
    counted = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(_count, "word string, n bigint")
    counted = counted.groupBy("word").agg(F.sum("n").alias("n")).where("n > 1 AND octet_length(word) <= 64")
    stepped = counted.select("word", F.floor(F.log2("n") * 8).cast("int").alias("step"))
    stepped = workspace.written(stepped, base := workspace.folder(docs.sparkSession, "words"))
    taken, least = 0, None
    for row in stepped.groupBy("step").count().orderBy(F.desc("step")).collect():
        taken += row["count"]
        if taken > words:
            break
        least = row["step"]
    found = [] if least is None else [r["word"] for r in stepped.where(F.col("step") >= least).select("word").collect()]
    workspace.drop(docs.sparkSession, base)
    return found


def lexicon(vocabulary: dict[str, np.ndarray], words: Sequence[str]) -> dict[str, np.ndarray]:
    """The vocabulary's arrays with the transducer of the words, each after one space, and their ids.

    Words that hold a special token or other white space in a place where cutting depends on
    what follows are left out; they are cut and merged when they come.
    """
    coder = Coder(vocabulary)
    good = sorted({(" " + w).encode() for w in words if not any(s in w for s in coder.special)})
    at, ids = coder.table([w[1:].decode() for w in good])
    return vocabulary | transducer.compile_words(good) | {"lexicon_at": at, "lexicon_ids": ids}


def publish(docs: DataFrame, text: str, vocabulary_path: str, words: int = LEXICON_WORDS) -> str:
    """Build the file for a corpus, put it into the shared folder and hand it to all executors.

    Executors that join later fetch it too. Returns its name among the session's files.
    """
    spark = docs.sparkSession
    arrays = lexicon(read_vocabulary(vocabulary_path), frequent_words(docs, text, words))
    name = f"bpe-{uuid.uuid4().hex}.bin"
    spark.sparkContext.addFile(workspace.put(spark, f"{workspace.folder(spark, 'bpe')}/{name}", pack(arrays)))
    return name


def encode(
    docs: DataFrame, name: str, text: str = "text", ids: str = "ids", columns: Sequence[str] = (), decoded: str | None = None
) -> DataFrame:
    """``columns`` of every row with ``ids``: the text's token ids as packed little-endian 32-bit numbers.

    With ``decoded`` the column of that name holds what ``decode`` makes of the ids. It comes from
    the same pass: two operators in one stage would keep two Python workers a core.

    ``name`` comes from ``publish``. Null and empty texts give no ids; equal rows give equal
    rows; an empty table gives none. Columns not asked for are neither read nor returned, so
    they may bear any name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(name)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            done = 0
            for part in _slices(texts):
                packed, plain = [], []
                for found in coder.encode(texts.slice(done, part).to_pylist()):
                    packed.append(found.tobytes())
                    if decoded is not None:
                        plain.append(coder.decode(found))
                arrays = [batch.column(k).slice(done, part) for k in range(batch.num_columns - 1)] + [pa.array(packed, pa.binary())]
                fields = [*list(batch.schema)[:-1], pa.field(ids, pa.binary())]
                if decoded is not None:
                    arrays.append(pa.array(plain, pa.string()))
                    fields.append(pa.field(decoded, pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema(fields))
                done += part

    (whole,) = free_names(columns, "text_")
    picked = docs.select(*columns, F.col(text).cast("string").alias(whole))
    more = [T.StructField(ids, T.BinaryType())] + ([] if decoded is None else [T.StructField(decoded, T.StringType())])
    return picked.mapInArrow(run, T.StructType([*picked.schema.fields[:-1], *more]))


def _slices(texts: pa.Array) -> Iterator[int]:
    """Row counts of consecutive parts of about SLICE_CHARS bytes."""
    count = size = 0
    for n in pc.binary_length(texts).to_pylist():
        if count and size + (n or 0) > SLICE_CHARS * 2:
            yield count
            count = size = 0
        count += 1
        size += n or 0
    if count:
        yield count


def decode(frame: DataFrame, name: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """All columns but ``ids``, and the text that the packed ids stand for (null ids: empty)."""
    kept = [c for c in frame.columns if c not in (ids, text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(name)
        for batch in batches:
            found = pa.array([coder.decode(np.frombuffer(x.as_py() or b"", "<u4")) for x in batch.column(batch.num_columns - 1)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], schema=pa.schema([*list(batch.schema)[:-1], pa.field(text, pa.string())]))

    picked = frame.select(*kept, F.col(ids))
    return picked.mapInArrow(run, T.StructType([*picked.schema.fields[:-1], T.StructField(text, T.StringType())]))
