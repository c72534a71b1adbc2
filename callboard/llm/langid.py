"""Language identification by segmentation-marginalised unigrams.

A model holds, for every language, the probability of each piece of a fixed public
vocabulary. A word's likelihood is the sum over all ways to cut it into pieces of the
product of their probabilities; a forward pass over its bytes gives that sum. Single bytes
are pieces, so every text can be cut. A text's log-likelihood adds up its words, and the
score is the language's posterior under equal priors.

Words are lower-cased runs without ASCII digits, punctuation or white space, written with
one space in front, as the vocabulary has them. All pieces of the vocabulary count, whatever
their length, and words aren't cut short: up to eight bytes a piece's key is the piece, a longer one's key
is a hash of it, and bytes are compared where a hash is found. The forward pass of
the distinct words of a batch runs in step, grouped by length, for all languages at once; over
words of more than ``STEP_BYTES`` it is rescaled every few bytes, and a few long words of one length go one by one.

Learning is expectation-maximisation over the word counts of a bounded sample of labelled
documents: Spark counts words, tasks compute expected piece counts, one aggregate sums them in
whole numbers, so the model doesn't depend on the order in which rows arrive.
"""

from __future__ import annotations

import base64
import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callboard.llm.blocks import free_names

#: Words of so many bytes, space included, need no rescaling: no product of probabilities underflows.
STEP_BYTES = 41
#: Bytes between rescalings.
RESCALE = 16
#: Words of like length from which on long ones go in step.
TOGETHER = 128
#: Expected counts are summed in units of 2**-20.
UNIT = 1 << 20
#: Labelled documents per language that a model is fitted on, in expectation and at most
#: counting each text once; they are chosen by the hash of their text.
DOCS_PER_LANGUAGE = 400
ROUNDS = 3
#: Added to every piece's expected count, as a share of the vocabulary's mean count.
SMOOTHING = 0.02
UNKNOWN = "und"
#: Characters of text whose words are looked up together.
PART = 8_000_000

_TABLE = bytes(b if b > 127 or 97 <= b <= 122 else 32 for b in range(256))


def read_pieces(path: str) -> list[bytes]:
    """The pieces of a rank file (base64 piece and rank per line), and all bytes."""
    with open(path, "rb") as f:
        pieces = {base64.b64decode(line.split()[0]) for line in f if line.strip()}
    return sorted(pieces | {bytes([b]) for b in range(256)})


_BASE = np.uint64(0x9E3779B97F4A7C15)


def _longer(value: np.ndarray, byte: np.ndarray, size: int) -> np.ndarray:
    """The keys of stretches of ``size`` bytes from those without their first byte."""
    byte = byte.astype(np.uint64)
    return value | byte << np.uint64(8 * (size - 1)) if size <= 8 else value * _BASE + byte


class _Places:
    """Finds the place of a piece's key by hashing; the number of pieces where there is none."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(6, int(8 * len(keys) - 1).bit_length())
        self.keys = np.r_[keys, np.uint64(0)]
        self.slots = np.full(1 << self.bits, len(keys), np.int32)
        slot, waiting = self._slot(keys), np.arange(len(keys))
        while len(waiting):
            here = slot[waiting]
            free = np.flatnonzero(self.slots[here] == len(keys))
            taken = waiting[free[np.unique(here[free], return_index=True)[1]]]
            self.slots[slot[taken]] = taken
            waiting = waiting[~np.isin(waiting, taken)]
            slot[waiting] = (slot[waiting] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        place = self.slots[slot]
        none = len(self.keys) - 1
        open_ = np.flatnonzero((place != none) & (self.keys[place] != keys))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            place[open_] = self.slots[slot[open_]]
            open_ = open_[(place[open_] != none) & (self.keys[place[open_]] != keys[open_])]
        return place


class _Lookup:
    """Finds pieces by length and key."""

    def __init__(self, pieces: list[bytes]):
        self.none = len(pieces)
        by_size: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            by_size.setdefault(len(p), []).append(i)
        self.longest = max(by_size)
        self.tables = {}
        for size, numbers in by_size.items():
            text = np.frombuffer(b"".join(pieces[i] for i in numbers), np.uint8).reshape(-1, size)
            keys = np.zeros(len(numbers), np.uint64)
            for k in range(1, size + 1):
                keys = _longer(keys, text[:, size - k], k)
            if len(np.unique(keys)) < len(keys):
                raise ValueError("two pieces have one key")
            self.tables[size] = _Places(keys), np.array([*numbers, self.none]), text

    def find(self, size: int, keys: np.ndarray, stretch: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """Numbers of the pieces with these keys, ``none`` where there is none; ``stretch`` gives the bytes of some rows."""
        places, numbers, text = self.tables[size]
        place = places.find(keys)
        if size > 8:
            hit = np.flatnonzero(place < len(text))
            wrong = hit[(text[place[hit]] != stretch(hit)).any(axis=1)] if len(hit) else hit
            place[wrong] = len(text)
        return numbers[place]


def words_of(text: str | None) -> list[bytes]:
    """The words of a text in bytes, without the space in front."""
    return (text or "").lower().encode("utf-8", "replace").translate(_TABLE).split()


@dataclass
class Model:
    """Languages, pieces and a (pieces + 1) x languages table of probabilities; its last row is 0."""

    languages: list[str]
    pieces: list[bytes]
    table: np.ndarray

    def __post_init__(self):
        self._lookup: _Lookup | None = None

    @property
    def lookup(self) -> _Lookup:
        if self._lookup is None:
            self._lookup = _Lookup(self.pieces)
        return self._lookup

    def __getstate__(self):
        return self.languages, self.pieces, self.table

    def __setstate__(self, state):
        self.languages, self.pieces, self.table = state
        self._lookup = None

    def _at(self, text: np.ndarray, end: int) -> Iterator[tuple[int, np.ndarray]]:
        """Length k and the pieces text[:, end - k : end], for all lengths that pieces have."""
        keys = np.zeros(len(text), np.uint64)
        for k in range(1, min(self.lookup.longest, end) + 1):
            keys = _longer(keys, text[:, end - k], k)
            if k in self.lookup.tables:
                yield k, self.lookup.find(k, keys, lambda rows, k=k: text[rows, end - k : end])

    def _forward(self, text: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
        """Log-likelihoods of rows of bytes of one length, or of ``sizes`` bytes each, with rescaling."""
        shape = len(text), len(self.languages)
        alpha, scale, out = {0: np.ones(shape)}, np.zeros(shape), np.zeros(shape)
        for end in range(1, text.shape[1] + 1):
            total = np.zeros(shape)
            for k, place in self._at(text, end):
                hit = np.flatnonzero(place != self.lookup.none) if k > 4 else slice(None)
                total[hit] += alpha[end - k][hit] * self.table[place[hit]]
            alpha[end] = total
            alpha.pop(end - self.lookup.longest, None)
            if sizes is not None:
                done = np.flatnonzero(sizes == end)
                out[done] = np.log(total[done]) + scale[done]
                if end % RESCALE == 0:
                    scale += np.log(total)
                    alpha = {e: a / total for e, a in alpha.items()}
        return np.log(total) if sizes is None else out

    def _pieces_in(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """End, length and number of all pieces in one row of bytes, by end; and where each end's begin."""
        found = []
        keys = np.zeros(len(text) + 1, np.uint64)
        for k in range(1, min(self.lookup.longest, len(text)) + 1):
            keys[k:] = _longer(keys[k:], text[: len(text) + 1 - k], k)
            if k in self.lookup.tables:
                windows = np.lib.stride_tricks.sliding_window_view(text, k)
                place = self.lookup.find(k, keys[k:], lambda rows, w=windows: w[rows])
                hit = np.flatnonzero(place != self.lookup.none)
                found.append((hit + k, np.full(len(hit), k), place[hit]))
        end, size, place = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(end, kind="stable")
        end, size, place = end[order], size[order], place[order]
        return end, size, place, np.searchsorted(end, np.arange(len(text) + 2))

    def _forward_one(self, text: np.ndarray) -> np.ndarray:
        """Log-likelihoods of one row of bytes, rescaled on the way."""
        _, size, place, at = self._pieces_in(text)
        alpha, scale = np.zeros((len(text) + 1, len(self.languages))), np.zeros(len(self.languages))
        alpha[0] = 1
        for end, low, high in zip(range(1, len(text) + 1), at[1:].tolist(), at[2:].tolist()):
            alpha[end] = (alpha[end - size[low:high]] * self.table[place[low:high]]).sum(axis=0)
            if end % RESCALE == 0:
                total = alpha[end].copy()
                scale += np.log(total)
                alpha[max(0, end - self.lookup.longest) : end + 1] /= total
        return np.log(alpha[len(text)]) + scale

    @staticmethod
    def _groups(sizes: np.ndarray, most: int) -> Iterator[np.ndarray]:
        """Numbers of words of one length each, ``most`` at most."""
        order = np.argsort(sizes, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(sizes[order]) > 0, True]) if len(sizes) else []
        for low, high in zip(cuts, cuts[1:]):
            for at in range(low, high, most):
                yield order[at : min(at + most, high)]

    @staticmethod
    def _bytes(words: list[bytes], chosen: np.ndarray, size: int) -> np.ndarray:
        text = b"".join((b" " + words[i]).ljust(size, b"\0") for i in chosen.tolist())
        return np.frombuffer(text, np.uint8).reshape(len(chosen), size)

    def likelihoods(self, words: list[bytes]) -> np.ndarray:
        """Log-likelihood of each word in each language, over all segmentations."""
        out = np.zeros((len(words), len(self.languages)))
        sizes = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
        for chosen in self._groups(np.where(sizes <= STEP_BYTES, sizes, 0), 20_000):
            if 0 < sizes[chosen[0]] <= STEP_BYTES:
                out[chosen] = self._forward(self._bytes(words, chosen, sizes[chosen[0]]))
        long = np.flatnonzero(sizes > STEP_BYTES)
        # Lengths within a quarter of each other go together, padded.
        steps = np.floor(np.log(sizes[long]) / math.log(1.25)).astype(np.int64)
        for part in self._groups(steps, 4_000):
            chosen = long[part]
            if len(chosen) >= TOGETHER:
                out[chosen] = self._forward(self._bytes(words, chosen, sizes[chosen].max()), sizes[chosen])
            else:
                for i in chosen.tolist():
                    out[i] = self._forward_one(np.frombuffer(b" " + words[i], np.uint8))
        return out

    def expected(self, words: list[bytes], counts: np.ndarray, column: int) -> np.ndarray:
        """Expected number of uses of each piece in counted words of one language, in ``UNIT``s.

        Each word's share is rounded by itself, so sums don't depend on their order.
        """
        total = np.zeros(len(self.pieces) + 1)
        chance = self.table[:, column]
        sizes = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
        for chosen in self._groups(np.where(sizes <= STEP_BYTES, sizes, 0), 3_000):
            size = int(sizes[chosen[0]])
            if size > STEP_BYTES:
                continue
            text = self._bytes(words, chosen, size)
            place = {(end, k): p for end in range(1, size + 1) for k, p in self._at(text, end)}
            used = {key: chance[p] for key, p in place.items()}
            before, after = np.zeros((size + 1, len(chosen))), np.zeros((size + 1, len(chosen)))
            before[0] = after[size] = 1
            for end, k in sorted(used):
                before[end] += before[end - k] * used[end, k]
            for end, k in sorted(used, key=lambda x: x[1] - x[0]):
                after[end - k] += after[end] * used[end, k]
            share = counts[chosen] / before[size] * UNIT
            for (end, k), p in place.items():
                total += np.bincount(p, np.rint(before[end - k] * used[end, k] * after[end] * share), len(total))
        for i in np.flatnonzero(sizes > STEP_BYTES).tolist():
            end, size, place, at = self._pieces_in(np.frombuffer(b" " + words[i], np.uint8))
            n, p = len(words[i]) + 1, chance[place]
            alpha, beta, scale = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
            alpha[0] = beta[n] = 1
            for e in range(1, n + 1):  # alpha[e] is divided by exp(scale[e])
                part = slice(at[e], at[e + 1])
                back = e - size[part]
                value = (alpha[back] * np.exp(scale[back] - scale[e - 1]) * p[part]).sum()
                alpha[e], scale[e] = 1.0, scale[e - 1] + math.log(value)
            p *= np.exp(scale[end - size] - scale[end])
            for e in range(n, 0, -1):
                part = slice(at[e], at[e + 1])
                np.add.at(beta, e - size[part], p[part] * beta[e])
            total += np.bincount(place, np.rint(alpha[end - size] * p * beta[end] * counts[i] * UNIT), len(total))
        return total[:-1].astype(np.int64)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1)):
            counts.setdefault(lang.as_py(), Counter()).update(words_of(text.as_py()))
    rows = [(lang, word, n) for lang, c in counts.items() for word, n in c.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64())], ["lang", "word", "n"])


def _expect(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(model.languages), len(model.pieces)), np.int64)
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            words, counts = batch.column(1).to_pylist(), batch.column(2).to_numpy()
            for column, lang in enumerate(model.languages):
                chosen = np.flatnonzero(langs == lang)
                total[column] += model.expected([words[i] for i in chosen.tolist()], counts[chosen], column)
        column, piece = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(column, pa.int64()), pa.array(piece, pa.int64()), pa.array(total[column, piece])], ["column", "piece", "n"])

    return run


def sample(labelled: DataFrame, lang: str, text: str, docs_per_language: int = DOCS_PER_LANGUAGE) -> DataFrame:
    """(lang, text) of at most about ``docs_per_language`` distinct texts per language.

    Which documents are taken depends on their text alone, so the sample is the same however
    the table is cut; a text that many rows share counts once, also in the rate.
    """
    rows = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL")
    texts = rows.select("lang", F.xxhash64("text").alias("h")).distinct()
    sizes = texts.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per language
    if not sizes:
        return rows.limit(0)
    steps = 1 << 40
    cases = F.lit(0)
    for row in sizes:
        cases = F.when(F.col("lang") == row["lang"], F.lit(min(steps, steps * docs_per_language // row["n"]))).otherwise(cases)
    return rows.where(F.pmod(F.xxhash64("text"), F.lit(steps)) < cases).dropDuplicates(["lang", "text"])


def fit(labelled: DataFrame, pieces_path: str, lang: str = "lang", text: str = "text",
        docs_per_language: int = DOCS_PER_LANGUAGE, rounds: int = ROUNDS) -> Model:
    """Learn a model from labelled rows; rows without a text or a language teach nothing.

    The driver sees one number per language and piece, whatever the documents.
    """
    counted = sample(labelled, lang, text, docs_per_language).mapInArrow(_count_words, "lang string, word binary, n bigint")
    counts = counted.groupBy("lang", "word").agg(F.sum("n").alias("n")).persist()
    languages = [r[0] for r in counts.select("lang").distinct().orderBy("lang").collect()]
    pieces = read_pieces(pieces_path)
    table = np.zeros((len(pieces) + 1, len(languages)))
    table[:-1] = 1 / len(pieces)
    model = Model(languages, pieces, table)
    for _ in range(rounds if languages else 0):
        summed = counts.mapInArrow(_expect(model), "column bigint, piece bigint, n bigint").groupBy("column", "piece").agg(F.sum("n").alias("n"))
        got = summed.toArrow()
        uses = np.zeros((len(pieces), len(languages)))
        uses[got["piece"].to_numpy(), got["column"].to_numpy()] = got["n"].to_numpy() / UNIT
        uses += SMOOTHING * uses.sum(axis=0) / len(pieces) + 1e-9
        model.table[:-1] = uses / uses.sum(axis=0)
    counts.unpersist()
    return model


def judge(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of each text; UNKNOWN and 0 without a letter or a model."""
    numbers: dict[bytes, int] = {}
    rows: list[np.ndarray] = []
    for text in texts:
        found = words_of(text) if text and model.languages and any(map(str.isalpha, text)) else []
        rows.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in found), np.int64, len(found)))
    each = model.likelihoods(list(numbers))
    langs, scores = [], []
    for text, row in zip(texts, rows):
        if not len(row):
            langs.append(UNKNOWN)
            scores.append(0.0)
            continue
        total = each[row].sum(axis=0)
        best = int(total.argmax())
        langs.append(model.languages[best])
        scores.append(1 / math.fsum(np.exp(total - total[best]).tolist()))
    return langs, scores


def identify(
    docs: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred", score: str = "score", keep_text: bool = False
) -> DataFrame:
    """All columns (the text only with ``keep_text``), the predicted language and its score from 0 to 1.

    A text that is null or has no letter is ``und`` with score 0, and so is every text under
    a model without languages. Equal texts get equal answers and ties go to the language
    whose name sorts first. Nothing but the text is read for a prediction.
    """
    kept = [c for c in docs.columns if c not in (text, lang, score)]
    picked = docs.select(*kept, F.col(text).cast("string").alias(text))
    shown = len(kept) + keep_text
    shared = docs.sparkSession.sparkContext.broadcast(model)  # pieces x languages numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs: list[str] = []
            scores: list[float] = []
            part: list[str | None] = []
            size = 0
            for value in batch.column(batch.num_columns - 1):
                part.append(value.as_py())
                size += len(part[-1] or "")
                if size > PART:
                    for out, more in zip((langs, scores), judge(shared.value, part)):
                        out += more
                    part, size = [], 0
            for out, more in zip((langs, scores), judge(shared.value, part)):
                out += more
            schema = pa.schema([*list(batch.schema)[:shown], pa.field(lang, pa.string()), pa.field(score, pa.float64())])
            yield pa.RecordBatch.from_arrays([*batch.columns[:shown], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], schema=schema)

    return picked.mapInArrow(run, T.StructType([*picked.schema.fields[:shown], T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())]))


def held_out(key: str = "doc_id") -> Column:
    """Whether a row is kept from learning: crc32 of its key as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identified(docs: DataFrame, pieces_path: str, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Fit on the rows that aren't held out and identify all rows: key, held_out, lang_pred, score."""
    model = fit(docs.where(~held_out(key)), pieces_path, lang, text)
    return identify(docs.select(F.col(key), held_out(key).alias("held_out"), F.col(text)), model, text)


def keep_identified(docs: DataFrame, pieces_path: str, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents whose language could be told, with all their columns; ``und`` ones go.

    Those are the texts without a letter, and only those go where no language could be learned.
    """
    model = fit(docs.where(~held_out(key)), pieces_path, lang, text)
    if not model.languages:
        return docs.where(F.col(text).cast("string").rlike(r"\p{L}"))
    found, score = free_names(docs.columns, "lang_", "score_")
    return identify(docs, model, text, found, score, keep_text=True).where(F.col(found) != UNKNOWN).select(*docs.columns)
