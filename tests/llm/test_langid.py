"""Language identification: the forward sum against all segmentations, held-out accuracy, odd rows."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_frames import docs  # noqa: F401

from callboard.llm import langid, queries

SMALL = "/root/testdata/sf0.01"
PATH = queries.vocabulary("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def model(spark):
    return langid.fit(spark.read.parquet(f"{SMALL}/documents.parquet").where(~langid.held_out()), PATH)


def cuts(word):
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        for rest in cuts(word[k:]):
            yield [word[:k], *rest]


def test_likelihood_sums_over_all_segmentations(model):
    place = {p: i for i, p in enumerate(langid.read_pieces(PATH))}
    for word in (b"the", b"ouen", "été".encode(), b"x"):
        total = sum(np.prod([model.table[place[p]] for p in cut], axis=0) for cut in cuts(b" " + word) if all(p in place for p in cut))
        assert np.allclose(model.likelihoods([word])[0], np.log(total))
    assert np.allclose(model.table[:-1].sum(axis=0), 1)


def test_expected_counts_are_posterior_uses(model):
    place = {p: i for i, p in enumerate(langid.read_pieces(PATH))}
    uses, total = np.zeros(len(place)), 0.0
    for cut in cuts(b" then"):
        if all(p in place for p in cut):
            chance = math.prod(model.table[place[p], 0] for p in cut)
            total += chance
            for p in cut:
                uses[place[p]] += chance
    assert np.allclose(model.expected([b"then"], np.array([3]), 0) / langid.UNIT, 3 * uses / total, atol=1e-5)
    assert model.expected([], np.array([], int), 0).sum() == 0


def forward(model, place, word):
    """Log-likelihoods by the plain recurrence over all pieces of any length, in logarithms."""
    text = b" " + word
    alpha = np.full((len(text) + 1, len(model.languages)), -np.inf)
    alpha[0] = 0
    for end in range(1, len(text) + 1):
        terms = [alpha[i] + np.log(model.table[place[text[i:end]]]) for i in range(end) if text[i:end] in place]
        alpha[end] = np.logaddexp.reduce(terms)
    return alpha[-1]


def test_long_pieces_and_long_words_count(model):
    """Pieces of 8 to 33 bytes, alone and inside longer words; words far over 40 bytes, few and many of a length."""
    place = {p: i for i, p in enumerate(langid.read_pieces(PATH))}
    assert len(place) == 50_256
    usable = [p for p in place if len(p) >= 8 and not p.decode("utf-8", "replace").strip(" ").translate({c: None for c in range(0x61, 0x7B)}).isascii()]
    usable += [p for p in place if len(p) >= 8 and p.removeprefix(b" ").isalpha() and p.islower()]
    rng = random.Random(1)
    words = sorted({p.removeprefix(b" ") for p in usable if b" " not in p.removeprefix(b" ")}, key=lambda p: (len(p), p))
    assert len(words) > 1000 and len(words[-1]) >= 20
    chosen = rng.sample(words, 150) + words[-20:]
    chosen += [b"".join(rng.sample(words, n)) for n in (2, 3, 5, 8, 20, 100)]
    chosen += [b"".join(rng.sample(words, 6))[:70] for _ in range(200)]  # go in step, rescaled
    got = model.likelihoods(chosen)
    for word, found in zip(chosen, got):
        assert np.allclose(found, forward(model, place, word), rtol=1e-9), word


def test_long_words_teach_as_short_ones_do(model):
    place = {p: i for i, p in enumerate(langid.read_pieces(PATH))}
    pieces = langid.read_pieces(PATH)
    for word in (b"thenandnow" * 2, b"thenandnow" * 12, "перестройка".encode() * 4):
        text, chance = b" " + word, model.table[:, 0]
        n = len(text)
        before, after = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        before[0] = after[n] = 0
        spans = [(i, e, place[text[i:e]]) for e in range(1, n + 1) for i in range(e) if text[i:e] in place]
        for i, e, p in spans:
            before[e] = np.logaddexp(before[e], before[i] + np.log(chance[p]))
        for i, e, p in sorted(spans, reverse=True):
            after[i] = np.logaddexp(after[i], after[e] + np.log(chance[p]))
        uses = np.zeros(len(pieces))
        for i, e, p in spans:
            uses[p] += np.exp(before[i] + np.log(chance[p]) + after[e] - before[n])
        assert np.allclose(model.expected([word], np.array([2]), 0) / langid.UNIT, 2 * uses, atol=1e-4)


def test_models_of_two_partitionings_are_equal(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one, two = (langid.fit(d, PATH) for d in (docs.coalesce(1), docs.repartition(13)))
    assert one.languages == two.languages and (one.table == two.table).all()


def test_held_out_accuracy_over_the_whole_table(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang").collect()}
    got = queries.QUERIES["op3_segmentation_language_id"](spark, SMALL).collect()
    assert len(got) == len(truth) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    kept = [r for r in got if r["held_out"] and truth[r["doc_id"]]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in kept) >= 0.98 * len(kept)


def test_nulls_letterless_and_long_texts_and_other_columns(spark, docs, model):
    rows = [(1, None), (2, ""), (3, "12 !?"), (4, "the and of"), (4, "the and of"), (None, "Ü" * 300000), (6, "日本語"), (7, "_" * 50)]
    frame = docs(rows).withColumnRenamed("id", "lang_pred").withColumnRenamed("found", "lang")
    got = langid.identify(frame, model).collect()
    lang = {(r["doc_id"], r["lang_pred"] == "und", r["score"] == 0) for r in got}
    assert lang == {(1, True, True), (2, True, True), (3, True, True), (4, False, False), (None, False, False), (6, False, False), (7, True, True)}
    assert [r["lang_pred"] for r in got if r["doc_id"] == 4] == ["en", "en"]
    assert langid.identify(frame.limit(0), model).count() == 0


def test_without_labels_all_is_undetermined(spark, docs):
    frame = docs([(1, "the and of"), (2, None)]).withColumnRenamed("found", "lang")
    nothing = langid.fit(frame.limit(0), PATH)
    assert {(r["lang_pred"], r["score"]) for r in langid.identify(frame, nothing).collect()} == {("und", 0.0)}


def test_the_filter_keeps_columns_and_drops_undetermined(spark, docs):
    frame = docs([(1, "the and of"), (2, None), (3, "7"), (4, "l'été")]).withColumnRenamed("found", "lang")
    kept = langid.keep_identified(frame, PATH)
    assert kept.columns == frame.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 4]


def test_copies_do_not_thin_the_sample(spark):
    texts = [f"the word {k} and others" for k in range(100)]
    rows = [("en", "a text that all share")] * 2900 + [("en", t) for t in texts] + [("fr", f"le mot {k % 50} et d'autres") for k in range(50_000)]
    taken = langid.sample(spark.createDataFrame(rows, "lang string, text string"), "lang", "text").groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in taken} == {"en": 101, "fr": 50}
    many = spark.range(20_000).selectExpr("'en' AS lang", "CAST(id % 5000 AS STRING) AS text")
    assert 300 < langid.sample(many, "lang", "text").count() < 500


def test_without_a_model_only_letterless_texts_go(spark, docs):
    frame = docs([(1, "the and of"), (2, None), (3, "7 !"), (4, "日本語"), (5, "")]).withColumn("lang", F.lit(None).cast("string"))
    kept = langid.keep_identified(frame, PATH)
    assert kept.columns == frame.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 4]
