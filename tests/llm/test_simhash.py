"""SimHash fingerprints, links and components against brute force."""

import re

import numpy as np
import pytest
import xxhash

from llm_frames import docs  # noqa: F401

from callboard.llm import components, simhash

SMALL = "/root/testdata/sf0.01"


def fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def classes(keys, linked):
    """Smallest key reachable, by plain propagation."""
    label = list(range(len(keys)))
    changed = True
    while changed:
        changed = False
        for i, j in linked:
            low = min(label[i], label[j])
            changed |= label[i] != low or label[j] != low
            label[i] = label[j] = low
    least = {}
    for i, k in enumerate(keys):
        least[label[i]] = min(k, least.get(label[i], k))
    return [least[x] for x in label]


def brute(rows):
    marks = np.array([fingerprint(t) for _, t in rows], np.uint64)
    close = np.bitwise_count(marks[:, None] ^ marks[None, :]) <= 3
    return [f"{m:016x}" for m in marks.tolist()], classes([k for k, _ in rows], np.argwhere(np.triu(close, 1)).tolist())


def test_whole_table_equals_brute_force(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()][:400]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r[0]: (r[1], r[2]) for r in simhash.near_duplicates(frame).collect()}
    marks, parts = brute(rows)
    assert got == {k: (m, c) for (k, _), m, c in zip(rows, marks, parts)}


def test_nulls_short_texts_repeats_and_other_columns(spark, docs):
    rows = [(5, None), (4, ""), (9, " \n"), (7, "one"), (3, "ONE"), (3, "ONE"), (8, "a b"), (6, "a\x85b c d " * 30000)]
    got = sorted(tuple(r) for r in simhash.near_duplicates(docs(rows)).collect())
    marks, parts = brute(rows)
    assert got == sorted((k, m, c) for (k, _), m, c in zip(rows, marks, parts))
    kept = simhash.keep_one(docs(rows))
    assert kept.columns == ["doc_id", "text", "source", "n", "id", "found"]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(k for (k, _), c in zip(rows, parts) if k == c)
    assert simhash.near_duplicates(docs([])).count() == 0 and simhash.keep_one(docs([])).count() == 0


def test_null_keys_are_never_the_smallest(spark, docs):
    got = sorted((str(r[0]), r[2]) for r in simhash.near_duplicates(docs([(None, "x y"), (4, "x y")])).collect())
    assert got == [("4", 4), ("None", 4)]


@pytest.mark.parametrize("size", [5, 300, 1500])
def test_forests_connect_what_links_connect(size):
    rng = np.random.default_rng(size)
    seeds = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    words = np.unique(seeds[rng.integers(0, 40, size)] ^ (np.uint64(1) << rng.integers(0, 64, size).astype(np.uint64)))
    half = len(words) // 2
    a, b = words[:half], words[half:]
    keys = list(range(len(words)))
    place = {w: i for i, w in enumerate(words.tolist())}
    edges = simhash.forest(a, a, True, 3) + simhash.forest(b, b, True, 3) + simhash.forest(a, b, False, 3)
    close = np.bitwise_count(words[:, None] ^ words[None, :]) <= 3
    assert all(close[place[x], place[y]] for x, y in edges)
    assert len(edges) <= 3 * len(words)
    assert classes(keys, [(place[x], place[y]) for x, y in edges]) == classes(keys, np.argwhere(np.triu(close, 1)).tolist())


def test_components_of_paths_stars_and_loops(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(1000, k) for k in range(1001, 1200)]
    other = [(5000, 5000), (7, 7), (300, 301), (301, 300), (300, 301), (None, 4)]
    frame = spark.createDataFrame(path + star + other, "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in components.connected(frame, "a", "b").collect()}
    assert got == {i: 0 for i in range(1, 41)} | {k: 1000 for k in range(1001, 1200)} | {301: 300}
    assert components.connected(frame.limit(0), "a", "b").count() == 0


def test_a_repeated_key_loses_only_the_copied_text(docs):
    a, b = "one two three four five six seven eight", "red green blue cyan pink grey black white"
    kept = simhash.keep_one(docs([(3, a), (5, a), (5, b), (7, b)]))
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(3, a), (5, b)]
