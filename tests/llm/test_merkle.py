"""Merkle manifests against a plain tree of the whole table."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from callboard.llm import merkle

TINY = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, row string, g int, pos string"


def digest(*parts):
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def leaf_of(row):
    shown = [None if v is None else str(v).encode() for v in row]
    return digest(*[b"-" if v is None else str(len(v)).encode() + b":" + v for v in shown])


def grown(nodes):
    levels = []
    while len(nodes) > 1:
        levels.append(nodes)
        nodes = [digest(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return levels, nodes[0]


def brute(rows):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) of rows (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        part = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[s] = (part, *grown([leaf_of(r) for r in part]))
    above, root = grown([trees[s][2] for s in names]) if rows else ([], b"")
    out = []
    for j, s in enumerate(names):
        part, levels, subroot = trees[s]
        for i, r in enumerate(part):
            spoilt = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            node, others = leaf_of((*r[:4], r[4].replace("\n", "")) if spoilt else r), []
            for tree, place in ((levels, i), (above, j)):
                for level in tree:
                    at = place // 3 * 3
                    run, slot = level[at : at + 3], place - at
                    others += run[:slot] + run[slot + 1 :]
                    node, place = digest(*run[:slot], node, *run[slot + 1 :]), place // 3
            out.append((r[0], *(x.decode() for x in (leaf_of(r), subroot, root, digest(*others), node)), node == root))
    return sorted(out, key=repr)


@pytest.fixture
def verified(spark):
    def run(rows):
        frame = spark.createDataFrame([(*r, "a", 1, "b") for r in rows], SCHEMA)
        even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
        given = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
        tree = merkle.build(frame, ["doc_id", "source", "lang", "n_chars", "text"], "source", ["doc_id"], given={"text": given})
        return sorted(map(tuple, tree.verify().collect()), key=repr)

    return run


@pytest.mark.parametrize("sizes", [[1], [2], [3], [4], [9, 10, 1], [243], [244, 1, 242], [730, 3]])
def test_group_sizes_around_runs(verified, sizes):
    rows = [(1000 * s + i, f"s{s}", "en", i, f"t{i}\nu") for s, n in enumerate(sizes) for i in range(n)]
    assert verified(rows) == brute(rows)


def test_more_groups_than_a_run_holds(verified):
    rows = [(i, f"s{i}", None, i, "x\n") for i in range(300)]
    assert verified(rows) == brute(rows)


def test_nulls_repeats_ties_and_long_texts(verified):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (1, None, "en", 3, ""), (1, None, "en", 3, ""),
            (1, "", "en", 4, "tie"), (1, "", "en", 5, "tie"), (7, "é", "fr", 2, "x" * 500_000 + "\n"), (7, "Z", "fr", 2, "\n"), (8, "z", None, 1, "é\né")]
    assert verified(rows) == brute(rows)
    assert verified([]) == []


def test_roots_and_partitioning(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    args = (["doc_id", "text"], "source", ["doc_id"])
    one, many = (merkle.build(d, *args).roots() for d in (docs.coalesce(1), docs.repartition(7)))
    assert sorted(one.collect()) == sorted(many.collect()) and one.select("root").distinct().count() == 1
    checked = merkle.build(docs, *args, keep=["doc_id", "lang"]).verify()
    assert checked.columns[:2] == ["doc_id", "lang"] and checked.where("verified").count() == docs.count()


def test_a_parent_folds_from_the_state_before_a_slot():
    children = [digest(str(i).encode()) for i in range(3)]
    parent = merkle.Parent(children)
    assert parent.digest == digest(*children)
    for slot in range(3):
        fresh = digest(b"new")
        assert parent.fold(slot, fresh) == digest(*children[:slot], fresh, *children[slot + 1 :])
        assert parent.fold(slot, children[slot]) == parent.digest
