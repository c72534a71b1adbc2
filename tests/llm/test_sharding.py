"""The lookup table against a plain simulation; balance, little movement, null keys."""

from collections import Counter

import pytest

from llm_frames import docs  # noqa: F401

from callboard.llm import queries, sharding

TINY = "/root/testdata/sf0.001"


def simulated(names, size):
    owner = {}
    orders = {}
    for n in sorted(names):
        start, step = sharding._number(f"start/{n}") % size, sharding._number(f"step/{n}") % (size - 1) + 1
        orders[n] = [(start + k * step) % size for k in range(size)]
        assert sorted(orders[n]) == list(range(size))
    while len(owner) < size:
        for n in sorted(names):
            if len(owner) < size:
                owner[next(s for s in orders[n] if s not in owner)] = n
    return [owner[s] for s in range(size)]


@pytest.mark.parametrize("count, size", [(1, 2), (3, 13), (7, 101), (5, 5)])
def test_table_equals_the_simulation(count, size):
    names = [f"n{i}" for i in range(count)]
    made = sharding.fill(names[::-1], size)
    assert made == simulated(names, size)
    slots = Counter(made).values()
    assert max(slots) - min(slots) <= 1


def test_weights_and_wrong_sizes():
    made = Counter(sharding.fill(["a", "b", "c"], 1009, {"a": 2, "c": 0}))
    assert set(made) == {"a", "b"} and abs(made["a"] - 2 * made["b"]) <= 2
    for names, size in ((["a"], 12), (["a", "a"], 13), ([], 13), (list("abcdef"), 5)):
        with pytest.raises(ValueError):
            sharding.fill(names, size)


def test_few_slots_move_when_a_shard_leaves():
    names = [f"n{i}" for i in range(20)]
    before, after = sharding.fill(names, 10007), sharding.fill(names[:-1], 10007)
    moved = sum(a != b for a, b in zip(before, after) if a != "n19")
    assert moved < 0.1 * len(before)


def test_query_places_every_document_by_its_table(spark):
    owner = sharding.fill(queries.SHARDS)
    got = queries.QUERIES["op4_permutation_table_sharding"](spark, TINY).collect()
    assert len(got) == spark.read.parquet(f"{TINY}/documents.parquet").count()
    assert all(owner[r["slot"]] == r["shard"] for r in got)


def test_nulls_repeats_empty_tables_and_other_columns(spark, docs, tmp_path):
    frame = docs([(1, "a"), (1, "b"), (None, "c"), (None, "d"), (2, None)]).withColumnRenamed("id", "slot").withColumnRenamed("found", "shard")
    placed = sharding.place(frame, ["doc_id"], ["x", "y", "z"], 101)
    assert placed.columns == ["doc_id", "text", "source", "n", "slot", "shard"]
    shards = {}
    for r in placed.collect():
        shards.setdefault(r["doc_id"], set()).add((r["slot"], r["shard"]))
    assert len(shards) == 3 and all(len(v) == 1 for v in shards.values())
    assert sharding.place(frame.limit(0), ["doc_id"], ["x"], 101).count() == 0
    sharding.write(placed, str(tmp_path / "out"), rows_per_file=1)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
