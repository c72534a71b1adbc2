"""Updates and deletes that rewrite only the partitions they touch."""

import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from callboard.operators import changes as C
from callboard.sources import sinks

BY = ["status"]
SCHEMA = "id bigint, status string, v int, extra string"


@pytest.fixture
def table(spark, tmp_path):
    root = str(tmp_path / "t")
    data = [(i, "ABC D/%"[i % 3] if i < 90 else None if i < 95 else "D/% x", i, "e") for i in range(100)]
    sinks.write_partitioned(spark.createDataFrame(data, SCHEMA), root, BY)
    return root, {r[0]: r for r in data}


def stored(spark, root):
    return {r["id"]: (r["id"], r["status"], r["v"], r["extra"]) for r in spark.read.schema(SCHEMA).parquet(root).collect()}


def files(root):
    found = {}
    for folder, _, names in os.walk(root):
        for n in names:
            if n.endswith(".parquet"):
                found.setdefault(os.path.relpath(folder, root), set()).add(n)
    return found


def updates(spark, rows_):
    return spark.createDataFrame(rows_, "id bigint, status string, v int")


def test_rows_move_and_other_partitions_keep_their_files(spark, table):
    root, want = table
    before = files(root)
    asked = [(0, "B", 7), (3, "A", 8), (96, None, 9), (5000, "A", 1), (None, "A", 1)]
    done = C.update_partitions(spark, root, BY, updates(spark, asked), ["id"], ["status", "v"])
    for i, status, v in asked[:3]:
        want[i] = (i, status, v, "e")
    assert stored(spark, root) == want and spark.read.parquet(root).count() == 100
    after = files(root)
    assert set(done) == {"status=A", "status=D%2F%25 x"} and set(after) == set(before)
    assert after["status=C"] == before["status=C"]
    assert all(after[p].isdisjoint(before[p]) for p in before if p != "status=C")


def test_a_partition_without_rows_goes_and_nothing_to_do_does_nothing(spark, table):
    root, want = table
    before = files(root)
    gone = spark.createDataFrame([(i,) for i in range(95, 100)] + [(None,), (777,)], "id bigint")
    C.delete_from_partitions(spark, root, BY, gone)
    assert stored(spark, root) == {i: r for i, r in want.items() if i < 95}
    assert set(before) - set(files(root)) == {"status=D%2F%25 x"}
    before = files(root)
    assert C.delete_from_partitions(spark, root, BY, gone) == [] and files(root) == before
    moved = spark.createDataFrame([(i, "A") for i in range(90, 95)], "id bigint, status string")
    C.update_partitions(spark, root, BY, moved, ["id"], ["status"])
    assert spark.read.parquet(root).where("status IS NULL").count() == 0 and len(files(root)) == 3


def test_a_crash_before_the_switch_is_decided_changes_nothing(spark, table, monkeypatch):
    root, want = table
    monkeypatch.setattr(sinks.working, "put", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        C.update_partitions(spark, root, BY, updates(spark, [(0, "B", 7)]), ["id"], ["status", "v"])
    monkeypatch.undo()
    assert stored(spark, root) == want and any(n.startswith("_staged-") for n in os.listdir(root))
    sinks.recover_partitions(spark, root)
    assert stored(spark, root) == want and not any(n.startswith("_staged-") for n in os.listdir(root))


def test_a_crash_after_the_switch_is_decided_is_completed(spark, table, monkeypatch):
    root, want = table
    real, calls = sinks.recover_partitions, []

    def failing(session, path):
        calls.append(path)
        if len(calls) == 3:  # the one that carries the decided switch out
            raise OSError("lost")
        real(session, path)

    monkeypatch.setattr(sinks, "recover_partitions", failing)
    asked = [(i, "B", -1) for i in range(95, 100)]
    with pytest.raises(OSError):
        C.update_partitions(spark, root, BY, updates(spark, asked), ["id"], ["status", "v"])
    monkeypatch.undo()
    assert stored(spark, root) == want and os.path.exists(f"{root}/_switch")
    sinks.recover_partitions(spark, root)
    want |= {i: (i, s, v, "e") for i, s, v in asked}
    assert stored(spark, root) == want and "status=D%2F%25 x" not in files(root)
    sinks.recover_partitions(spark, root)
    assert stored(spark, root) == want


def test_equals_the_update_of_the_whole_table(spark, table):
    root, _ = table
    base = spark.read.schema(SCHEMA).parquet(root)
    asked = spark.range(300).selectExpr("id % 40 * 2 AS id", "concat('S', id % 4) AS status", "CAST(id AS INT) AS v")
    whole = rows(C.apply_updates(base, asked, ["id"], ["status", "v"], order_by=["v"]), "id", "status", "v", "extra")
    C.update_partitions(spark, root, BY, asked, ["id"], ["status", "v"], order_by=["v"])
    assert rows(spark.read.schema(SCHEMA).parquet(root), "id", "status", "v", "extra") == whole
    assert spark.read.parquet(root).where(F.col("status").startswith("S")).count() == 40
