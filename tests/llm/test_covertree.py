"""Cover trees: their invariants, links and components against brute force."""

import numpy as np
import pytest

from callboard.llm import covertree, workspace


def brute(rows, threshold=0.95):
    n, linked = len(rows), np.zeros((len(rows), len(rows)), bool)
    for i in range(n):
        for j in range(n):
            a, b = (np.array(rows[k][1], float) if rows[k][1] and None not in rows[k][1] else np.zeros(0) for k in (i, j))
            if i != j and len(a) and len(a) == len(b) and np.isfinite([*a, *b]).all() and a.any() and b.any():
                linked[i, j] = a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold
    label = np.arange(n)
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], n).min(axis=1, initial=n))
        if (new == label).all():
            break
        label = new
    out = []
    for i, (key, _) in enumerate(rows):
        keys = [rows[k][0] for k in range(n) if label[k] == label[i] and rows[k][0] is not None]
        least = min(keys) if keys else None
        out.append((key, int(linked[i].sum()), least, least == key))
    return sorted(map(str, out))


def frame(spark, rows):
    full = [(*r, 1, "x") for r in rows]
    return spark.createDataFrame(full, "vec_id bigint, embedding array<float>, n_links int, centre string")


def single(values):
    return np.asarray(values, np.float32).tolist()


def test_groups_copies_scales_and_odd_vectors(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.normal(size=16)
    rows = [(1000 + i, single(base + rng.normal(size=16) * 0.2)) for i in range(150)]
    rows += [(2000 + i, single(base * (i + 1))) for i in range(20)] + [(3000 + i, single(rng.normal(size=16))) for i in range(150)]
    rows += [(1, None), (2, single([0] * 16)), (3, [float("nan")] * 16), (4, single([1, 1, 1])), (5, single([2, 2, 2])), (6, []), (7, [None] * 16),
             (None, single([1, 1, 1])), (5, single([2, 2, 2])), (8, [float("inf")] * 16), (9, single([1e30] * 16)), (10, single([1e-30] * 16))]
    monkeypatch.setattr(covertree, "BLOCK_ROWS", 40)
    monkeypatch.setattr(covertree, "CENTRES", 5)
    got = covertree.near_duplicates(frame(spark, rows))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(rows)


def test_empty_and_unusable_tables(spark):
    assert covertree.near_duplicates(frame(spark, [])).count() == 0
    assert [tuple(r) for r in covertree.near_duplicates(frame(spark, [(1, None)])).collect()] == [(1, 0, 1, True)]


@pytest.mark.parametrize("spread", [0.02, 0.3, 3.0])
def test_nodes_cover_their_members_and_walks_find_every_link(spread):
    rng = np.random.default_rng(7)
    points = np.repeat(rng.normal(size=(6, 8)), 100, axis=0) + rng.normal(size=(600, 8)) * spread
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    left, right = points[:250], points[250:]

    def check(tree, points):
        assert sorted(tree.order) == list(range(len(points)))
        for node in range(len(tree.centre)):
            members, centre = tree.members(node), tree.centre[node]
            away = np.linalg.norm(points[members] - points[centre], axis=1)
            assert away.max() <= tree.radius[node] + 1e-7 and centre in members
            if tree.count[node]:
                kids = tree.below(node)
                assert tree.centre[kids[0]] == centre and tree.low[kids[0]] == tree.low[node]
                assert (tree.high[kids[:-1]] == tree.low[kids[1:]]).all() and tree.high[kids[-1]] == tree.high[node]

    for a, b, same in ((left, right, False), (left, left, True)):
        x = covertree.Tree.over(a)
        y = x if same else covertree.Tree.unpacked(covertree.Tree.over(b).packed())
        check(x, a)
        check(y, b)
        one = np.ones(1000, np.int64)
        links = covertree.Links(a, b, one[: len(a)], one[: len(b)], same, 0.95)
        links.walk(x, y)
        close = a @ b.T >= 0.95
        if same:
            np.fill_diagonal(close, False)
            assert (links.count_a + links.count_b == close.sum(axis=1)).all()
        else:
            assert (links.count_a == close.sum(axis=1)).all() and (links.count_b == close.sum(axis=0)).all()
        assert all(close[i, j] for i, j in links.edges) and len(links.edges) <= len(a) + len(b)


def test_block_pairs_grow_with_the_blocks_where_vectors_have_structure(spark, monkeypatch):
    """Eight times the vectors of a surface in 16 dimensions: pairs per block stay about the same."""
    monkeypatch.setattr(covertree, "BLOCK_ROWS", 128)
    monkeypatch.setattr(covertree, "CENTRES", 16)
    rng = np.random.default_rng(5)
    plane = np.linalg.qr(rng.normal(size=(16, 3)))[0]
    per_block = []
    for rows in (4_000, 32_000):
        points = rng.normal(size=(rows, 3)) @ plane.T
        made = spark.createDataFrame([(i, single(p), 1) for i, p in enumerate(points)], "id bigint, v array<float>, n bigint")
        blocks, pairs = covertree._block_pairs(made, 16, rows, 0.9995, workspace.folder(spark, "pairs"))
        assert blocks.agg({"rows": "sum"}).first()[0] == rows
        count, found = blocks.count(), pairs.count()
        assert count < 4 * rows / 128
        per_block.append(found / count)
    assert per_block[1] < 1.5 * per_block[0] and per_block[1] < 30, per_block
