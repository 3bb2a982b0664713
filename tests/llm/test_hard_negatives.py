"""Cover-tree search against plain Python over every row."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, anchor):
    ready = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ready.append((i, [math.floor(256 * float(np.float32(x))) for x in v], label))
    order = lambda t: (-t[0], t[1] is None, t[1] or 0)
    out = []
    for i, v, label in ready:
        if i is None or not anchor(i):
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, other) for j, w, other in ready]
        near = sorted([s for s in scored if s[2] == label and s[1] != i], key=order)[:5]
        for p, pid, _ in near:
            hard = sorted([s for s in scored if s[2] != label and 30 * p <= 100 * s[0] <= 90 * p], key=order)[:10]
            out += [(i, pid, rank, nid, p, n) for rank, (n, nid, _) in enumerate(hard, 1)]
    return sorted(out, key=repr)


def got(spark, rows, schema=SCHEMA):
    frame = spark.createDataFrame(rows, schema).repartition(3)
    return sorted(map(tuple, H.mine(frame, F.col("vec_id") % 10 == 0).collect()), key=repr)


def vectors(n, seed, width=12, centers=5):
    rng = random.Random(seed)
    middle = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(centers)]
    return [(i, [c + rng.gauss(0, 0.4) for c in middle[rng.randrange(centers)]], rng.randrange(4)) for i in range(n)]


@pytest.fixture()
def small_shards(monkeypatch):
    monkeypatch.setattr(H, "SHARD_ROWS", 70)
    monkeypatch.setattr(H, "BLOCK_ROWS", 7)
    monkeypatch.setattr(H, "LEAF_ROWS", 6)
    monkeypatch.setattr(H, "LEAST_CHILD", 2)


def test_many_shards_and_blocks(spark, small_shards):
    rows = vectors(400, 3)
    assert got(spark, rows) == brute(rows, lambda i: i % 10 == 0)


def test_awkward_rows(spark, small_shards):
    rows = vectors(120, 5)
    rows += [(500 + i, rows[0][1], i % 3) for i in range(100)]  # copies: ties, more than a shard
    rows += [(None, rows[1][1], 1), (610, None, 1), (611, rows[2][1], None), (612, [1.0, None] + [0.0] * 10, 1), (613, [float("nan")] * 12, 2),
             (614, [float("inf")] * 12, 2), (615, [], 1), (620, [0.0] * 12, 3), (630, [2.0, 1.0], 0), (7, rows[7][1], rows[7][2])]
    assert got(spark, rows) == brute(rows, lambda i: i % 10 == 0)


def test_negative_scores_and_large_components(spark):
    rows = [(0, [1e6, -1e6], 0), (1, [-1e6, 1e6], 0), (2, [1e6, -0.9e6], 0), (3, [8e5, -8e5], 1), (4, [5e5, -5e5], 1), (10, [-1.0, 0.0], 1)]
    assert got(spark, rows) == brute(rows, lambda i: i % 10 == 0)
    beyond = H.inner_products(np.array([[1e15, 1.0]]), np.array([[1e15, 1.0], [-1e15, 0.0]]))
    assert beyond.tolist() == [[H.NO_ID, H.NOTHING + 1]]


def test_no_anchor_one_label_empty_and_extra_columns(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
    assert got(spark, [(0, [1.0], 1), (2, [1.0], 1)]) == []
    rows = vectors(60, 8)
    wide = [(*r, 1, "x", 2.0) for r in rows]
    assert got(spark, wide, schema=SCHEMA + ", rank int, shard string, row double") == brute(rows, lambda i: i % 10 == 0)


def test_tree_covers_and_skips():
    rng = np.random.default_rng(4)
    points = np.floor(256 * np.concatenate([c + 0.02 * rng.normal(size=(100, 8)) for c in 3 * np.eye(8)[:6]]))
    tree = H.CoverTree.build(points, np.arange(600), np.arange(600) % 2)
    assert sorted(tree.ids.tolist()) == list(range(600)) and len(tree.center) > 6
    for i in np.flatnonzero(tree.start >= 0):
        inside = tree.vectors[tree.start[i]:tree.stop[i]]
        assert (np.sqrt(((inside - tree.center[i]) ** 2).sum(1)) <= tree.radius[i] + 1e-6).all()
    visited = []
    visit = tree._visit
    tree._visit = lambda node, *a: (visited.append(node), visit(node, *a))
    q = points[:1]
    args = q, np.zeros(1, int), np.array([0]), np.array([0]), np.array([H.NOTHING + 1]), np.array([H.NO_ID]), True, 3
    window, ids, scores = tree.search(*args)
    exact = sorted(((-int(points[j] @ q[0]), j) for j in range(2, 600, 2)))[:3]
    assert list(zip((-scores).tolist(), ids.tolist())) == exact
    assert len(visited) < (tree.start >= 0).sum() / 2
