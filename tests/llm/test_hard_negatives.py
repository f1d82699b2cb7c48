import os

import numpy as np
import pandas as pd
import pytest

from checks.compare import compare, duck
from rentweave.llm import hard_negatives as H
from rentweave.llm.query_hard_negatives import QUERIES

SCHEMA = "id long, label long, v array<double>, anchor boolean, row long, dim string, block int"
BIG = 1 << 62


def usable(r):
    return r[1] is not None and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[2]) and sum(x * x for x in r[2]) < 2.0**59


def brute(rows, k=5, low=80, high=100):
    rows = [(r[0], r[1], [int(x) for x in r[2]], r[3]) for r in rows if usable(r)]
    out = []
    for i, (a, label, v, anchor) in enumerate(rows):
        if not anchor or a is None:
            continue
        score = [(sum(x * y for x, y in zip(v, w[2])), w) for j, w in enumerate(rows) if j != i and len(w[2]) == len(v)]
        score.sort(key=lambda x: (-x[0], BIG if x[1][0] is None else x[1][0]))
        for goal, p in [s for s in score if s[1][1] == label][:k]:
            near = [s for s in score if s[1][1] != label and low * goal <= 100 * s[0] <= high * goal][:k]
            out += [(a, p[0], n + 1, w[0], goal, s) for n, (s, w) in enumerate(near)]
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)


def found(spark, rows, **more):
    return sorted((tuple(r) for r in H.mine(frame(spark, rows), **more).collect()), key=repr)


def clustered(rng, n, dim=6, groups=5):
    middle = rng.integers(-200, 200, (groups, dim))
    return [(i, int(rng.integers(3)), (middle[rng.integers(groups)] + rng.integers(-30, 30, dim)).astype(float).tolist(), i % 9 == 0) for i in range(n)]


@pytest.mark.parametrize("block,values,wave", [(1024, 1 << 19, 8 << 20), (4, 300, 100)])
def test_equals_brute_force(spark, monkeypatch, block, values, wave):
    monkeypatch.setattr(H, "BLOCK", block)
    monkeypatch.setattr(H, "SHARD_VALUES", values)
    monkeypatch.setattr(H, "WAVE_BYTES", wave)
    monkeypatch.setattr(H, "PER_CENTRE", 8)
    rows = clustered(np.random.default_rng(4), 180)
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows, k=2, low=50, high=95) == brute(rows, 2, 50, 95)


def test_odd_rows(spark):
    rng = np.random.default_rng(8)
    rows = clustered(rng, 40)
    rows += [(None, 1, rows[0][2], True), (None, 2, rows[9][2], False), (9, 0, rows[9][2], True), (9, 0, rows[9][2], True)]
    rows += [(200, None, rows[0][2], True), (201, 1, None, True), (202, 1, [1.0, None, 2.0, 3.0, 4.0, 5.0], True), (203, 1, [float("nan")] * 6, True)]
    rows += [(204, 1, [float("inf")] * 6, False), (205, 2, [0.0] * 6, True), (206, 1, [], True), (207, 1, [], False), (208, 2, [], False)]
    rows += [(209, 1, [3.0, 4.0], True), (210, 1, [5.0, 4.0], False), (211, 0, [4.0, 4.0], False), (212, 1, [1e9] * 6, True)]
    rows += [(300 + i, i % 2, [7.0] * 6, i % 4 == 0) for i in range(60)]  # a third of all rows is one vector
    assert found(spark, rows) == brute(rows)


def test_scores_beyond_doubles(spark):
    rng = np.random.default_rng(2)
    rows = [(i, i % 2, (rng.integers(-(2**26), 2**26, 8) + 2**27).astype(float).tolist(), i < 4) for i in range(40)]
    assert max(r[4] for r in brute(rows)) > 2**53
    assert found(spark, rows) == brute(rows)


def test_nothing_to_find(spark):
    assert H.mine(frame(spark, []).limit(0)).collect() == []
    assert found(spark, [(1, 1, [1.0], False)]) == [] == found(spark, [(1, 1, [1.0], True)])
    assert found(spark, [(1, 1, [1.0], True), (2, 1, [-1.0], False), (3, 0, [-1.0], False)]) == []


def shared(rng, n, anchors):
    middle = rng.normal(size=(8, 16)) * 200
    points = np.floor(middle[rng.integers(8, size=n)] + rng.normal(size=(n, 16)) * 10)
    near = np.floor(middle[0] + rng.normal(size=(anchors, 16)) * 10)
    frame = lambda v, first: pd.DataFrame({"id": np.arange(first, first + len(v)), "label": 1, "row": np.arange(first, first + len(v)), "v": list(v)})
    return H.List(frame(points, 0), frame(near, n), 16), len(near), points, near


def test_walk_ends_early_on_clusters_and_is_exact():
    tool, anchors, points, near = shared(np.random.default_rng(1), 6000, 40)
    best = H.Best(anchors, 5)
    tool.walk(best, np.arange(anchors), np.full(anchors, -np.inf), lambda a, s, score: np.ones(score.shape, bool))
    assert tool.seen < 0.4 * anchors * 6000
    want = np.sort(near @ points.T, axis=1)[:, ::-1][:, :5]
    assert best.found[1].reshape(anchors, 5).tolist() == want.tolist()


def test_bound_holds():
    rng = np.random.default_rng(6)
    for _ in range(50):
        a, p = rng.normal(size=(20, 5)) + rng.normal(size=5) * 3, rng.normal(size=(200, 5)) * rng.integers(1, 50)
        centre = H.unit(H.unit(a).sum(axis=0, keepdims=True))
        width = np.arccos(np.clip(H.unit(a) @ centre[0], -1, 1)).max(keepdims=True)
        assert (H.bounds(p, centre, width) >= (p @ H.unit(a).T).max(axis=1, keepdims=True)).all()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="driver tables are not there")
def test_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    line = compare(spark, duck(sf), "op12", *QUERIES["op12_hard_negatives"], sf)
    assert line.startswith("ok"), line
