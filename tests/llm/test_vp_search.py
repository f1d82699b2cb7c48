import math

import numpy as np

from rentweave.llm import vp_search as S

SCHEMA = "vec_id long, embedding array<float>, score double, shard string"


def rows(n=400, dim=6, seed=1):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim)).astype(np.float32)
    v[40:120] = v[40]  # one value that many rows have
    v[200:230] = 2 * v[200]  # parallel ones
    return [(i, [float(x) for x in v[i]], 0.0, "s") for i in range(n)]


ODD = [(1000, None), (1001, []), (1002, [0.0] * 6), (1003, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1004, [math.nan] + [1.0] * 5), (1050, [math.inf] + [1.0] * 5), (None, [1.0] * 6), (1100, [1.0, 2.0]), (1101, [2.0, 1.0])]


def brute(data, k=5):
    good = [(i, np.array(v, np.float64)) for i, v, *_ in data if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, a in good:
        if q % 50 == 0:
            scored = [(-(a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())), i) for i, b in good if i != q and len(a) == len(b)]
            out[q] = [(i, s) for s, i in sorted((round(s, 12), i) for s, i in scored)[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], round(-r["score"], 12)))
    return out


def test_exact_at_factor_one_over_several_shards_and_blocks(spark, monkeypatch):
    data = rows() + [(i, v, 0.0, "s") for i, v in ODD]
    vectors = spark.createDataFrame(data, SCHEMA)
    for shard, block in ((8192, 1024), (64, 3)):
        monkeypatch.setattr(S, "SHARD", shard)
        monkeypatch.setattr(S, "BLOCK", block)
        assert found(S.nearest(vectors, vectors.filter("vec_id % 50 = 0"))) == brute(data)


def test_every_query_row_has_its_own_neighbours(spark):
    data = rows() + [(50, rows()[50][1], 0.0, "s"), (50, rows()[77][1], 0.0, "s")]
    vectors = spark.createDataFrame(data, SCHEMA)
    got = S.nearest(vectors, vectors.filter("vec_id = 50")).collect()
    assert sorted(r["rank"] for r in got) == sorted([1, 2, 3, 4, 5] * 3)
    for r in (1, 2, 3, 4, 5):
        assert len([x for x in got if x["rank"] == r]) == 3


def test_fewer_candidates_than_wanted_and_none(spark):
    data = [(0, [1.0, 0.0], 0.0, "s"), (50, [0.0, 1.0], 0.0, "s"), (3, [1.0, 1.0], 0.0, "s")]
    vectors = spark.createDataFrame(data, SCHEMA)
    assert found(S.nearest(vectors, vectors.filter("vec_id % 50 = 0"))) == brute(data)
    assert S.nearest(spark.createDataFrame([], SCHEMA), vectors).collect() == []


def test_a_larger_factor_looks_at_less_and_keeps_recall():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 8))
    v = centres[rng.integers(0, 60, 4000)] + 0.15 * rng.normal(size=(4000, 8))
    q = v[:80] + 0.05 * rng.normal(size=(80, 8))
    truth, looked = None, []
    for factor in (1.0, 1.5):
        tool = S.Search(np.arange(4000), v, 5, factor)
        at, ids, _ = tool.run(np.full(80, -1), q)
        got = [set(ids[at == i].tolist()) for i in range(80)]
        if truth is None:
            unit = v / np.linalg.norm(v, axis=1)[:, None]
            exact = np.argsort(-(q / np.linalg.norm(q, axis=1)[:, None]) @ unit.T, axis=1)[:, :5]
            truth = [set(x.tolist()) for x in exact]
            assert got == truth
        looked.append(tool.looked)
        assert sum(len(a & b) for a, b in zip(got, truth)) >= 0.9 * 400
    assert looked[1] < looked[0] < 0.6 * 80 * 4000
