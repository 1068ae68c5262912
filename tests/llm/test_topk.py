import math
import random

import numpy as np
import pytest

from nestql.llm import topk as T


def brute(rows, asked, k):
    sound = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for qi, q in {(i, tuple(v)) for i, v in sound if i in asked}:
        scored = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in sound if i != qi)
        out += [(qi, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("dim,copies", [(1, 1), (7, 3), (64, 200)])
def test_members_hold_the_best(dim, copies):
    rng = np.random.default_rng(dim)
    x = T.matrix(list(np.repeat(rng.normal(size=(300, dim)), [copies if i == 5 else 1 for i in range(300)], axis=0)), dim)
    ids = np.arange(len(x))
    index = T.Index(x)
    asked = list(range(0, len(x), 9))
    may = index.members(x[asked], 10, [np.array([a]) for a in asked])
    for a, rows in zip(asked, may):
        scores = x @ x[a]
        want = sorted((-int(scores[j]), j) for j in range(len(x)) if j != a)[:10]
        assert index.best(x[a], 10, rows, ids) == [(-s, j) for s, j in want]


@pytest.mark.parametrize("block,query_block", [(4096, 4096), (16, 4)])
def test_cases(spark, block, query_block):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(60)]
    rows += [(i, rows[10][1]) for i in range(60, 100)]  # ties
    rows += [(100, None), (101, [1.0, None]), (102, [float("nan")]), (103, [float("inf"), 1.0]), (104, []), (105, [2.0]), (None, [1.0] * 5), (106, [-0.0004, 3e4, 0.0, 0.0, 1e4])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, Score string")
    got = T.top_k(df, df.filter("vec_id % 10 = 0"), k=4, block=block, query_block=query_block)
    assert sorted(map(tuple, got.collect())) == brute(rows, set(range(0, 200, 10)), 4)
    assert T.top_k(df.limit(0), df, k=4).collect() == [] and T.top_k(df, df.limit(0), k=4).collect() == []


def test_large_components_and_repeated_rows(spark):
    rows = [(0, [1e12, -1e12]), (1, [3e12, 1.0]), (2, [1.0, 2e9]), (3, [-1e12, 5.0]), (3, [-1e12, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in T.top_k(df, df.filter("vec_id = 2"), k=9).orderBy("rank").collect()]
    scaled = {i: [math.floor(1024 * x) for x in v] for i, v in rows}
    hold = lambda s: max(min(s, 2**63 - 1), -(2**63))
    score = {i: hold(sum(a * b for a, b in zip(scaled[2], v))) for i, v in scaled.items()}
    want = sorted([(-score[i], i) for i in (0, 1, 3, 3)])
    assert [(s, i) for _, _, i, s in got] == [(-s, i) for s, i in want]


def test_very_long_vectors_lengthen_no_others(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(120)]
    rows += [(200, [rng.gauss(0, 1) for _ in range(300_000)]), (210, [0.5] * 250_000), (211, []), (220, [rng.gauss(0, 1) for _ in range(40)])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, T.top_k(df, df.filter("vec_id % 10 = 0"), k=4).collect()))
    assert got == brute(rows, set(range(0, 300, 10)), 4)
    lengths = np.array([6] * 120 + [300_000, 40, 0])
    assert T.width_of(lengths) == 40 and T.width_of(np.array([0, 0])) == 0 and T.width_of(np.array([9000])) == 0 and T.width_of(np.array([5, 4096])) == 4096
    assert T.width_of(np.array([6] * 120 + [4096])) == 6


def test_segments_hold_the_impacts():
    rng = np.random.default_rng(7)
    x = (rng.normal(size=(200, 9)) * 900).astype(np.int64)
    x[:, 3] = 0
    index = T.Index(x)
    assert {isinstance(s, tuple) for s in index.segments} == {True, False}
    q = rng.integers(-50, 50, (5, 9)).astype(float)
    q[:, 4] = 0
    q[2] = 0
    sums, seen = np.zeros((5, 200)), 0
    for level in range(index.levels - 1, -1, -1):
        index.process(sums, q, level)
        seen |= 1 << level
        part = np.sign(x) * (np.abs(x) & seen)
        assert np.array_equal(sums, q @ part.T)
        assert np.allclose(index.rests[level], np.linalg.norm(np.abs(x) & ~seen, axis=1))


@pytest.mark.parametrize("scale", [1, 2**12, 2**24])
def test_bounds_are_proofs(scale):
    """Close scores of large components, where floating-point sums round."""
    rng = np.random.default_rng(scale)
    base = rng.integers(-scale, scale, 64)
    x = base + rng.integers(-1, 2, (500, 64))
    may = T.Index(x).members(x[:20], 10, [np.array([i]) for i in range(20)])
    for i, rows in enumerate(may):
        scores = [sum(int(a) * int(b) for a, b in zip(r, x[i])) for r in x]
        best = sorted((j for j in range(500) if j != i), key=lambda j: (-scores[j], j))[:10]
        least = scores[best[-1]]
        assert {j for j in range(500) if j != i and scores[j] >= least} <= set(rows.tolist())


def test_query_matches_brute_force(spark, sf_dir):
    x = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    got = sorted(map(tuple, T.op1_topk_search(spark, sf_dir).collect()))
    e = np.floor(1024 * np.stack(x.embedding).astype(float)).astype(np.int64)
    want = []
    for i in np.flatnonzero(x.vec_id % 100 == 0):
        scored = sorted((-int(s), int(v)) for v, s in zip(x.vec_id, e @ e[i]) if v != x.vec_id[i])[:10]
        want += [(int(x.vec_id[i]), r, v, -s) for r, (s, v) in enumerate(scored, 1)]
    assert got == sorted(want)
