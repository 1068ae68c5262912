import hashlib

import duckdb
import numpy as np
import pytest

from nestql.llm import mixing as M


def test_raked_margins_meet_their_targets():
    rng = np.random.default_rng(1)
    values = [np.repeat(np.arange(4), 6), np.tile(np.repeat(np.arange(3), 2), 4), np.tile(np.arange(2), 12)]
    targets = [np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.5, 0.3, 0.2]), np.array([0.6, 0.4])]
    x = M.rake(values, rng.uniform(1, 9, 24), targets, rounds=100)
    for v, t in zip(values, targets):
        assert np.allclose(np.bincount(v, weights=x), t, atol=1e-6)


def test_probabilities_spend_the_budget():
    rng = np.random.default_rng(2)
    for keep in (0.05, 0.5, 0.8, 1.0):
        sums = rng.uniform(0, 9, 30) * (rng.uniform(size=30) > 0.2)
        p = M.probabilities(sums, rng.uniform(0.1, 9, 30) * (sums > 0), keep)
        assert ((0 <= p) & (p <= 1)).all() and (p[sums == 0] == keep).all()
        assert np.isclose((p * sums).sum(), keep * sums.sum())


ROWS = [(i, "w " * (i % 7) + ("x@y" if i % 3 else " | "), f"s{i % 4}", ["en", "de", None][i % 3], "e") for i in range(200)]
ROWS += [(300, None, None, None, None), (301, "", "s0", "en", None), (302, "q " * 50_000, "s1", "en", "e"), (None, "a b", "s2", "de", "e"), (7, "a b", "s2", "de", "e")]


@pytest.mark.parametrize("max_cells", [M.MAX_CELLS, 1])
@pytest.mark.parametrize("targets", [None, {"source": {"s0": 0.5, "s1": 0.2, "s2": 0.3}}])
def test_cases(spark, max_cells, targets):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string, lang string, Kept string")
    out = M.mix(df, targets=targets, max_cells=max_cells, rounds=4).collect()
    assert len(out) == len(ROWS)
    cells = {}
    for r in out:
        key = (r.source or "", r.lang or "", r.topic)
        cells[key] = cells.get(key, 0) + len((r.text or "").split())
        assert r.n_tokens == len((r.text or "").split())
        u = int(hashlib.md5(f"{'' if r.doc_id is None else r.doc_id}:mix".encode()).hexdigest()[:8], 16) / 2**32
        assert r.kept == (u < r.prob)
    keys = sorted(cells)
    sums = np.array([float(cells[k]) for k in keys])
    values, shares = [], []
    for i, m in enumerate(M.MARGINS):
        names = sorted({k[i] for k in keys})
        at = np.array([names.index(k[i]) for k in keys])
        have = np.bincount(at, weights=sums, minlength=len(names))
        raw = np.array([targets[m].get(n, 0.0) for n in names]) if targets and m in targets else np.where(have > 0, have**M.TEMPER, 0)
        values.append(at)
        shares.append(raw / raw.sum())
    p = dict(zip(keys, M.probabilities(sums, M.rake(values, sums, shares, 4), M.KEEP)))
    for r in out:
        assert abs(r.prob - p[(r.source or "", r.lang or "", r.topic)]) < 1e-9
    assert M.mix(df.limit(0), max_cells=max_cells).collect() == []


def test_query_matches_sql(spark, sf_dir):
    out = M.op7_mixing(spark, sf_dir).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.execute(M.SQL["op7_mixing"]).df()
    assert sorted(map(tuple, out[sorted(out)].values.tolist())) == sorted(map(tuple, want[sorted(want)].values.tolist()))


@pytest.mark.parametrize("max_cells", [M.MAX_CELLS, 1])
def test_calibrated_shares_meet_the_targets(spark, max_cells):
    rows = [(i, "w " * (5 + i % 11), "big" if i % 10 else f"s{i % 3}", "en" if i % 7 else "de") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    goal = {"source": {"big": 0.8, "s0": 0.08, "s1": 0.07, "s2": 0.05}, "lang": {"en": 0.6, "de": 0.4}}

    def shares(out, weight, margin):
        all_ = sum(weight(r) for r in out)
        return {v: sum(weight(r) for r in out if r[margin] == v) / all_ for v in goal[margin]}

    def missed(weight, out):
        return max(abs(x - goal[m][v]) for m in goal for v, x in shares(out, weight, m).items())

    expected, drawn = lambda r: r.prob * r.n_tokens, lambda r: r.kept * r.n_tokens
    out = M.mix(df, targets=goal, keep=0.34, max_cells=max_cells, calibrated=True).collect()
    assert missed(expected, out) < 1e-3 and missed(drawn, out) < 0.02 and max(r.prob for r in out) == 1
    assert np.isclose(sum(map(expected, out)), 0.34 * sum(r.n_tokens for r in out))
    plain = M.mix(df, targets=goal, keep=0.34, max_cells=max_cells).collect()
    assert missed(expected, plain) > 0.005


def test_unreachable_targets_are_filled_as_far_as_they_go(spark):
    sums = np.array([90.0, 6.0, 4.0])
    at, one = np.arange(3), np.zeros(3, np.int64)
    p = M.probabilities(sums, M.rake_bounded([at, one, one], sums, [np.array([0.5, 0.4, 0.1]), np.ones(1), np.ones(1)], 0.5), 0.5)
    # of 50 tokens 20 are wanted of the second, which has 6; the others share 44 as 5 to 1, but the third has 4
    assert np.allclose(p * sums, [40, 6, 4])
    few = M.reachable(np.array([0.1, 2.0, 2.0, 1.0]), np.array([0.5, 0.4, 0.1, 0.0]))
    assert np.allclose(few, [0.1, 0.72, 0.18, 0])


def brute_calibrated(sums, values, targets, keep):
    """Probabilities min(1, product of a factor for each margin value): one factor after the other is set by bisection, again and again."""
    factors = [np.full(len(t), keep) for t in targets]
    factors[1:] = [np.ones(len(t)) for t in targets[1:]]
    budget = keep * sums.sum()
    for _ in range(200):
        for m, (v, t) in enumerate(zip(values, targets)):
            rest = np.prod([f[w] for k, (f, w) in enumerate(zip(factors, values)) if k != m], axis=0)
            for g in range(len(t)):
                own = v == g
                low, high = 0.0, 1e12
                for _ in range(120):
                    mid = (low * high) ** 0.5 if low else high * 1e-3
                    if (np.minimum(1, rest[own] * mid) * sums[own]).sum() < t[g] * budget:
                        low = mid
                    else:
                        high = mid
                factors[m][g] = high
        p = np.minimum(1, np.prod([f[v] for f, v in zip(factors, values)], axis=0))
        if max(np.abs(np.bincount(v, weights=p * sums) - t * budget).max() for v, t in zip(values, targets)) < 1e-9 * budget:
            break
    return p


def brute_targets(have):
    """Own shares to the power of TEMPER, held to LIFT times the own ones: the others' factor by bisection."""
    own, raw = have / have.sum(), np.where(have > 0, have**M.TEMPER, 0)
    low, high = 0.0, 1e9
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if np.minimum(M.LIFT * own, mid * raw).sum() < 1 else (low, mid)
    return np.minimum(M.LIFT * own, high * raw)


def corpus(spark, n=30_000):
    rows = [(i, "w " * (5 + i % 11) + ("x@y" if i % 13 == 0 else " | " if i % 29 == 0 else ""), f"s{i * i % 17 % 5}", "en" if i % 7 else "de") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")


@pytest.mark.parametrize("max_cells", [M.MAX_CELLS, 1])
def test_kept_share_is_lowered_until_targets_are_met(spark, max_cells):
    mixed = M.to_targets(corpus(spark, 30_000 if max_cells > 1 else 2000), max_cells=max_cells, **({} if max_cells > 1 else {"targets": {"lang": {"en": 0.5, "de": 0.5}}})).cache()
    got = M.shares(mixed).toPandas()
    assert set(got.margin) == set(M.MARGINS) and np.allclose(got.groupby("margin")[["target", "own", "expected", "achieved"]].sum(), 1)
    assert (got.expected - got.target).abs().max() < 1e-6 and (got.own - got.target).abs().max() > 0.02
    if max_cells > 1:
        assert (got.achieved - got.target).abs().max() < 0.01
    rows = mixed.toPandas()
    share = (rows.prob * rows.n_tokens).sum() / rows.n_tokens.sum()
    assert abs(share - min(M.KEEP, M.FILL * (got.own / got.target).min())) < 1e-6 and rows.prob.max() <= 1
    mixed.unpersist()


def test_query_meets_its_targets(spark, sf_dir):
    out = M.op7_mixing(spark, sf_dir).toPandas()
    out["source"], out["lang"] = out.source.fillna(""), out.lang.fillna("")
    cells = out.groupby(list(M.MARGINS)).agg(tokens=("n_tokens", "sum"), prob=("prob", "first"))
    expected = cells.tokens * cells.prob
    for m in M.MARGINS:
        goal = out.groupby(m)[f"target_{m}"].first()
        assert (expected.groupby(m).sum() / expected.sum() - goal).abs().max() < 1e-4
    values = [np.unique(cells.reset_index()[m], return_inverse=True)[1] for m in M.MARGINS]
    sums = cells.tokens.to_numpy(float)
    have = [np.bincount(v, weights=sums) for v in values]
    targets = [brute_targets(h) for h in have]
    keep = min(M.KEEP, M.FILL * min(float((h / h.sum() / t).min()) for h, t in zip(have, targets)))
    assert np.abs(brute_calibrated(sums, values, targets, keep) - cells.prob).max() < 1e-5


@pytest.mark.parametrize("max_cells", [M.MAX_CELLS, 1])
def test_rare_values_dont_make_others_rare(spark, max_cells):
    rows = [(i, "w " * 10, "big" if i else "rare", "en") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    mixed = M.to_targets(df, max_cells=max_cells).cache()
    got = {r.value: r for r in M.shares(mixed).filter("margin = 'source'").collect()}
    assert abs(got["rare"].target - M.LIFT / 3000) < 1e-9 and abs(got["rare"].expected - got["rare"].target) < 1e-9
    total = sum(r.prob * r.n_tokens for r in mixed.collect()) / 30_000
    assert abs(total - M.FILL / M.LIFT) < 1e-6
    mixed.unpersist()


def test_topics_of_a_column(spark):
    df = corpus(spark, 500).selectExpr("*", "case when doc_id % 5 = 0 then 'law' when doc_id % 5 < 4 then 'sport' end as Subject")
    out = M.mix(df, topic_column="subject").toPandas()
    assert set(out.topic) == {"law", "sport", M.OTHER} and (out.topic == "law").sum() == 100
    assert "subject" in [c.lower() for c in out.columns]
