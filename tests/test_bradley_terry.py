import numpy as np
import pytest

from corpus_curator.operators import bradley_terry as BT

MATCHES = [(0, 1)] * 3 + [(1, 2)] * 2 + [(2, 0)] * 1 + [(0, 2)] * 2


def _matches(spark):
    return spark.createDataFrame([("t", i, w, l) for i, (w, l) in enumerate(MATCHES)],
                                 "task string, pair_id long, winner long, loser long")


def test_gradient_steps(spark):
    got = {r["id"]: r["theta"] for r in BT.bt_gradient(_matches(spark), 0.05, 5).collect()}
    assert [got[0], got[1], got[2]] == pytest.approx(
        [0.4008410829, -0.0951146649, -0.3057264180], abs=1e-9)


def test_gradient_matches_numpy_loop(spark):
    theta = np.zeros(3)
    for _ in range(5):
        g = np.zeros(3)
        for w, l in MATCHES:
            q = 1 / (1 + np.exp(theta[w] - theta[l]))
            g[w] += q
            g[l] -= q
        theta += 0.05 * g
    got = {r["id"]: r["theta"] for r in BT.bt_gradient(_matches(spark), 0.05, 5).collect()}
    assert [got[i] for i in range(3)] == pytest.approx(list(theta), abs=1e-12)


def test_mle_centred(spark):
    got = {r["id"]: r["theta"] for r in BT.bt_scores(_matches(spark)).collect()}
    assert [got[0], got[1], got[2]] == pytest.approx([1.102725, -0.184654, -0.918072], abs=1e-4)
    assert sum(got.values()) == pytest.approx(0.0, abs=1e-9)


def test_loss_decreases(spark):
    m = _matches(spark)
    l0 = BT.bt_loss(m, BT.bt_gradient(m, 0.05, 1)).first()["loss"]
    l5 = BT.bt_loss(m, BT.bt_gradient(m, 0.05, 5)).first()["loss"]
    assert l5 < l0


def test_uniform_scores(spark):
    s = spark.createDataFrame([("t", i, float(v)) for i, v in enumerate([3, 1, 2, 2])],
                              "task string, id long, theta double")
    got = {r["id"]: r["score"] for r in BT.uniform_scores(s).collect()}
    assert got[0] == 99.0 and got[1] == 1.0
    assert sorted(got.values()) == pytest.approx(sorted(99 - k * 98 / 3 for k in range(4)))
    one = spark.createDataFrame([("t", 7, 0.0)], "task string, id long, theta double")
    assert BT.uniform_scores(one).first()["score"] == 99.0
    with pytest.raises(ValueError):
        BT.finalize_scores(s, "other")


def test_to_matches(spark):
    j = spark.createDataFrame([(0, [5, 6], "1"), (1, [5, 6], "2"), (2, [5, 6], "x")],
                              "pair_id long, pair_ids array<long>, win string")
    got = [(r["winner"], r["loser"]) for r in BT.to_matches(j).orderBy("pair_id").collect()]
    assert got == [(5, 6), (6, 5), (6, 5)]


def test_block_diagonal_fit_equals_single_task_fits(spark):
    rows = [("a", i, w, l) for i, (w, l) in enumerate(MATCHES)]
    rows += [("b", 100 + i, l, w) for i, (w, l) in enumerate(MATCHES)]  # mirrored outcomes
    both = spark.createDataFrame(rows, "task string, pair_id long, winner long, loser long")
    got = {(r["task"], r["id"]): r["theta"] for r in BT.bt_scores(both).collect()}
    only_a = {r["id"]: r["theta"] for r in BT.bt_scores(both.filter("task = 'a'")).collect()}
    for i in range(3):
        assert got[("a", i)] == pytest.approx(only_a[i], abs=1e-4)
        assert got[("b", i)] == pytest.approx(-only_a[i], abs=1e-4)


def test_optimality_with_a_prior(spark):
    """At the optimum expected wins equal wins, the prior's games included."""
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 12, (80, 2)) if a != b]
    pairs += [(20, 0), (0, 21)]  # one item only wins, one only loses
    m = spark.createDataFrame([("t", i, w, l) for i, (w, l) in enumerate(pairs)],
                              "task string, pair_id long, winner long, loser long")
    s = {r["id"]: (r["theta"], r["finite"]) for r in BT.bt_scores(
        m, prior=0.5, max_iter=400, tol=1e-5).collect()}
    assert all(f for _, f in s.values())
    theta = {i: t for i, (t, _) in s.items()}
    # the centring shifts the anchor: find the shift at which the prior balances
    def residual(shift):
        out = []
        for i in theta:
            g = sum((w == i) - 1 / (1 + np.exp(theta[l] - theta[w])) * (w == i)
                    - (1 - 1 / (1 + np.exp(theta[l] - theta[w]))) * (l == i)
                    for w, l in pairs if i in (w, l))
            out.append(g + 0.5 - 1 / (1 + np.exp(-theta[i] - shift)))
        return np.array(out)
    best = min((np.abs(residual(x)).max() for x in np.linspace(-3, 3, 6001)))
    assert best < 2e-3


def test_items_without_a_finite_optimum_are_named(spark):
    m = _matches(spark).unionByName(spark.createDataFrame(
        [("t", 50, 8, 0), ("t", 51, 0, 9)], "task string, pair_id long, winner long, loser long"))
    got = {r["id"]: r["finite"] for r in BT.bt_scores(m, max_iter=30, tol=0).collect()}
    assert got == {0: True, 1: True, 2: True, 8: False, 9: False}
    with pytest.raises(RuntimeError, match="still moves"):
        BT.bt_scores(_matches(spark), max_iter=2, tol=1e-9)


def test_mle_recovers_known_theta(spark):
    import math
    theta = [1.0, 0.5, 0.0, -1.5]
    big = 100000
    rows, pid = [], 0
    for i in range(4):
        for j in range(i + 1, 4):
            wins = round(big / (1 + math.exp(theta[j] - theta[i])))
            rows.append(("t", pid, i, j, wins))
            rows.append(("t", pid + 1, j, i, big - wins))
            pid += 2
    counts = spark.createDataFrame(rows, "task string, pair_id long, winner long, loser long, n long")
    # expand the counts into single matches with explode (as judgements would be)
    from pyspark.sql import functions as F
    matches = counts.select("task", "pair_id", "winner", "loser",
                            F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("_k"))
    got = {r["id"]: r["theta"] for r in BT.bt_scores(matches.drop("_k")).collect()}
    mean = sum(theta) / 4
    assert [got[i] for i in range(4)] == pytest.approx([t - mean for t in theta], abs=2e-3)


def _fit(spark, edges, **kw):
    m = spark.createDataFrame([("t", i, w, l) for i, (w, l) in enumerate(edges)],
                              "task string, pair_id long, winner long, loser long")
    return {r["id"]: (r["component"], r["finite"], r["theta"])
            for r in BT.bt_scores(m, **kw).collect()}


def test_chain_has_no_finite_optimum(spark):
    got = _fit(spark, [(1, 2), (2, 3), (3, 4), (9, 9)])
    assert {i: v[:2] for i, v in got.items()} == {i: (i, False) for i in (1, 2, 3, 4, 9)}
    assert all(v[2] is None for v in got.values())


def test_groups_joined_one_way_are_fitted_apart(spark):
    ring = [(0, 1), (1, 2), (2, 0), (0, 2)]
    joined = [(10 + a, 10 + b) for a, b in ring] + [(2, 11), (0, 10)]
    got = _fit(spark, ring + joined + [(20 + a, 20 + b) for a, b in ring], tol=1e-7)
    alone = _fit(spark, ring, tol=1e-7)
    for base in (0, 10, 20):
        for i in range(3):
            component, finite, theta = got[base + i]
            assert (component, finite) == (base, True)
            assert theta == pytest.approx(alone[i][2], abs=1e-6)


def test_components_of_random_graphs(spark):
    from corpus_curator.operators.connectivity import strong_components
    rng = np.random.default_rng(2)
    edges = [(f"g{g}", int(a), int(b)) for g in range(3)
             for a, b in rng.integers(0, 40, (30 + 20 * g, 2))]
    got = {(r["task"], r["id"]): r["component"] for r in strong_components(
        spark.createDataFrame(edges, "task string, a long, b long")).collect()}
    want = {}
    for g in {e[0] for e in edges}:
        out = {}
        for _, a, b in (e for e in edges if e[0] == g):
            out.setdefault(a, set()).add(b)
            out.setdefault(b, set())

        def reach(x):
            seen, todo = {x}, [x]
            while todo:
                for y in out[todo.pop()] - seen:
                    seen.add(y)
                    todo.append(y)
            return seen
        r = {x: reach(x) for x in out}
        want |= {(g, x): min(y for y in r[x] if x in r[y]) for x in out}
    assert got == want


def test_residuals_are_zero_at_the_optimum(spark):
    m = _matches(spark)
    for prior in (0.0, 0.5):
        s = BT.bt_scores(m, prior=prior, tol=1e-8, centre=prior == 0)
        off = [r["residual"] for r in BT.bt_residuals(m, s, prior).collect()]
        assert len(off) == 3 and max(map(abs, off)) < 1e-7


def test_scores_of_two_tasks_reach_their_optima(spark):
    rng = np.random.default_rng(7)
    rows = [(f"t{t}", int(w), int(l)) for t in range(2)
            for w, l in rng.integers(0, 30, (150 + 60 * t, 2)) if w != l]
    m = spark.createDataFrame([(t, i, w, l) for i, (t, w, l) in enumerate(rows)] + [
        ("t0", 999, 3, None), (None, 1000, 1, 2)],
        "task string, pair_id long, winner long, loser long")
    got = {(r["task"], r["id"]): r["theta"] for r in BT.bt_scores(
        m, prior=0.5, tol=1e-6, centre=False).collect()}
    for task in ("t0", "t1"):
        n = np.zeros((30, 30))
        for t, w, l in rows:
            n[w, l] += t == task
        ids = np.flatnonzero((n + n.T).sum(1))
        theta = np.array([got[task, int(i)] for i in ids])
        n = n[np.ix_(ids, ids)]
        p = 1 / (1 + np.exp(theta[None] - theta[:, None]))
        off = n.sum(1) - ((n + n.T) * p).sum(1) + 0.5 - 1 / (1 + np.exp(-theta))
        assert np.abs(off).max() < 2e-6
    assert got["t0", None] is None


def test_a_pass_leaves_the_pairs_where_they_are(spark):
    items = spark.createDataFrame([(i, 0, 1, 0.1 * i) for i in range(8)],
                                  "node long, grp long, wins long, theta double")
    pairs = spark.createDataFrame([(i, j, 1) for i in range(8) for j in range(8) if i != j],
                                  "node long, other long, n long")
    weights, start = BT._linearised(items, pairs, 0.5, 4)
    assert weights.count() == 56
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = BT._imaged(start, weights)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    weights.unpersist()
    # down to the layout of the pairs: the state and the sums move, the pairs do not
    above = plan.split("InMemoryTableScan")[0]
    assert "InMemoryTableScan" in plan and above.count("Exchange hashpartitioning") == 2
