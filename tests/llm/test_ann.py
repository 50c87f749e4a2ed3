import numpy as np
from pyspark.sql import functions as F

from corpus_curator.llm import ann

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)


def brute(rows, queries, k=5):
    v = {i: np.asarray(x, np.float32).astype(float) for i, x in rows}
    out = {}
    for q in queries:
        score = {i: v[i] @ v[q] / (np.linalg.norm(v[i]) * np.linalg.norm(v[q]))
                 for i in v if i != q}
        out[q] = sorted(score.items(), key=lambda x: (-round(x[1], 12), x[0]))[:k]
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.standard_normal(24).astype(np.float32).tolist()) for i in range(1500)]
    data = table(spark, rows)
    got = ann.nearest(data, data.filter(F.col("vec_id") % 50 == 0), shard=400).collect()
    want = brute(rows, range(0, 1500, 50))
    hits = 0
    for q, best in want.items():
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        scores = [r.score for r in mine]
        assert scores == sorted(scores, reverse=True)
        hits += len({r.vec_id for r in mine} & {i for i, _ in best})
        for r in mine:
            for i, s in best:
                assert i != r.vec_id or abs(s - r.score) < 1e-12
    assert hits / (5 * len(want)) >= 0.9


def test_ties_copies_and_unusable_rows(spark):
    same = [1.0, 2.0, 0.0]
    rows = [(i, same) for i in range(100, 130)] + [
        (0, same), (50, [0.0, 0.0, 0.0]), (51, None), (52, [1.0, None, 2.0]),
        (53, [float("nan"), 1.0, 1.0]), (54, [float("inf"), 1.0, 1.0]), (200, [1.0, 0.0]),
        (None, same), (100, same), (150, [2.0, 4.0, 0.0]), (55, [])]
    data = table(spark, rows)
    got = ann.nearest(data.withColumn("score", F.lit(1)).withColumn("shard", F.lit(2)),
                      data.filter("vec_id in (0, 50, 100, 200)")).collect()
    mine = {q: [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q]
            for q in (0, 50, 100, 200)}
    # 100 stands twice: it is found twice, asks twice, and each of the two finds the other
    assert mine[0] == [100, 100, 101, 102, 103]
    assert mine[100] == [0, 0, 100, 100, 101, 101, 102, 102, 103, 103]
    assert mine[50] == [] and mine[200] == []


def test_few_candidates_and_empty(spark):
    data = table(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])])
    got = ann.nearest(data, data.filter("vec_id = 0")).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"])] == [1, 2]
    assert ann.nearest(table(spark, []), table(spark, [])).collect() == []


def test_pruning_keeps_diverse_neighbours():
    x = np.array([[1, 0], [0.999, 0.045], [0.998, 0.063], [0.9, -0.436]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    kept = ann.robust_prune(x, np.array([0]), np.array([[1, 2, 3]]), 2, 1.2)[0]
    assert kept.tolist() == [1, 3]


def _lists(got):
    out = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 3)))
    return out


def test_rows_that_share_an_id_are_candidates(spark):
    data = table(spark, [(0, [1.0, 0.0]), (7, [1.0, 0.0]), (7, [0.0, 1.0]), (8, [.5, .5])])
    got = ann.nearest(data, data.filter("vec_id = 0")).collect()
    assert _lists(got) == {0: [(7, 1.0), (8, 0.707), (7, 0.0)]}


def test_extreme_magnitudes(spark):
    rows = [(0, [1.0, 0.0]), (1, [1e200, 1e200]), (2, [1e-200, 1e-200]), (3, [0.0, 5e-324]),
            (4, [-1.7e308, 0.0])]
    data = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = ann.nearest(data, data.filter("vec_id = 0")).collect()
    found = _lists(got)[0]
    assert sorted(found[:2]) == [(1, 0.707), (2, 0.707)] and found[2:] == [(3, 0.0), (4, -1.0)]


def test_recall_over_many_shards(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(16).astype(np.float32).tolist()) for i in range(1200)]
    data = table(spark, rows)
    got = _lists(ann.nearest(data, data.filter(F.col("vec_id") % 50 == 0), shard=20).collect())
    want = brute(rows, range(0, 1200, 50))
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in best}) for q, best in want.items())
    assert hits / (5 * len(want)) >= 0.9
