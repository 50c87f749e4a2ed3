import math
import random

import pytest
from pyspark.sql import functions as F

from corpus_curator.functions.rand import uniform
from corpus_curator.operators import sampling


def _df(spark, weights):
    return spark.createDataFrame([(f"k{i}", w) for i, w in enumerate(weights)],
                                 "uuid string, weight double")


def test_errors_like_pandas(spark):
    with pytest.raises(ValueError):
        sampling.weighted_sample(_df(spark, [0.0, 0.0, 1.0]), 2)
    with pytest.raises(ValueError):
        sampling.weighted_sample(_df(spark, [-1.0, 1.0, 1.0]), 1)
    with pytest.raises(ValueError):
        sampling.weighted_sample(_df(spark, [float("inf"), 1.0]), 1)
    with pytest.raises(ValueError):
        sampling.weighted_sample(_df(spark, [1.0, 1.0]), 3)
    assert sampling.weighted_sample(_df(spark, [1.0, 1.0]), 3, cap=True).count() == 2


def test_null_weight_is_zero(spark):
    out = sampling.weighted_sample(_df(spark, [None, 1.0, 1.0]), 2)
    assert sorted(r["uuid"] for r in out.collect()) == ["k1", "k2"]


def _brute(rows, n):
    return sorted(rows, key=lambda r: (r[1], r[0]))[:n]


def test_exact_selection_matches_sort(spark):
    rnd = random.Random(3)
    rows = [(f"id{i:05d}", rnd.random() ** 3 + 1e-9) for i in range(3000)]
    df = spark.createDataFrame(rows, "uuid string, k double").repartition(7)
    for n in (1, 17, 1500, 2999, 3000, 5000):
        got = sorted(r["uuid"] for r in sampling.select_smallest(df, "k", "uuid", n).collect())
        assert got == sorted(r[0] for r in _brute(rows, n)), n
    # refinement path: tiny boundary-bucket limit and coarse buckets
    got = sorted(r["uuid"] for r in sampling.select_smallest(df, "k", "uuid", 1234,
                                                                 resolution=2).collect())
    assert got == sorted(r[0] for r in _brute(rows, 1234))


def test_grouped_selection_matches_sort(spark):
    rnd = random.Random(5)
    rows = [(f"id{i:05d}", f"g{i % 3}", rnd.random() + 1e-9) for i in range(2000)]
    df = spark.createDataFrame(rows, "uuid string, g string, k double")
    need = spark.createDataFrame([("g0", 10), ("g1", 500), ("g2", 5000)], "g string, need long")
    got = sorted(r["uuid"] for r in sampling.select_smallest(df, "k", "uuid", need, by=["g"]).collect())
    want = []
    for g, q in (("g0", 10), ("g1", 500), ("g2", 5000)):
        want += [r[0] for r in _brute([(u, k) for u, gg, k in rows if gg == g], q)]
    assert got == sorted(want)


def test_inclusion_rates_follow_successive_draws(spark):
    # weights 1,2,3,4,10, n=2: exact successive-draw inclusion probabilities
    expected = [0.127, 0.248, 0.362, 0.468, 0.795]
    seeds = 3000
    rows = [(f"{s}:{i}", str(s), w) for s in range(seeds) for i, w in enumerate([1.0, 2.0, 3.0, 4.0, 10.0])]
    df = spark.createDataFrame(rows, "uuid string, seed string, weight double")
    quotas = {str(s): 2 for s in range(seeds)}
    out = sampling.weighted_sample_by(df, quotas, by="seed", seed=11)
    counts = out.groupBy(F.split("uuid", ":")[1].alias("i")).count().collect()
    rate = {int(r["i"]): r["count"] / seeds for r in counts}
    for i, e in enumerate(expected):
        assert abs(rate[i] - e) < 0.03, (i, rate[i], e)


def test_partition_count_invariance(spark):
    df = _df(spark, [float(i % 7 + 1) for i in range(500)])
    base = None
    for p in (1, 4, 16):
        got = sorted(r["uuid"] for r in sampling.weighted_sample(df.repartition(p), 100,
                                                                  seed=9).collect())
        base = base or got
        assert got == base


def test_uniform_is_in_open_unit_interval(spark):
    r = spark.range(1000).select(uniform("id", 1).alias("u")).agg(
        F.min("u").alias("lo"), F.max("u").alias("hi")).first()
    assert 0 < r["lo"] and r["hi"] < 1


def test_assign_batches_last_short(spark):
    df = spark.range(45).withColumnRenamed("id", "doc_id")
    out = sampling.assign_batches(df, 20, order_by=["doc_id"])
    sizes = sorted(r["count"] for r in out.groupBy("batch_id").count().collect())
    assert sizes == [5, 20, 20]


def test_grouped_selection_with_wide_buckets(spark):
    rnd = random.Random(8)
    rows = [(f"id{i:05d}", "hot" if i % 4 else "cold", rnd.random() + 1e-9) for i in range(3000)]
    df = spark.createDataFrame(rows, "uuid string, g string, k double")
    need = spark.createDataFrame([("hot", 1100), ("cold", 300)], "g string, need long")
    got = sorted(r["uuid"] for r in sampling.select_smallest(df, "k", "uuid", need, by=["g"],
                                                                 resolution=1).collect())
    want = []
    for g, q in (("hot", 1100), ("cold", 300)):
        want += [r[0] for r in _brute([(u, k) for u, gg, k in rows if gg == g], q)]
    assert got == sorted(want)


def test_slice_by_position(spark):
    df = spark.range(100).selectExpr("id * 3 as k")
    got = [r["k"] for r in sampling.slice_input(df, 10, 5, order_by=["k"]).collect()]
    assert got == [30, 33, 36, 39, 42]


def test_quota_dict_exact_per_group(spark):
    rows = [(f"k{i}", "a" if i < 300 else "b", float(i % 9 + 1)) for i in range(500)]
    df = spark.createDataFrame(rows, "uuid string, dataset string, weight double")
    out = sampling.weighted_sample_by(df, {"a": 40, "b": 7}, seed=2)
    got = {r["dataset"]: r["count"] for r in out.groupBy("dataset").count().collect()}
    assert got == {"a": 40, "b": 7}


def test_shuffle_partition_setting_invariance(spark):
    from corpus_curator.operators.rank import global_rank
    rows = [(f"k{i}", f"g{i % 3}", float(i % 11 + 1)) for i in range(600)]
    df = spark.createDataFrame(rows, "uuid string, g string, weight double")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for p in ("1", "4", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", p)
            s = sorted(r["uuid"] for r in sampling.weighted_sample_by(
                df, {"g0": 50, "g1": 60, "g2": 70}, by="g", seed=4).collect())
            r = sorted(tuple(x) for x in global_rank(df, ["weight", "uuid"], by=["g"],
                                                     name="r").select("uuid", "r").collect())
            results.append((s, r))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert results[0] == results[1] == results[2]


def test_exact_numbers_with_repeated_keys(spark):
    rows = [("same", 1.0)] * 200 + [(f"k{i % 50}", 1.0 + i % 2) for i in range(100)]
    df = spark.createDataFrame(rows, "uuid string, weight double").repartition(6)
    for n in (1, 37, 101, 150, 299, 300):
        assert sampling.weighted_sample(df, n, seed=1).count() == n
        assert sampling.sample_k(df, n, "uuid", seed=1).count() == n
    by = df.withColumn("dataset", F.when(F.col("uuid") == "same", "a").otherwise("b"))
    got = sampling.weighted_sample_by(by, {"a": 77, "b": 31}, seed=1)
    assert {r["dataset"]: r["count"] for r in got.groupBy("dataset").count().collect()} == {
        "a": 77, "b": 31}
    wide = sampling.weighted_sample(df.withColumn("n", F.monotonically_increasing_id()), 101,
                                    key=["uuid", "n"], seed=1)
    assert wide.count() == 101


def test_weights_that_are_not_finite_are_refused(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", float("inf")), ("c", 2.0)],
                               "uuid string, weight double")
    with pytest.raises(ValueError, match="infinite"):
        sampling.weighted_sample(df, 1, seed=1)


def test_rating_flow_draws_beside_an_overflowing_score(spark):
    """z of the outlier is 836: its weight is no double, its log weight is."""
    from corpus_curator.plans import flows
    rows = spark.range(700_000).selectExpr("concat('k', id) AS uuid", "'0' AS s")
    df = rows.unionByName(spark.createDataFrame([("out", "100")], "uuid string, s string"))
    got = [r["uuid"] for r in flows.rating_sample(df, n=5, fields=["s"],
                                                  weights={"s": 1.0}).collect()]
    assert len(got) == 5 and "out" in got


def test_log_weights_draw_the_same_rows(spark):
    rnd = random.Random(6)
    rows = [(f"k{i}", f"g{i % 3}", w, math.log(w) if w else float("-inf"))
            for i, w in enumerate([rnd.random() ** 4 * 10 ** rnd.randrange(-5, 5)
                                   for _ in range(900)] + [0.0] * 20)]
    rows.append(("none", "g0", None, None))
    df = spark.createDataFrame(rows, "uuid string, dataset string, weight double, lw double")
    plain = sampling.weighted_sample(df, 300, seed=3).select("uuid")
    logs = sampling.weighted_sample(df, 300, seed=3, log_weight="lw").select("uuid")
    assert sorted(plain.collect()) == sorted(logs.collect())
    quota = {"g0": 20, "g1": 30, "g2": 290}
    plain = sampling.weighted_sample_by(df, quota, seed=3).select("uuid")
    logs = sampling.weighted_sample_by(df, quota, seed=3, log_weight="lw").select("uuid")
    assert sorted(plain.collect()) == sorted(logs.collect()) and plain.count() == 340
    bad = df.withColumn("lw", F.when(F.col("uuid") == "k1", float("inf")).otherwise(F.col("lw")))
    with pytest.raises(ValueError, match="infinite"):
        sampling.weighted_sample(bad, 3, log_weight="lw")


def test_crowded_buckets_are_divided(spark):
    """Most keys in one bucket, many of them equal: divided, then ranked by ties."""
    rows = spark.range(60_000).select(
        F.format_string("%06d", "id").alias("uuid"), (F.col("id") % 2).cast("string").alias("g"),
        (1.0 + F.floor(F.col("id") / 3) * 1e-9).alias("k")).repartition(5)
    for n in (1, 2, 12_345, 59_999):
        got = [r["uuid"] for r in sampling.select_smallest(rows, "k", "uuid", n).collect()]
        assert sorted(got) == [f"{i:06d}" for i in range(n)]
    need = spark.createDataFrame([("0", 7), ("1", 20_000)], "g string, need long")
    got = [r["uuid"] for r in sampling.select_smallest(rows, "k", "uuid", need, by=["g"]).collect()]
    assert sorted(got) == sorted([f"{2 * i:06d}" for i in range(7)]
                                 + [f"{2 * i + 1:06d}" for i in range(20_000)])
    flat = rows.withColumn("k", F.lit(2.0))
    assert sampling.select_smallest(flat, "k", "uuid", 31_000).agg(
        F.max("uuid")).first()[0] == "030999"


def test_random_batches_are_a_seeded_permutation(spark):
    df = spark.range(103).withColumnRenamed("id", "doc_id")
    a = sampling.assign_batches(df, 10, order="random", key="doc_id", seed=5)
    b = sampling.assign_batches(df, 10, order="random", key="doc_id", seed=5)
    c = sampling.assign_batches(df, 10, order="random", key="doc_id", seed=6)
    ra = sorted((r["doc_id"], r["ordinal"]) for r in a.collect())
    assert ra == sorted((r["doc_id"], r["ordinal"]) for r in b.collect())
    assert ra != sorted((r["doc_id"], r["ordinal"]) for r in c.collect())
    assert sorted(o for _, o in ra) == list(range(103))
    sizes = sorted(r["count"] for r in a.groupBy("batch_id").count().collect())
    assert sizes == [3] + [10] * 10
