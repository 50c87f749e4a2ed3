from corpus_curator.operators import sampling
from corpus_curator.operators.retrieve import retrieve_by_uuid


def _corpus(spark):
    return spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), ("c", 4)], "uuid string, v long")


def _ids(spark):
    return spark.createDataFrame([("a",), ("b",), ("z",), ("a",)], "uuid string")


def _brute(spark):
    return sorted(tuple(r) for r in _ids(spark).join(_corpus(spark), "uuid", "left").collect())


def test_left_join_semantics(spark):
    got = sorted(tuple(r) for r in retrieve_by_uuid(_ids(spark), _corpus(spark)).select(
        "uuid", "v").collect())
    assert got == _brute(spark)


def test_semi(spark):
    got = sorted(tuple(r) for r in retrieve_by_uuid(_ids(spark), _corpus(spark), how="semi").collect())
    assert got == [("a", 1), ("b", 2), ("b", 3)]


def test_draw_rule_filters_full_records(spark):
    recs = spark.createDataFrame([(f"k{i}", float(i % 5 + 1), "x" * i) for i in range(300)],
                                 "uuid string, weight double, text string")
    ids = sorted(r["uuid"] for r in sampling.weighted_sample(recs.select("uuid", "weight"), 40,
                                                             seed=3).collect())
    rule = sampling.draw_rule(recs.select("uuid", "weight"), n=40, seed=3)
    full = rule(recs)
    assert sorted(r["uuid"] for r in full.collect()) == ids and "text" in full.columns


def test_bucketed_corpus_is_not_shuffled(spark):
    from corpus_curator.sources.writers import write_bucketed
    corpus = spark.range(2000).selectExpr("cast(id as string) as uuid", "id as v")
    write_bucketed(corpus, "cc_test_bucketed", buckets=8)
    table = spark.table("cc_test_bucketed")
    ids = spark.range(0, 2000, 7).selectExpr("cast(id as string) as uuid")
    out = retrieve_by_uuid(ids, table)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == len(range(0, 2000, 7))
    # only the id side is exchanged; the bucketed scan feeds the join directly
    assert plan.count("Exchange hashpartitioning") <= 1
    spark.sql("DROP TABLE cc_test_bucketed")


def test_registered_bucketed_join_exchanges_only_ids(spark):
    from corpus_curator.plans.registry import all_queries
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = all_queries()["q_retrieve_bucketed"](spark, "/root/testdata/sf0.001")
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    corpus = [p for p in plan.split("Join")[1:] if "bucketed" in p]
    assert plan.count("Exchange hashpartitioning") <= 1 and "Bucketed: true" in plan and corpus
