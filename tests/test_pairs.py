import pytest
from pyspark.sql import functions as F

from corpus_curator.operators import pairs as P


def test_balanced_pairs_invariants(spark):
    ids = spark.range(200).select(F.col("id"))
    pairs = P.balanced_pairs(ids, 600, 6, seed=20241109)
    rows = pairs.collect()
    assert all(r["id_1"] != r["id_2"] for r in rows)
    assert sorted(r["pair_id"] for r in rows) == list(range(len(rows)))
    deg = {r["id"]: r["degree"] for r in P.pair_degrees(pairs).collect()}
    assert len(deg) == 200 and min(deg.values()) >= 6
    rep = P.pair_report(pairs).first()
    assert rep["n_pairs"] == len(rows) and rep["n_added"] == len(rows) - 600


@pytest.mark.parametrize("n, n_pairs, compare", [(200, 600, 6), (2, 6, 6), (3, 5, 3), (51, 160, 6)])
def test_top_up_serves_two_ids_with_a_pair(spark, n, n_pairs, compare):
    ids = spark.range(n)
    pairs = P.balanced_pairs(ids, n_pairs, compare, seed=3)
    deg = {r["id"]: r["degree"] for r in P.pair_degrees(pairs.filter("not added")).collect()}
    missing = sum(max(0, compare - deg.get(i, 0)) for i in range(n))
    added = [(r["id_1"], r["id_2"]) for r in pairs.filter("added").collect()]
    after = {r["id"]: r["degree"] for r in P.pair_degrees(pairs).collect()}
    assert all(after[i] >= compare for i in range(n)) and all(a != b for a, b in added)
    over = sum(after.values()) - sum(deg.values()) - missing  # ends that no id was missing
    assert len(added) >= -(-missing // 2) and 2 * len(added) == missing + over
    if n >= 50:
        assert over <= max(2, missing // 10)


def test_budget_precondition(spark):
    with pytest.raises(ValueError):
        P.balanced_pairs(spark.range(100), 10, 6)


def test_remaining_modes(spark):
    pairs = spark.createDataFrame([(i, 0, 1) for i in range(6)], P.PAIR_SCHEMA)
    done = spark.createDataFrame([(1,), (3,)], "pair_id long")
    assert sorted(r[0] for r in P.remaining(pairs, done).select("pair_id").collect()) == [0, 2, 4, 5]
    assert sorted(r[0] for r in P.remaining(pairs, done, "watermark").select("pair_id").collect()) == [4, 5]
    empty = done.limit(0)
    assert P.remaining(pairs, empty, "watermark").count() == 6


def test_check_pairs_reports_unknown_ids(spark):
    pairs = spark.createDataFrame([(0, 1, 2), (1, 2, 99)], P.PAIR_SCHEMA)
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    r = P.check_pairs(pairs, docs).first()
    assert (r["n_pairs"], r["n_ids"], r["missing_ids"]) == (2, 3, 1)
    assert P.pair_texts(pairs, docs).count() == 1


def test_pair_set_document_count_precondition(spark):
    from corpus_curator.functions.annotators import rate_rule
    from corpus_curator.operators.annotate import rate_pairs
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(5)], "doc_id long, text string")
    pairs = spark.createDataFrame([(0, 0, 1), (1, 2, 3)], P.PAIR_SCHEMA)
    with pytest.raises(ValueError):
        rate_pairs(docs, pairs, "educational_value", rate_rule, expected_n=6)
    assert rate_pairs(docs, pairs, "educational_value", rate_rule, expected_n=5).count() == 2
