"""End to end from files: enriched records written as JSON, read with the
declared schemas, sampled in record mode; the result equals the registered
query on the same data."""

import os
import tempfile

from pyspark.sql import functions as F

from corpus_curator.plans import flows
from corpus_curator.plans.registry import all_queries
from corpus_curator.sources import derived as D
from corpus_curator.sources import readers as RD
from corpus_curator.sources import writers as W

SF = "/root/testdata/sf0.001"


def test_rating_sample_from_files(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="cc-flow-"), "rated")
    W.write_records(D.with_text(spark, SF, D.rated(spark, SF)), path, partition_by="dataset")
    schema = RD.rated_schema(extra=("uuid", "text"))
    recs = RD.read_records(spark, path, schema)
    got = sorted(r["uuid"] for r in flows.rating_sample(recs, corpus=None, seed=7).collect())
    want = sorted(r["uuid"] for r in all_queries()["q_rating_sample_records"](spark, SF).collect())
    assert got == want and len(got) > 0


def test_tag_sample_from_files(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="cc-flow-"), "tagged")
    W.write_records(D.tagged(spark, SF), path)
    recs = RD.read_records(spark, path, RD.TAGGED_SCHEMA)
    out = flows.tag_sample(recs, corpus=None, boost_tags=D.boost_list(), seed=7)
    got = sorted(r["uuid"] for r in out.collect())
    want = sorted(r["uuid"] for r in all_queries()["q_tag_sample_records"](spark, SF).collect())
    assert got == want and len(got) > 0
    # quotas are met exactly per dataset
    per = {r["dataset"]: r["count"] for r in out.groupBy("dataset").count().collect()}
    tin = recs.filter(F.col("in_tree")).groupBy("dataset").count().collect()
    assert all(per.get(r["dataset"], 0) == r["count"] // 2 for r in tin)


def test_rate_flow_mle_uniform(spark):
    from corpus_curator.functions.annotators import rate_rule
    docs = D.documents(spark, SF)
    n = docs.count()
    scores = flows.rate(docs, "educational_value", rate_rule, n_pairs=3 * n, compare=6, seed=3,
                        method="mle", prior=0.5, score_type="uniform")
    rows = scores.collect()
    vals = sorted(r["score"] for r in rows)
    assert len(rows) == n and vals[0] == 1.0 and vals[-1] == 99.0
    assert len(set(vals)) == n  # evenly spaced, one value per item


def test_rating_sample_alias_and_size_checks(spark):
    import pytest
    rated = spark.createDataFrame(
        [(f"u{i}", str(i % 50), str((i * 7) % 60)) for i in range(40)],
        "uuid string, educational_value string, obscurity string")
    corpus = spark.createDataFrame([(f"u{i}", f"text {i}") for i in range(40)],
                                   "uuid string, text string")
    fields = ["educational_value", "scarcity"]
    weights = {"educational_value": 0.5, "scarcity": 0.5}
    out = flows.rating_sample(rated, corpus, n=10, fields=fields, weights=weights, seed=1)
    assert out.count() == 10 and "text" in out.columns
    with pytest.raises(ValueError):
        flows.rating_sample(rated, None, n=41, fields=fields, weights=weights)
    assert flows.rating_sample(rated, None, n=41, fields=fields, weights=weights,
                               cap=True).count() == 40


def test_tag_sample_given_quotas_are_checked(spark):
    import pytest
    recs = D.tagged(spark, SF)
    with pytest.raises(ValueError):
        flows.tag_sample(recs, None, quotas={"src0": 10 ** 6}, seed=1)
    out = flows.tag_sample(recs, None, quotas={"src0": 3}, seed=1)
    assert out.count() == 3
