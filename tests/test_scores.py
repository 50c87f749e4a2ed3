import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpus_curator.operators import scores

# (input, expected) from the edge table: Python float rule + range check,
# with NaN, inf, Java suffixes and underscores rejected
CASES = [(" 5 ", 5.0), ("1e1", 10.0), ("+5", 5.0), ("100", 100.0), ("-0.0", -0.0),
         ("nan", None), ("NaN", None), ("inf", None), ("Infinity", None), ("5d", None),
         ("5f", None), ("1_0", None), ("", None), ("abc", None), ("0x10", None), ("-3", None),
         ("104", None), (None, None), ("0", 0.0), (".5", 0.5), ("7.", 7.0)]


def test_valid_score_edge_table(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(CASES)], "i int, s string")
    got = {r["i"]: r["v"] for r in df.select("i", scores.valid_score(F.col("s")).alias("v")).collect()}
    for i, (s, want) in enumerate(CASES):
        assert got[i] == want, (s, got[i], want)


def test_clean_drops_rows_with_any_invalid_field(spark):
    df = spark.createDataFrame([("a", "1", "2"), ("b", "x", "2"), ("c", "3", None)],
                               "uuid string, f1 string, f2 string")
    out = scores.clean_scores(df, ["f1", "f2"]).collect()
    assert [r["uuid"] for r in out] == ["a"]


def test_obscurity_alias(spark):
    df = spark.createDataFrame([("a", "1")], "uuid string, obscurity string")
    out = scores.clean_scores(df, ["scarcity"])
    assert "scarcity" in out.columns and out.first()["scarcity"] == 1.0


def test_exp_zscores_match_numpy(spark):
    rng = np.random.default_rng(1)
    vals = rng.integers(0, 101, size=(50, 2)).astype(float)
    df = spark.createDataFrame([(str(i), str(a), str(b)) for i, (a, b) in enumerate(vals)],
                               "uuid string, f1 string, f2 string")
    z = scores.exp_zscores(scores.clean_scores(df, ["f1", "f2"]), ["f1", "f2"])
    got = {r["uuid"]: (r["f1"], r["f2"]) for r in z.collect()}
    want = np.exp((vals - vals.mean(0)) / vals.std(0, ddof=1))
    for i in range(50):
        assert got[str(i)] == pytest.approx(tuple(want[i]), rel=1e-12)


def test_zero_std_drops_rows(spark):
    df = spark.createDataFrame([("a", "5"), ("b", "5")], "uuid string, f1 string")
    assert scores.exp_zscores(scores.clean_scores(df, ["f1"]), ["f1"]).count() == 0


def test_rating_weight_sums_weights(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    w = scores.rating_weight(df, {"a": 0.25, "b": 0.75}).first()["weight"]
    assert math.isclose(w, 1.75)
