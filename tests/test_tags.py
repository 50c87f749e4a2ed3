import pytest
from pyspark.sql import functions as F

from corpus_curator.operators import tags


def _tagged(spark):
    rows = []
    paths = [("a", "a1", "a11")] * 5 + [("a", "a1", "a12")] * 3 + [("a", "a2", "a21")] * 2 \
        + [("b", "b1", "b11")] * 4 + [(None, "x", "y")]
    for i, (f, s, t) in enumerate(paths):
        rows.append((f"u{i}", f, s, t, True))
    return spark.createDataFrame(rows, "uuid string, first_level_tag string, second_level_tag string, "
                                       "third_level_tag string, in_tree boolean")


def test_probability_sum_invariant(spark):
    p = tags.tag_probability(_tagged(spark))
    total = p.agg(F.sum("probability")).first()[0]
    assert total == pytest.approx(10 ** 0.5 + 4 ** 0.5)
    assert p.count() == 14  # the null first tag drops
    pn = tags.tag_probability(_tagged(spark), normalize=True)
    assert pn.agg(F.sum("probability")).first()[0] == pytest.approx(1.0)


def test_boost_first_match_wins(spark):
    df = spark.createDataFrame([("a", "b", "c", 1.0), ("x", "b", "c", 1.0), ("x", "y", "c", 1.0),
                                ("x", "y", "z", 1.0)],
                               "first_level_tag string, second_level_tag string, third_level_tag string, "
                               "probability double")
    got = [r["probability"] for r in tags.boost_weight(df, ["a", "b", "c"]).collect()]
    assert got == [2.0, 3.0, 4.0, 1.0]
    lst = df.sparkSession.createDataFrame([("a",), ("b",), ("c",)], "t string")
    got2 = sorted(r["probability"] for r in tags.boost_weight(df, lst).collect())
    assert got2 == [1.0, 2.0, 3.0, 4.0]


def test_mark_in_tree(spark):
    tax = spark.createDataFrame([("a", "a1", "a11")], "first string, second string, third string")
    m = tags.mark_in_tree(_tagged(spark), tax)
    assert m.filter("in_tree").count() == 5
