from pyspark.sql import Window
from pyspark.sql import functions as F

from corpus_curator.operators.rank import dense_index, global_rank, take_exact


def test_global_rank_equals_row_number(spark):
    df = spark.range(2000).select(F.col("id"), (F.col("id") * 7919 % 101).alias("v"),
                                  (F.col("id") % 3).alias("g")).repartition(9)
    got = global_rank(df, [F.col("v").desc(), "id"], name="r")
    want = df.withColumn("r", F.row_number().over(Window.orderBy(F.col("v").desc(), "id")))
    assert got.exceptAll(want.select(*got.columns)).count() == 0
    got_g = global_rank(df, ["v", "id"], by=["g"], name="r")
    want_g = df.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("v", "id")))
    assert got_g.exceptAll(want_g.select(*got_g.columns)).count() == 0


def test_dense_index_is_zero_based(spark):
    df = spark.createDataFrame([(5,), (3,), (5,), (9,)], "x long")
    got = {r["x"]: r["idx"] for r in dense_index(df, ["x"]).collect()}
    assert got == {3: 0, 5: 1, 9: 2}


def test_rank_in_groups_with_null_group(spark):
    df = spark.range(3000).select(
        F.col("id"), (F.col("id") * 31 % 97).alias("v"),
        F.when(F.col("id") % 4 > 0, F.col("id") % 4).alias("g")).repartition(5)
    got = global_rank(df, ["v", "id"], by=["g"], name="r")
    want = df.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("v", "id")))
    assert got.exceptAll(want.select(*got.columns)).count() == 0 and got.count() == 3000


def test_take_exact(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), F.lit("same").alias("x")).repartition(7)
    assert take_exact(df, 123).count() == 123 and take_exact(df, 900).count() == 500
    need = df.withColumn("n", F.when(F.col("g") == 0, 10).otherwise(40))
    got = {r["g"]: r["count"] for r in take_exact(need, "n", ["g"]).groupBy("g").count().collect()}
    assert got == {0: 10, 1: 40, 2: 40}


def test_equal_keys_spread_over_tasks(spark):
    from corpus_curator.operators import rank
    written = []
    old = rank.materialize
    rank.materialize = lambda df: written.append(old(df)) or written[-1]
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # it joins small partitions
    try:
        got = global_rank(spark.range(0, 40_000, 1, 6).select(F.lit(1).alias("v")), ["v"], name="r")
    finally:
        rank.materialize = old
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sorted(r["r"] for r in got.collect()) == list(range(1, 40_001))
    sizes = [r["count"] for r in written[0].groupBy("_pid").count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 3 * min(sizes)


def test_rank_by_row_key_sorts_narrow_rows(spark):
    import pytest
    df = spark.range(500).select("id", (F.col("id") * 7919 % 101).alias("v"),
                                 F.lit("text").alias("text"))
    for order in ([F.col("v").desc(), "id"], ["v", "id"], [F.pmod("v", F.lit(7)), "id"]):
        assert sorted(global_rank(df, order, row_key=["id"]).collect()) == sorted(
            global_rank(df, order).collect())
    with pytest.raises(ValueError, match="repeat"):
        global_rank(df, ["v"], row_key=["v"])
