"""Tag frequencies -> sampling weights, and taxonomy checks.

The per-document probability is

    count_a^alpha * (count_b^beta / sum_b) * (count_c^gamma / sum_c) / count_c

with count_a/b/c the documents of the document's first tag, (first, second)
and (first, second, third) path, sum_b the sum of count_b^beta over the
second tags under the same first tag, sum_c the sum of count_c^gamma over the
third tags under the same (first, second).

Everything is derived from one aggregate at level 3 (one row per tag path):
levels 1 and 2 and both sibling sums roll up from that small table, and one
join on the three keys attaches it to the documents. A null tag never matches
an inner join key, so such documents drop, as in a chain of inner joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import BOOST_FACTORS, TAG_EXPONENTS
from ..session import materialize

TAGS = ("first_level_tag", "second_level_tag", "third_level_tag")
T1, T2, T3 = TAGS


def filter_in_tree(df: DataFrame) -> DataFrame:
    """Keep ``in_tree == true``; null is dropped."""
    return df.filter(F.col("in_tree"))


def mark_in_tree(df: DataFrame, taxonomy: DataFrame, name: str = "in_tree") -> DataFrame:
    """``in_tree`` = the (first, second, third) path is an edge of the taxonomy.
    All three levels are compared in lower case, as accepted tags are stored."""
    edges = (taxonomy.select(F.lower("first").alias("_f"), F.lower("second").alias("_s"),
                             F.lower("third").alias("_t")).distinct()
             .withColumn("_hit", F.lit(True)))
    j = df.join(edges, (F.lower(T1) == F.col("_f")) & (F.lower(T2) == F.col("_s"))
                & (F.lower(T3) == F.col("_t")), "left")
    return j.withColumn(name, F.coalesce(F.col("_hit"), F.lit(False))).drop(
        "_f", "_s", "_t", "_hit")


def tag_counts(df: DataFrame, level: int = 3) -> DataFrame:
    """Documents per tag path of the given level (1, 2 or 3): ``count``."""
    keys = list(TAGS[:level])
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def tag_level_table(df: DataFrame, alpha: float = TAG_EXPONENTS[0],
                    beta: float = TAG_EXPONENTS[1], gamma: float = TAG_EXPONENTS[2]) -> DataFrame:
    """One row per complete (non-null) tag path with count_a, count_b, count_c,
    sum_weight_b, sum_weight_c and sum_weight_a (global).

    Aggregations only: level 3 from the documents (map-side combined, written
    once), level 2 from level 3, level 1 from level 2, the global sum as one
    scalar; the smaller levels are joined back to level 3, where Spark
    broadcasts them by size or splits a first tag with many sub-paths."""
    c3 = materialize(
        df.filter(F.col(T1).isNotNull() & F.col(T2).isNotNull() & F.col(T3).isNotNull())
        .groupBy(*TAGS).agg(F.count(F.lit(1)).alias("count_c")))
    c2 = c3.groupBy(T1, T2).agg(F.sum("count_c").alias("count_b"),
                                F.sum(F.pow("count_c", F.lit(gamma))).alias("sum_weight_c"))
    c1 = c2.groupBy(T1).agg(F.sum("count_b").alias("count_a"),
                            F.sum(F.pow("count_b", F.lit(beta))).alias("sum_weight_b"))
    total = c1.agg(F.sum(F.pow("count_a", F.lit(alpha))).alias("s")).first()["s"]
    return (c3.join(c2, [T1, T2]).join(c1, [T1])
            .withColumn("sum_weight_a", F.lit(total).cast("double"))
            .select(*TAGS, "count_c", "count_b", "count_a", "sum_weight_c", "sum_weight_b",
                    "sum_weight_a"))


def tag_probability(df: DataFrame, alpha: float = TAG_EXPONENTS[0],
                    beta: float = TAG_EXPONENTS[1], gamma: float = TAG_EXPONENTS[2],
                    normalize: bool = False, name: str = "probability") -> DataFrame:
    """Attach the per-document probability. ``normalize`` divides by the global
    sum of count_a^alpha so the probabilities add up to 1. The level table is
    written before the join, so Spark knows its size: it is broadcast when it
    is small, and beyond that a popular path's documents are split."""
    lv = materialize(tag_level_table(df, alpha, beta, gamma))
    p = (F.pow("count_a", F.lit(alpha))
         * (F.pow("count_b", F.lit(beta)) / F.col("sum_weight_b"))
         * (F.pow("count_c", F.lit(gamma)) / F.col("sum_weight_c"))
         / F.col("count_c"))
    if normalize:
        p = p / F.col("sum_weight_a")
    out = df.join(lv, list(TAGS)).withColumn(name, p)
    return out.drop("count_a", "count_b", "count_c", "sum_weight_a", "sum_weight_b",
                    "sum_weight_c")


def boost_weight(df: DataFrame, boost_tags: Sequence[str] | DataFrame, weight: str = "probability",
                 factors: Sequence[float] = BOOST_FACTORS, name: str | None = None) -> DataFrame:
    """Multiply by factors[0] if the first tag is listed, else factors[1] if the
    second is, else factors[2] if the third is, else keep."""
    name = name or weight
    if isinstance(boost_tags, DataFrame):
        lst = (boost_tags.select(F.col(boost_tags.columns[0]).alias("_tag")).distinct()
               .withColumn("_one", F.lit(True)))
        out = df
        for i, t in enumerate(TAGS):
            out = out.join(lst.withColumnRenamed("_one", f"_hit{i}"),
                           F.col(t) == F.col("_tag"), "left").drop("_tag")
        hits = [F.coalesce(F.col(f"_hit{i}"), F.lit(False)) for i in range(3)]
    else:
        tags = list(boost_tags)
        out = df
        hits = [F.col(t).isin(tags) for t in TAGS]
    f = (F.when(hits[0], F.lit(factors[0])).when(hits[1], F.lit(factors[1]))
         .when(hits[2], F.lit(factors[2])).otherwise(F.lit(1.0)))
    out = out.withColumn(name, F.col(weight) * f)
    return out.drop(*[c for c in out.columns if c.startswith("_hit")])
