"""Global ordinals and ranks without pulling rows into one task.

An unpartitioned window (``row_number() over (order by x)``) moves every row to
a single task. Here the rows are range-partitioned and sorted by Spark
(``orderBy``), each row is tagged with its partition id and position inside the
partition, and the layout is fixed by writing it to the shared folder. The
ordinal is then the partition's offset (a prefix sum over one small row per
partition) plus the position. Ranks within groups subtract the group's first
ordinal. It is the same at every size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the partition id above bit 33


def global_rank(df: DataFrame, order_by: Sequence[Column | str], by: Sequence[str] = (),
                name: str = "rank", start: int = 1, row_key: Sequence[str] = ()) -> DataFrame:
    """Add ``name``: position of each row in ``order_by`` order (within ``by``
    groups when given), counting from ``start``.

    ``order_by`` should make the order total (end it with a unique key), else
    tied rows get an arbitrary but fixed order; they are split over tasks all the
    same (a row number ends the sort key). All columns of ``df`` are sorted and
    written once. With ``row_key``, columns that no two rows agree in (else an error),
    only those and the order columns are, and the position is joined back to the
    records by them.
    """
    by = list(by)
    order = [F.col(c) if isinstance(c, str) else c for c in order_by]
    if row_key:
        row_key = list(row_key)
        kept = dict.fromkeys([*row_key, *by])
        names = [f"_o{i}" for i in range(len(order))]
        tidy = [_direction(c, n) for c, n in zip(order_by, names)]
        narrow = df.select(*kept, *[value.alias(n) for n, (value, _) in zip(names, tidy)])
        ranked = global_rank(narrow, [sort for _, sort in tidy], by, name, start)
        ranked = materialize(ranked.select(*row_key, name))
        if ranked.groupBy(*row_key).agg(F.count(F.lit(1)).alias("_c")).filter(
                "_c > 1").limit(1).count():
            raise ValueError(f"rows repeat the key {row_key}")
        same = [F.col(f"r.{c}").eqNullSafe(F.col(f"k.{c}")) for c in row_key]
        return df.alias("r").join(ranked.alias("k"), same).select("r.*", f"k.{name}")
    tagged = materialize(
        df.withColumn("_tie", F.monotonically_increasing_id())
        .orderBy(*[F.col(c) for c in by], *order, "_tie").drop("_tie")
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_local", F.monotonically_increasing_id()
                    - F.shiftleft(F.col("_pid").cast("long"), _LOCAL_BITS)))
    # one row per partition: a prefix sum over them is cheap
    offsets = (
        tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(
            Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select("_pid", "_offset")
    )
    ranked = tagged.join(offsets, "_pid").withColumn("_gord", F.col("_offset") + F.col("_local"))
    if by:
        firsts = ranked.groupBy(*by).agg(F.min("_gord").alias("_first"))
        same = [F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}")) for c in by]
        ranked = (ranked.alias("r").join(firsts.alias("f"), same)
                  .select("r.*", "f._first")
                  .withColumn("_gord", F.col("_gord") - F.col("_first")).drop("_first"))
    return ranked.withColumn(name, F.col("_gord") + F.lit(start)).drop(
        "_pid", "_local", "_offset", "_gord")


def _direction(order: Column | str, name: str) -> tuple[Column, Column]:
    """The value of an order column and the same order over a column ``name``: only plain
    columns by name and ``col(...).desc()`` are taken apart."""
    if isinstance(order, str):
        return F.col(order), F.col(name)
    text = order._jc.toString()
    if text.endswith((" ASC NULLS FIRST", " DESC NULLS LAST")):
        value = F.col(text.rsplit(" ", 3)[0])
        return value, F.col(name).asc() if " ASC " in text[-16:] else F.col(name).desc()
    return order, F.col(name)


def dense_index(df: DataFrame, cols: Sequence[str], name: str = "idx") -> DataFrame:
    """Distinct values of ``cols`` numbered 0..k-1 in sorted order (item -> index map)."""
    return global_rank(df.select(*cols).distinct(), list(cols), name=name, start=0)


def take_exact(df: DataFrame, need: int | str, by: Sequence[str] = ()) -> DataFrame:
    """Exactly ``need`` rows of ``df`` (of every ``by`` group; ``need`` may name a
    column that is the same in a group), any of them, without a sort and without
    gathering them: every partition of the written rows knows how many the ones
    before it hold."""
    by = list(by)
    want = F.lit(need) if isinstance(need, int) else F.col(need)
    tagged = materialize(df.withColumn("_pid", F.spark_partition_id()))
    before = F.coalesce(F.sum("_n").over(
        Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0))
    counts = (tagged.groupBy(*by, "_pid").agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_before", before).drop("_n"))
    own = F.row_number().over(Window.partitionBy(*by, "_pid").orderBy(F.lit(1)))
    return (tagged.withColumn("_own", own).join(counts, [*by, "_pid"])
            .filter(F.col("_before") + F.col("_own") <= want).drop("_pid", "_own", "_before"))
