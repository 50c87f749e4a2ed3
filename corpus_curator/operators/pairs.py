"""Comparison pairs: random pairs, top-up to a minimum number of comparisons
per item, degrees, pair texts, resume.

Items are numbered 0..n-1 by a distributed dense index; a pair draws its first
ordinal and its partner's offset from md5 variates of (pair id, seed), so the
set of pairs is the same on any cluster. The top-up computes every item's
deficit at once from the degree table and makes one stub per missing
comparison; the stubs are shuffled and neighbours are paired, so that an extra
pair serves two items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rand import uniform
from ..session import materialize
from .rank import dense_index, global_rank

PAIR_SCHEMA = "pair_id long, id_1 long, id_2 long"


def _partner(ordinal, u, n: int):
    """A uniformly chosen other ordinal: (i + 1 + floor(u * (n - 1))) mod n."""
    return F.pmod(ordinal + F.lit(1) + F.floor(u * F.lit(n - 1)).cast("long"), F.lit(n))


def _to_ids(pairs: DataFrame, idx: DataFrame, id_col: str) -> DataFrame:
    a = idx.select(F.col("idx").alias("_i1"), F.col(id_col).alias("id_1"))
    b = idx.select(F.col("idx").alias("_i2"), F.col(id_col).alias("id_2"))
    return pairs.join(a, "_i1").join(b, "_i2").drop("_i1", "_i2")


def indexed_items(ids: DataFrame, id_col: str = "id") -> tuple[DataFrame, int]:
    idx = dense_index(ids.select(id_col).filter(F.col(id_col).isNotNull()), [id_col])
    return idx, idx.count()


def random_pairs(ids: DataFrame, n_pairs: int, seed: int | str = 0, id_col: str = "id",
                 indexed: tuple[DataFrame, int] | None = None) -> DataFrame:
    """``n_pairs`` pairs of two different ids; repeats allowed; random order."""
    idx, n = indexed or indexed_items(ids, id_col)
    if n < 2:
        raise ValueError("need at least two ids to pair")
    spark = ids.sparkSession
    p = spark.range(n_pairs).withColumnRenamed("id", "pair_id")
    i = F.floor(uniform("pair_id", f"{seed}:i") * F.lit(n)).cast("long")
    p = p.withColumn("_a", i).withColumn("_b", _partner(F.col("_a"), uniform("pair_id", f"{seed}:j"), n))
    flip = uniform("pair_id", f"{seed}:o") < 0.5
    p = p.select("pair_id", F.when(flip, F.col("_b")).otherwise(F.col("_a")).alias("_i1"),
                 F.when(flip, F.col("_a")).otherwise(F.col("_b")).alias("_i2"))
    return _to_ids(p, idx, id_col).select("pair_id", "id_1", "id_2")


def pair_degrees(pairs: DataFrame) -> DataFrame:
    """Comparisons per id: ``(id, degree)``."""
    return (pairs.select(F.explode(F.array("id_1", "id_2")).alias("id"))
            .groupBy("id").agg(F.count(F.lit(1)).alias("degree")))


def check_pair_budget(n: int, n_pairs: int, compare: int) -> None:
    if 2 * n_pairs < n * compare:
        raise ValueError("insufficient pairs for the minimum comparisons per id; "
                         "increase n_pairs")


def pair_budget(ids: DataFrame, n_pairs: int, compare: int) -> DataFrame:
    """One row: ``n_ids``, the pairs needed for ``compare`` comparisons per id,
    and whether ``n_pairs`` are ``enough``."""
    return ids.agg(F.count(F.lit(1)).alias("n_ids")).select(
        "n_ids", F.ceil(F.col("n_ids") * compare / 2).cast("long").alias("needed"),
        (F.lit(2 * n_pairs) >= F.col("n_ids") * compare).alias("enough"))


def balanced_pairs(ids: DataFrame, n_pairs: int, compare: int, seed: int | str = 0,
                   id_col: str = "id") -> DataFrame:
    """Random pairs topped up so that every id has at least ``compare``
    comparisons. Adds ``added`` (false for the first ``n_pairs``).

    The missing comparisons of all ids, in random order, are paired two by two. Where
    both are of one id, or the last one is left over, each gets a random other id
    instead: at most half of what is missing plus one pair for each such redraw."""
    idx, n = indexed_items(ids, id_col)
    check_pair_budget(n, n_pairs, compare)
    idx = materialize(idx)  # read six times below
    base = random_pairs(ids, n_pairs, seed, id_col, indexed=(idx, n))
    deg = pair_degrees(base)
    stubs = (idx.join(deg.withColumnRenamed("id", id_col), id_col, "left")
             .withColumn("_deficit", F.greatest(F.lit(compare) - F.coalesce(F.col("degree"), F.lit(0)),
                                                 F.lit(0)))
             .filter(F.col("_deficit") > 0)
             .select(F.col(id_col).alias("_self"), F.col("idx").alias("_si"),
                     F.explode(F.sequence(F.lit(1), F.col("_deficit").cast("int"))).alias("_k")))
    stub = F.concat(F.col("_self").cast("string"), F.lit(":"), F.col("_k").cast("string"))
    stubs = global_rank(stubs.withColumn("_u", uniform(stub, f"{seed}:s")), ["_u", "_self", "_k"],
                        name="_r", start=0)
    slots = stubs.groupBy(F.floor(F.col("_r") / 2).alias("_slot")).agg(
        F.min_by("_si", "_r").alias("_a"), F.max_by("_si", "_r").alias("_b"),
        F.count(F.lit(1)).alias("_n"))

    def redrawn(end: str, place: int):
        draw = F.concat(F.col("_slot").cast("string"), F.lit(f":{place}"))
        other = _partner(F.col(end), uniform(draw, f"{seed}:p"), n)
        flip = uniform(draw, f"{seed}:o") < 0.5
        return F.struct(F.lit(place).alias("_j"),
                        F.when(flip, other).otherwise(F.col(end)).alias("_i1"),
                        F.when(flip, F.col(end)).otherwise(other).alias("_i2"))

    matched = F.struct(F.lit(0).alias("_j"), F.col("_a").alias("_i1"), F.col("_b").alias("_i2"))
    made = (F.when(F.col("_n") == 1, F.array(redrawn("_a", 0)))
            .when(F.col("_a") == F.col("_b"), F.array(redrawn("_a", 0), redrawn("_b", 1)))
            .otherwise(F.array(matched)))
    extra = global_rank(slots.select("_slot", F.inline(made)), ["_slot", "_j"], name="_r", start=0)
    extra = extra.select((F.col("_r") + F.lit(n_pairs)).alias("pair_id"), "_i1", "_i2")
    extra = _to_ids(extra, idx, id_col).select("pair_id", "id_1", "id_2")
    return (base.withColumn("added", F.lit(False))
            .unionByName(extra.withColumn("added", F.lit(True))))


def pair_report(pairs: DataFrame) -> DataFrame:
    """One row: ``n_pairs`` and ``n_added``."""
    return pairs.agg(F.count(F.lit(1)).alias("n_pairs"),
                     F.count_if(F.col("added")).alias("n_added"))


def pair_texts(pairs: DataFrame, docs: DataFrame, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """Both texts of every pair (inner joins: pairs with an unknown id drop;
    ``check_pairs`` counts them)."""
    d1 = docs.select(F.col(id_col).alias("id_1"), F.col(text_col).alias("text_1"))
    d2 = docs.select(F.col(id_col).alias("id_2"), F.col(text_col).alias("text_2"))
    return pairs.join(d1, "id_1").join(d2, "id_2")


def check_pairs(pairs: DataFrame, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row: pairs, distinct pair ids, pair ids without a document."""
    used = pairs.select(F.explode(F.array("id_1", "id_2")).alias("id")).distinct()
    known = docs.select(F.col(id_col).alias("id")).distinct().withColumn("_known", F.lit(True))
    per_id = used.join(known, "id", "left").select(
        F.lit(0).alias("_pair"), F.lit(1).alias("_id"),
        F.col("_known").isNull().cast("int").alias("_missing"))
    per_pair = pairs.select(F.lit(1).alias("_pair"), F.lit(0).alias("_id"),
                            F.lit(0).alias("_missing"))
    # one aggregate over both row kinds: no join of the two totals
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return per_pair.unionByName(per_id).agg(
        total("_pair").alias("n_pairs"), total("_id").alias("n_ids"),
        total("_missing").alias("missing_ids"))


def require_pair_set(n: int, docs: DataFrame) -> None:
    """A pair set is built for ``n`` documents; rating it against a different
    document set would pair the wrong texts, so it is refused."""
    have = docs.count()
    if have != n:
        raise ValueError(f"the pair set was built for {n} documents, {have} were given")


def remaining(pairs: DataFrame, done: DataFrame, mode: str = "anti") -> DataFrame:
    """Pairs still to annotate. ``anti``: not in ``done``. ``watermark``: pair id
    above the largest finished one (-1 when nothing is done)."""
    if mode == "anti":
        return pairs.join(done.select("pair_id").distinct(), "pair_id", "left_anti")
    if mode == "watermark":
        mx = done.agg(F.coalesce(F.max("pair_id"), F.lit(-1)).alias("m")).first()["m"]
        return pairs.filter(F.col("pair_id") > F.lit(mx))
    raise ValueError("mode must be 'anti' or 'watermark'")
