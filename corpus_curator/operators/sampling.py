"""Reproducible sampling: weighted without replacement, quotas per group,
uniform k, shuffles, ordered heads, slices and batches.

The weighted draw uses the Efraimidis-Spirakis rule: with ``u`` uniform from
(key, seed), the n rows with the smallest ``-ln(u)/w`` are a draw of n rows
without replacement in which every successive draw is proportional to weight.

Picking the n smallest keys without a global sort and without gathering n rows in
one task takes two passes over (key, weight). The first counts rows per logarithmic
bucket of the key (``floor(ln(key) * resolution)``, a few thousand per group, combined
map-side) and checks the weights; a running sum finds the bucket of the n-th key.
The second counts the key values inside that bucket (about 0.04 % of a group); while a
bucket holds more than a few thousand rows it is divided further first. That yields
one threshold per group, and the sample is a single filter over the input. Only where
the threshold cuts through rows of one key are those ranked by their tie columns, by
the distributed ``global_rank``; copies are cut to the exact number.

Weights may be given as logarithms (``log_weight``): the key is then
``ln(-ln u) - ln w``, the logarithm of the same key, and nothing overflows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rand import log_sampling_key, sampling_key, uniform
from ..session import materialize
from .rank import global_rank, take_exact

_RESOLUTION = 1024  # log buckets per unit of ln(key); relative width ~0.1 %
_LOW_BUCKET = -(1 << 40)
_DIVIDE = 1 << 16   # parts of a bucket that is divided
_LEVELS = 2         # after two divisions a bucket holds about a thousand doubles
_FEW = 10_000


def _names(cols: str | Sequence[str]) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def _bucket(key: Column, resolution: float, log: bool = False) -> Column:
    """Bucket of a key; ``log``: the key is a logarithm already."""
    value = key if log else F.log(key)
    return F.coalesce(F.floor(value * F.lit(float(resolution))).cast("long"),
                      F.lit(_LOW_BUCKET))


def _row(cols: Sequence[Column]) -> Column:
    """One struct to compare by: the (md5-based) key is referenced once."""
    return F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cols)])


def select_smallest(df: DataFrame, key: str, tie: str | Sequence[str], need: DataFrame | int,
                    by: Sequence[str] = (), resolution: int = _RESOLUTION) -> DataFrame:
    """Rows with the ``need`` smallest ``(key, *tie)`` per ``by`` group.

    ``key`` must be a positive double (null keys are never selected); ``need``
    is an int (no groups) or a DataFrame ``(*by, need)``; groups missing from it
    select nothing. Exact: as many rows as ``row_number() over (partition by by
    order by key, tie) <= need``; of rows that agree in key and tie any of the
    right number are taken.
    """
    keyed = df.filter(F.col(key).isNotNull())
    thr = smallest_threshold(keyed, key, tie, need, by, resolution)
    return apply_threshold(keyed, key, tie, thr, by)


def smallest_threshold(keyed: DataFrame, key: str, tie: str | Sequence[str],
                       need: DataFrame | int, by: Sequence[str] = (),
                       resolution: int = _RESOLUTION, log: bool = False, counts=None):
    """The selection threshold: ``None`` (nothing), ``"all"``, a triple of the key
    value, the tie values of the last row taken (None: all rows of that key stay) and
    the number of rows equal to it that stay (None: all), or with groups a small
    DataFrame ``(*by, _t0, _tied, _t1.., _cut)`` (null threshold: the whole group).
    ``log``: keys are logarithms. ``counts``: the histogram, where it is known."""
    keyed = keyed.filter(F.col(key).isNotNull())
    if not by:
        return _global_threshold(keyed, key, _names(tie), int(need), resolution, log, counts)
    return _group_thresholds(keyed, key, _names(tie), need, list(by), resolution, log, counts)


def apply_threshold(df: DataFrame, key: str, tie: str | Sequence[str], thr,
                    by: Sequence[str] = (), key_not_null: bool = False) -> DataFrame:
    """Rows of ``df`` at or below the threshold of their group.
    ``key_not_null``: the caller has already removed null keys."""
    if not key_not_null:
        df = df.filter(F.col(key).isNotNull())
    ties = _names(tie)
    mine = _row([F.col(c) for c in ties])
    if not by:
        if thr is None:
            return df.limit(0)
        if thr == "all":
            return df
        value, values, cut = thr
        if values is None:
            return df.filter(F.col(key) <= F.lit(value))
        edge = _row([F.lit(v).cast(df.schema[c].dataType) for v, c in zip(values, ties)])
        same = F.col(key) == F.lit(value)
        before = (F.col(key) < F.lit(value)) | (same & (mine < edge))
        if cut is None:
            return df.filter(before | (same & (mine == edge)))
        return df.filter(before).unionByName(take_exact(df.filter(same & (mine == edge)), cut))
    by = list(by)
    edge = _row([F.col(f"_t{i + 1}") for i in range(len(ties))])
    drop = ["_t0", "_tied", "_cut", *[f"_t{i + 1}" for i in range(len(ties))]]
    sel = df.join(thr, by)
    same = F.col(key) == F.col("_t0")
    whole = sel.filter(F.col("_t0").isNull() | (F.col(key) < F.col("_t0")) | (same & (
        ~F.col("_tied") | (mine < edge) | ((mine == edge) & F.col("_cut").isNull()))))
    if not thr.filter(F.col("_cut").isNotNull()).limit(1).count():
        return whole.drop(*drop)
    equal = sel.filter(F.col("_cut").isNotNull() & same & (mine == edge))
    return whole.drop(*drop).unionByName(take_exact(equal, "_cut", by).drop(*drop))


def _counted(df: DataFrame, key: str, resolution: float, log: bool, by: Sequence[str] = (),
             weight: Column | None = None) -> DataFrame:
    """``(*by, _b, _c, _bad)``: rows with a key per bucket (null bucket: without one),
    and how many weights cannot be drawn by."""
    bucket = F.when(F.col(key).isNotNull(), _bucket(F.col(key), resolution, log))
    bad = F.count_if(weight) if weight is not None else F.lit(0).cast("long")
    return df.groupBy(*by, bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_c"),
                                                   bad.alias("_bad"))


def _hit(rows: list, need: int) -> tuple | None:
    """(value, rows before it, rows of it) of the ``need``-th row in sorted counts."""
    before = 0
    for value, n in rows:
        if before + n >= need:
            return value, before, n
        before += n
    return None


def _global_threshold(keyed: DataFrame, key: str, tie: list[str], need: int, resolution: float,
                      log: bool, counts: list | None):
    if need <= 0:
        return None
    if counts is None:  # one row per occupied bucket: bounded by the range of doubles
        counts = [(r["_b"], r["_c"]) for r in _counted(keyed, key, resolution, log).collect()]
    hit = _hit(sorted(counts), need)
    if not hit:  # fewer rows than asked for: all of them
        return "all"
    for _ in range(_LEVELS):
        if hit[2] <= _FEW:
            break
        need -= hit[1]
        keyed = keyed.filter(_bucket(F.col(key), resolution, log) == F.lit(hit[0]))
        resolution *= _DIVIDE
        hit = _hit(sorted((r["_b"], r["_c"]) for r in
                          _counted(keyed, key, resolution, log).collect()), need)
    need -= hit[1]
    keyed = keyed.filter(_bucket(F.col(key), resolution, log) == F.lit(hit[0]))
    values = keyed.groupBy(key).agg(F.count(F.lit(1)).alias("_c")).collect()
    value, before, n = _hit(sorted((r[key], r["_c"]) for r in values), need)
    rest = need - before
    if rest == n:  # the threshold does not cut through rows of one key
        return value, None, None
    ranked = global_rank(keyed.filter(F.col(key) == F.lit(value)).select(*tie), tie, name="_rn")
    last = list(ranked.filter(F.col("_rn") == rest).select(
        *[F.col(c).alias(f"_t{i}") for i, c in enumerate(tie)]).first())
    same = _row([F.col(c) for c in tie]) == _row(
        [F.lit(v).cast(keyed.schema[c].dataType) for v, c in zip(last, tie)])
    equal = ranked.filter(same).agg(F.min("_rn").alias("first"), F.count("*").alias("n")).first()
    stay = rest - equal["first"] + 1
    return value, last, (stay if stay < equal["n"] else None)


def _boundary(counts: DataFrame, need: DataFrame, by: list[str], value: str) -> DataFrame:
    """Per group the value whose running count reaches ``_need``, how many rows of it
    are needed (``_rest``) and how many it has (``_n``); absent: never reached."""
    run = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    rest = F.col("_need") - F.col("_cum") + F.col("_c")
    return (counts.withColumn("_cum", F.sum("_c").over(run)).join(need, by)
            .filter(F.col("_cum") >= F.col("_need")).groupBy(*by)
            .agg(F.min(F.struct(value, rest.alias("_r"), F.col("_c"))).alias("_m"))
            .select(*by, F.col(f"_m.{value}").alias("_at"), F.col("_m._r").alias("_rest"),
                    F.col("_m._c").alias("_n")))


def _group_thresholds(keyed: DataFrame, key: str, tie: list[str], need: DataFrame,
                      by: list[str], resolution: float, log: bool,
                      counts: DataFrame | None) -> DataFrame:
    quotas = materialize(need.select(*by, F.col("need").cast("long").alias("_need"))
                         .filter(F.col("_need") > 0))
    if counts is None:
        counts = _counted(keyed, key, resolution, log, by)
    at = materialize(_boundary(counts.filter("_b IS NOT NULL"), quotas, by, "_b"))
    for level in range(_LEVELS + 1):
        # rows of each group's boundary bucket; the table of boundaries is small
        inside = (keyed.join(at.select(*by, "_at", F.col("_rest").alias("_need")), by)
                  .filter(_bucket(F.col(key), resolution, log) == F.col("_at")))
        todo = at.select(*by, F.col("_rest").alias("_need"))
        if level == _LEVELS or not at.filter(F.col("_n") > _FEW).limit(1).count():
            break
        finer = resolution * _DIVIDE
        at = materialize(_boundary(_counted(inside, key, finer, log, by), todo, by, "_b"))
        resolution = finer
    values = inside.groupBy(*by, F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_c"))
    edge = materialize(_boundary(values, todo, by, "_k"))
    tied = edge.filter(F.col("_rest") < F.col("_n"))
    names = [f"_t{i + 1}" for i in range(len(tie))]
    if tied.limit(1).count():
        rows = (keyed.join(tied.select(*by, "_at", "_rest"), by)
                .filter(F.col(key) == F.col("_at")).select(*dict.fromkeys([*by, *tie, "_rest"])))
        ranked = global_rank(rows, list(dict.fromkeys(tie)), by=by, name="_rn")
        # rows that agree with the last row taken share its group of this aggregate
        last = (ranked.groupBy(*by, *[F.col(c).alias(t) for c, t in zip(tie, names)], "_rest")
                .agg(F.min("_rn").alias("_first"), F.count(F.lit(1)).alias("_m"))
                .filter((F.col("_first") <= F.col("_rest"))
                        & (F.col("_rest") < F.col("_first") + F.col("_m")))
                .withColumn("_stay", F.col("_rest") - F.col("_first") + 1)
                .withColumn("_cut", F.when(F.col("_stay") < F.col("_m"), F.col("_stay")))
                .select(*by, *names, "_cut", F.lit(True).alias("_tied")))
        edge = edge.join(last, by, "left")
    else:
        kinds = [keyed.schema[c].dataType for c in tie]
        edge = edge.select("*", *[F.lit(None).cast(k).alias(t) for t, k in zip(names, kinds)],
                           F.lit(None).cast("long").alias("_cut"),
                           F.lit(False).alias("_tied"))
    found = edge.select(*by, F.col("_at").alias("_t0"),
                        F.coalesce("_tied", F.lit(False)).alias("_tied"), *names, "_cut")
    # groups whose rows do not reach the quota keep everything (null threshold)
    return materialize(quotas.select(*by).join(found, by, "left"))


def draw_rule(df: DataFrame, weight: str = "weight", key: str | Sequence[str] = "uuid",
              seed: int | str = 0,
              n: int | None = None, fraction: float | None = None,
              quotas: DataFrame | Mapping[str, int] | None = None, by: str | None = None,
              cap: bool = False, validate: bool = True, tie: str | Sequence[str] | None = None,
              log_weight: str | None = None):
    """Decide a weighted sample on ``df`` (only ``key``, the weight and ``by``
    are read) and return a function that keeps the sampled rows of any
    DataFrame carrying the same ``key`` and weight columns, e.g. the full
    records, so the sample needs no join back. Rows with one ``key`` share its
    variate; ``tie`` (default: the key) orders rows of equal weight and key.
    ``log_weight`` names a column of log weights to use instead of ``weight``: null or
    minus infinity is weight 0."""
    tie = _names(key if tie is None else tie)
    log, source = log_weight is not None, log_weight or weight
    w = F.col(source).cast("double")

    def with_key(rows: DataFrame) -> DataFrame:
        value = log_sampling_key(source, key, seed) if log else sampling_key(source, key, seed)
        return rows.withColumn("_sk", value)

    if log:
        bad = F.isnan(w) | (w == F.lit(float("inf")))
    else:
        bad = (w < 0) | F.isnan(w) | (F.abs(w) == F.lit(float("inf")))
    grouped = [by] if quotas is not None else []
    narrow = with_key(df.select(*dict.fromkeys([*_names(key), *tie, source, *grouped])))
    counts = _counted(narrow, "_sk", _RESOLUTION, log, grouped, bad)
    if grouped:
        if isinstance(quotas, Mapping):
            quotas = df.sparkSession.createDataFrame(
                [(k, int(v)) for k, v in quotas.items()], f"`{by}` string, n long")
        need = quotas.select(by, F.col("n").alias("need"))
        counts = materialize(counts)
        if validate:
            _refuse(counts.agg(F.sum("_bad")).first()[0])
            if not cap:
                have = counts.filter("_b IS NOT NULL").groupBy(by).agg(F.sum("_c").alias("p"))
                short = (have.join(need, by, "right")
                         .filter(F.coalesce(F.col("p"), F.lit(0)) < F.col("need")).limit(1)
                         .collect())
                if short:
                    raise ValueError("quota larger than the rows with positive weight: "
                                     f"{short[0]}")
        thr = smallest_threshold(narrow, "_sk", tie, need, [by], log=log, counts=counts)
    else:
        rows = counts.collect()  # one row per occupied bucket
        positive = sum(r["_c"] for r in rows if r["_b"] is not None)
        if validate or fraction is not None:
            _refuse(sum(r["_bad"] for r in rows))
        if fraction is not None:
            n = int(positive * fraction)
        elif cap:
            n = min(n, positive)
        elif validate and n > positive:
            raise ValueError(f"cannot draw {n} rows: only {positive} have a positive weight")
        thr = smallest_threshold(narrow, "_sk", tie, n, log=log, counts=[
            (r["_b"], r["_c"]) for r in rows if r["_b"] is not None])

    def keep(records: DataFrame) -> DataFrame:
        # the key is null exactly when the weight is not positive: filtering on
        # the weight is cheaper and reaches the scan
        drawn = w.isNotNull() & (w > F.lit(float("-inf"))) if log else w > 0
        return apply_threshold(with_key(records.filter(drawn)), "_sk", tie, thr, grouped,
                               key_not_null=True).drop("_sk")

    return keep


def _refuse(bad: int | None) -> None:
    if bad:
        raise ValueError(f"{bad} weights are negative, NaN or infinite")


def weighted_sample(df: DataFrame, n: int | None = None, weight: str = "weight",
                    key: str | Sequence[str] = "uuid", seed: int | str = 0, cap: bool = False,
                    validate: bool = True, fraction: float | None = None,
                    tie: str | Sequence[str] | None = None,
                    log_weight: str | None = None) -> DataFrame:
    """n rows without replacement, successive draws proportional to ``weight``.
    Null weight counts as 0; weight 0 is never drawn; ties broken by ``key``.
    Negative, NaN and infinite weights are refused, and more rows than have a positive
    weight (unless ``cap``). ``fraction`` instead of ``n``: that share of the rows with
    a positive weight. ``key`` may be several columns; exactly n rows also where keys
    repeat (``tie`` orders those). ``log_weight``: see ``draw_rule``."""
    rule = draw_rule(df, weight, key, seed, n=n, fraction=fraction, cap=cap, validate=validate,
                     tie=tie, log_weight=log_weight)
    return rule(df)


def weighted_sample_by(df: DataFrame, quotas: DataFrame | Mapping[str, int],
                       by: str = "dataset", weight: str = "weight", key: str = "uuid",
                       seed: int | str = 0, cap: bool = False, validate: bool = True,
                       log_weight: str | None = None) -> DataFrame:
    """Per-group quotas: ``quotas`` is ``(by, n)`` as a DataFrame or a dict."""
    rule = draw_rule(df, weight, key, seed, quotas=quotas, by=by, cap=cap, validate=validate,
                     log_weight=log_weight)
    return rule(df)


def total_quota(quotas: DataFrame, n: str = "n") -> DataFrame:
    """One row: the ``total`` of the quotas and the number of datasets."""
    return quotas.agg(F.sum(n).cast("long").alias("total"),
                      F.count(F.lit(1)).alias("n_datasets"))


def sample_k(df: DataFrame, k: int, key: str | Sequence[str], seed: int | str = 0) -> DataFrame:
    """k rows uniformly without replacement (reproducible)."""
    keyed = df.withColumn("_sk", -F.log(uniform(key, seed)))
    return select_smallest(keyed, "_sk", key, k).drop("_sk")


def shuffle_rows(df: DataFrame, key: str, seed: int | str = 0, name: str = "position",
                 row_key: Sequence[str] = ()) -> DataFrame:
    """A random order of all rows: ``name`` is the 1-based position. ``row_key``: columns
    no two rows agree in; only they are sorted then, not whole records."""
    keyed = df.withColumn("_u", uniform(key, seed))
    return global_rank(keyed, ["_u", key], name=name, row_key=row_key).drop("_u")


def head_k(df: DataFrame, k: int, order_by: Sequence[str]) -> DataFrame:
    """First k rows in ``order_by`` order (a top-k: the limit is the feature)."""
    return df.orderBy(*order_by).limit(k)


def slice_input(df: DataFrame, start: int, total: int, id_col: str | None = None,
                order_by: Sequence[str] = (), row_key: Sequence[str] = ()) -> DataFrame:
    """Skip ids below ``start``, keep the next ``total`` rows in id order (the
    slice is the feature). With ``order_by`` a record without an id of its own
    goes by its position in that order (0-based, added as ``position``); ties go
    by ``order_by``. With ``row_key`` (columns no two rows agree in) the slice is
    found on those columns alone and only its records are read."""
    ident = F.col(id_col) if id_col else None
    if not order_by:
        return df.filter(ident >= start).orderBy(ident).limit(total)
    narrow = df
    if row_key:
        narrow = df.select(*dict.fromkeys([*row_key, *order_by, *([id_col] if id_col else [])]))
    ranked = global_rank(narrow, list(order_by), name="position", start=0)
    place = F.col("position")
    ident = place if ident is None else F.coalesce(ident.cast("long"), place)
    cut = ranked.filter(ident >= start).orderBy(ident, *order_by).limit(total)
    if not row_key:
        return cut
    return df.join(cut.select(*row_key, "position"), list(row_key))


def assign_batches(df: DataFrame, size: int, order: str = "input", order_by: Sequence[str] = (),
                   key: str | None = None, seed: int | str = 0,
                   row_key: Sequence[str] = ()) -> DataFrame:
    """``batch_id = floor(ordinal / size)`` over the input order or a random
    order; the last batch may be short. Adds ``ordinal`` (0-based) too. ``row_key``:
    see ``shuffle_rows``."""
    if order == "input":
        ranked = global_rank(df, list(order_by), name="ordinal", start=0, row_key=row_key)
    elif order == "random":
        keyed = df.withColumn("_u", uniform(key, seed))
        ranked = global_rank(keyed, ["_u", key], name="ordinal", start=0,
                             row_key=row_key).drop("_u")
    else:
        raise ValueError("order must be 'input' or 'random'")
    return ranked.withColumn("batch_id", F.floor(F.col("ordinal") / F.lit(size)).cast("long"))
