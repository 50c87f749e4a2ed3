"""Rating columns -> sampling weights.

clean_scores   keep a row only if every score parses as a number in [0, 100]
score_stats    mean and sample standard deviation of each score, one aggregate
exp_zscores    exp((x - mean) / std) per score; a null z (std 0 or null) drops the row
rating_weight  sum of w_f * exp(z_f)

All of it is column expressions: no Python UDF, so filters stay next to the
scan and the statistics are one pass. The statistics are two scalars per score
that become literals of the second pass. exp(z) of an outlier can exceed a double;
the draw goes by the logarithm of the weight (``log_weight``), which does not.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import RATING_WEIGHTS, SCORE_ALIASES, SCORE_FIELDS, SCORE_MAX, SCORE_MIN

# A plain decimal number (optional sign, digits, optional fraction, optional
# exponent): rejects 'nan', 'inf', '5d', '5f' that a cast would accept.
NUMBER_RE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def canonical_fields(df: DataFrame, fields: Sequence[str] = SCORE_FIELDS) -> DataFrame:
    """Rename input aliases (``obscurity`` -> ``scarcity``)."""
    for alias, name in SCORE_ALIASES.items():
        if alias not in df.columns:
            continue
        if name in df.columns:  # both declared: take whichever the record has
            df = df.withColumn(name, F.coalesce(F.col(f"`{name}`"), F.col(f"`{alias}`"))).drop(alias)
        else:
            df = df.withColumnRenamed(alias, name)
    return df


def parse_score(c: Column) -> Column:
    """A plain decimal number as double, else null (try_cast keeps ANSI mode
    from raising on odd strings)."""
    s = c.cast("string")
    return F.when(s.rlike(NUMBER_RE), F.trim(s).try_cast("double"))


def in_range(x: Column) -> Column:
    return F.when(x.between(SCORE_MIN, SCORE_MAX), x)


def valid_score(c: Column) -> Column:
    """Score as double if it is a number in the closed range, else null."""
    return in_range(parse_score(c))


def clean_scores(df: DataFrame, fields: Sequence[str] = SCORE_FIELDS) -> DataFrame:
    """Scores as doubles; rows with any invalid score are dropped."""
    df = canonical_fields(df, fields)
    # parse in one projection of its own: the range check and the filter then
    # refer to the parsed column, not to copies of the regex and the cast
    tmp = {f: f"_x{i}" for i, f in enumerate(fields)}
    df = df.select("*", *[parse_score(F.col(f"`{f}`")).alias(t) for f, t in tmp.items()])
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in fields
                     and c not in tmp.values()],
                   *[in_range(F.col(t)).alias(f) for f, t in tmp.items()])
    keep = None
    for f in fields:
        cond = F.col(f"`{f}`").isNotNull()
        keep = cond if keep is None else keep & cond
    return df.filter(keep)


def _stat_columns(fields: Sequence[str]) -> list:
    aggs = []
    for f in fields:
        aggs.append(F.avg(F.col(f"`{f}`")).alias(f"{f}_mean"))
        aggs.append(F.stddev_samp(F.col(f"`{f}`")).alias(f"{f}_std"))
    return aggs


def score_stats(df: DataFrame, fields: Sequence[str] = SCORE_FIELDS) -> DataFrame:
    """One row: ``<f>_mean`` and ``<f>_std`` (sample) for every field."""
    return df.agg(*_stat_columns(fields))


def rating_stats(clean: DataFrame, fields: Sequence[str] = SCORE_FIELDS) -> dict:
    """Means, sample standard deviations and the number of rows whose
    z-scores are all defined (``rows``), from one aggregate over clean scores."""
    stats = clean.agg(*_stat_columns(fields), F.count(F.lit(1)).alias("_rows")).first().asDict()
    defined = all(stats[f"{f}_std"] not in (None, 0.0) for f in fields)
    stats["rows"] = stats["_rows"] if defined else 0
    return stats


def _z(df: DataFrame, fields: Sequence[str], counts: dict | None = None,
           stats: dict | None = None):
    """z column and non-null condition per field, from one aggregate pass
    over ``df`` unless ``stats`` are given (the 16 statistics are scalars).
    ``counts`` receives the number of rows whose z-scores are all defined."""
    if stats is None:
        stats = rating_stats(df, fields)
    if counts is not None:
        counts["rows"] = stats["rows"]
    cols, cond = {}, None
    for f in fields:
        mean, std = stats[f"{f}_mean"], stats[f"{f}_std"]
        z = F.try_divide(F.col(f"`{f}`") - F.lit(mean).cast("double"), F.lit(std).cast("double"))
        cols[f] = z
        c = z.isNotNull()
        cond = c if cond is None else cond & c
    return cols, cond


def exp_zscores(df: DataFrame, fields: Sequence[str] = SCORE_FIELDS,
                keep: Sequence[str] = ("uuid",)) -> DataFrame:
    """``keep`` columns plus exp(z) of every field, for rows whose scores are
    clean; a null z (zero or undefined std) drops the row."""
    cols, cond = _z(df, fields)
    return df.filter(cond).select(*[F.col(c) for c in keep],
                                  *[F.exp(c).alias(f) for f, c in cols.items()])


def log_weight(z: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    """ln(sum of w_f * exp(z_f)) without leaving the range of a double: the largest term
    is taken out of the sum. The terms are one array that the expression names once, so
    that a filter on the weight can be pushed below it without copying every score many
    times. Weights are not negative; those of 0 do not count."""
    if min(weights.values()) < 0:
        raise ValueError("weights must not be negative")
    terms = [z[f] + F.lit(math.log(w)) for f, w in weights.items() if w > 0]
    if not terms:
        return F.lit(float("-inf"))

    def summed(a: Column) -> Column:
        top = F.array_max(a)
        return top + F.log(F.aggregate(a, F.lit(0.0), lambda acc, t: acc + F.exp(t - top)))

    return F.transform(F.array(F.array(*terms)), summed)[0]


def with_rating_weight(df: DataFrame, fields: Sequence[str] = SCORE_FIELDS,
                       weights: Mapping[str, float] = RATING_WEIGHTS,
                       name: str = "weight", counts: dict | None = None,
                       stats: dict | None = None, log_name: str | None = None) -> DataFrame:
    """Clean records plus ``name`` = sum of w_f * exp(z_f); every other column
    (text included) is kept as it is. ``counts["rows"]`` gets the number of
    weighted rows (all weights are positive), from the statistics pass;
    ``stats`` (from ``rating_stats``) skips that pass. ``log_name``: also the
    logarithm of the weight, which is finite where the weight overflows."""
    clean = clean_scores(df, fields)
    cols, cond = _z(clean, fields, counts, stats)
    total = None
    for f, w in weights.items():
        term = F.exp(cols[f]) * F.lit(float(w))
        total = term if total is None else total + term
    out = clean.filter(cond).withColumn(name, total)
    return out.withColumn(log_name, log_weight(cols, weights)) if log_name else out


def rating_weight(df: DataFrame, weights: Mapping[str, float] = RATING_WEIGHTS,
                  name: str = "weight") -> DataFrame:
    """Add ``name`` = sum of weight * column."""
    total = None
    for f, w in weights.items():
        term = F.col(f"`{f}`") * F.lit(float(w))
        total = term if total is None else total + term
    return df.withColumn(name, total)


def rating_probability(df: DataFrame, fields: Sequence[str] = SCORE_FIELDS,
                       weights: Mapping[str, float] = RATING_WEIGHTS,
                       keep: Sequence[str] = ("uuid",)) -> DataFrame:
    """clean -> exp(z) -> combined weight, one plan."""
    z = exp_zscores(clean_scores(df, fields), fields, keep)
    return rating_weight(z, weights)
