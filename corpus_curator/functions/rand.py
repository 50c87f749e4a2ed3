"""Reproducible randomness as column expressions.

``uniform(key, salt)`` maps a key to a number in (0, 1) through md5: the first
12 hex digits (48 bits) plus one half, over 2^48. It depends only on the key
and the salt, never on partitioning or task order, so every draw is the same
on 1 or 1000 executors and the same number can be computed in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_48 = 281474976710656.0


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def keyed(key, salt=None) -> Column:
    """The string that is hashed: ``key`` or ``key:salt``; several key columns
    are joined by ``|``."""
    if isinstance(key, (list, tuple)):
        k = F.concat_ws("|", *[_col(c).cast("string") for c in key])
    else:
        k = _col(key).cast("string")
    if salt is None:
        return k
    return F.concat(k, F.lit(f":{salt}"))


def uniform_of(key_string: Column) -> Column:
    """U[k] for a string column k."""
    hi48 = F.conv(F.substring(F.md5(key_string), 1, 12), 16, 10).cast("bigint")
    return (hi48.cast("double") + F.lit(0.5)) / F.lit(TWO_POW_48)


def uniform(key, salt=None) -> Column:
    """Uniform variate in (0, 1) from ``key`` (any type) and an optional salt."""
    return uniform_of(keyed(key, salt))


def sampling_key(weight, key, seed) -> Column:
    """Efraimidis-Spirakis key ``-ln(u)/w``: the n smallest keys are a draw of
    n rows without replacement, each draw proportional to weight.
    Rows with a null or non-positive weight get a null key (never drawn)."""
    w = _col(weight).cast("double")
    u = uniform(key, seed)
    return F.when(w > 0, -F.log(u) / w)


def log_sampling_key(log_weight, key, seed) -> Column:
    """The logarithm of ``sampling_key`` from the logarithm of the weight, ``ln(-ln u) -
    ln w``: no weight is too large or too small for it. Null for a null log weight
    and for minus infinity (weight 0)."""
    lw = _col(log_weight).cast("double")
    return F.when(lw > F.lit(float("-inf")), F.log(-F.log(uniform(key, seed))) - lw)


def sql_uniform(key_sql: str, salt=None) -> str:
    """The same variate as DuckDB SQL text (used by the oracle)."""
    k = f"CAST({key_sql} AS VARCHAR)"
    if salt is not None:
        k = f"({k} || ':{salt}')"
    return f"((('0x' || substr(md5({k}), 1, 12))::BIGINT + 0.5) / 281474976710656.0::DOUBLE)"
