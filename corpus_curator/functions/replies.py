"""Model replies -> typed records, as column expressions.

Every check is a built-in expression (regex, JSON functions, membership), so
validation runs inside whole-stage code generation next to the scan; nothing is
evaluated with ``eval``. A rejected row is kept with a ``status`` naming the
reason instead of being printed and dropped.

Statuses: ``ok``, ``failed`` (the call failed), ``no_json`` (not a JSON object
or array, or text after it), ``missing_key``, ``bad_first_level``, ``bad_path``,
``not_three_levels``, ``no_choice``.
"""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (CHOICE_PATTERN, FAILED, FENCE_CLOSE, FENCE_OPEN, FIRST_LEVEL_TAGS,
                         WHY_PATTERN)

STRICT_SHAPE = r"(?s)^\s*[\{\[].*[\}\]]\s*$"
_FENCE_BODY = r"(?s)^```json\s*(.*?)\s*```$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Remove leading and trailing whitespace (all kinds, like ``str.strip``)."""
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")


def remove_fence(c) -> Column:
    """Unwrap a reply that starts with ```json and ends with ``` exactly."""
    r = _c(c)
    fenced = r.startswith(FENCE_OPEN) & r.endswith(FENCE_CLOSE)
    return F.when(fenced, F.regexp_extract(r, _FENCE_BODY, 1)).otherwise(r)


def json_body(reply) -> Column:
    """The fence-free reply if it is one JSON object or array and nothing else
    (put in an array it makes an array of one element), else null."""
    body = remove_fence(reply)
    alone = F.json_array_length(F.concat(F.lit("["), body, F.lit("]"))) == 1
    return F.when(body.rlike(STRICT_SHAPE) & alone, body)


def has_keys(keys: Column, *names: str) -> Column:
    cond = None
    for n in names:
        c = F.coalesce(F.array_contains(keys, n), F.lit(False))
        cond = c if cond is None else cond & c
    return cond


def parse_choice(df: DataFrame, reply_col: str = "reply") -> DataFrame:
    """Pairwise reply -> ``win`` ('1'/'2'), ``why`` and ``status``. Valid iff
    ``Choice: [12]`` occurs exactly once; ``why`` is the rest of the line after
    the first ``Why: `` (empty when absent)."""
    r = strip_ws(reply_col)
    choices = F.regexp_extract_all(r, F.lit(CHOICE_PATTERN), 1)
    status = (F.when(F.col(reply_col).isNull() | (F.col(reply_col) == FAILED), F.lit("failed"))
              .when(F.size(choices) != 1, F.lit("no_choice"))
              .otherwise(F.lit("ok")))
    ok = status == "ok"
    return (df.withColumn("_choices", choices)
            .withColumn("status", status.cast("string"))
            .withColumn("win", F.when(ok, F.element_at(F.col("_choices"), 1)))
            .withColumn("why", F.when(ok, F.regexp_extract(r, WHY_PATTERN, 1)))
            .drop("_choices"))


def _object_status(reply: Column, body: Column, keys: Column, required) -> Column:
    return (F.when(reply.isNull() | (reply == FAILED), F.lit("failed"))
            .when(body.isNull() | keys.isNull(), F.lit("no_json"))
            .when(~has_keys(keys, *required), F.lit("missing_key")))


def _literal_json(text):
    """A Python-literal dict/list reply as JSON text (``ast.literal_eval``: no
    code runs), else None."""
    if text is None:
        return None
    try:
        value = ast.literal_eval(text)
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        return None
    if not isinstance(value, (dict, list)):
        return None
    try:
        return json.dumps(value, ensure_ascii=False)
    except (TypeError, ValueError):
        return None


def _literal_series(replies: pd.Series) -> pd.Series:
    return replies.map(_literal_json)


_LITERAL_UDF = []


def literal_to_json(c) -> Column:
    """Arrow-batched conversion of Python-literal replies to JSON (the pandas
    UDF is created on first use, when a session exists)."""
    if not _LITERAL_UDF:
        _LITERAL_UDF.append(F.pandas_udf(_literal_series, "string"))
    return _LITERAL_UDF[0](c)


def parse_reply(df: DataFrame, schema: str, reply_col: str = "reply",
                required: tuple[str, ...] = (), literal: bool = False) -> DataFrame:
    """Reply -> ``parsed`` struct of ``schema`` and a ``status`` for the shape
    and the ``required`` keys (a key with a null value counts as present).
    ``literal=True`` reads Python-literal replies (single quotes, None,
    trailing commas) through ``ast.literal_eval`` in a pandas UDF."""
    body = literal_to_json(remove_fence(reply_col)) if literal else json_body(reply_col)
    d = df.withColumn("_body", body).withColumn("_keys", F.json_object_keys("_body"))
    status = _object_status(F.col(reply_col), F.col("_body"), F.col("_keys"), required)
    return (d.withColumn("status", F.coalesce(status, F.lit("ok")))
            .withColumn("parsed", F.when(F.col("status") == "ok", F.from_json("_body", schema)))
            .drop("_body", "_keys"))


def validate_summary(df: DataFrame, reply_col: str = "reply", literal: bool = False) -> DataFrame:
    """Summary reply: ``summary`` must be present."""
    p = parse_reply(df, "summary string", reply_col, ("summary",), literal)
    return p.withColumn("summary", F.col("parsed.summary")).drop("parsed")


def validate_first_level(df: DataFrame, reply_col: str = "reply",
                         vocabulary: list[str] = FIRST_LEVEL_TAGS,
                         literal: bool = False) -> DataFrame:
    """First-level reply: ``tag`` and ``explanation`` present, tag one of the
    vocabulary (case-sensitive); the tag is stored lower-cased."""
    p = parse_reply(df, "tag string, explanation string", reply_col, ("tag", "explanation"),
                    literal)
    tag = F.col("parsed.tag")
    bad = (F.col("status") == "ok") & ~F.coalesce(tag.isin(vocabulary), F.lit(False))
    return (p.withColumn("status", F.when(bad, F.lit("bad_first_level")).otherwise(F.col("status")))
            .withColumn("first_level_tag", F.when(F.col("status") == "ok", F.lower(tag)))
            .withColumn("first_level_explanation",
                        F.when(F.col("status") == "ok", F.col("parsed.explanation")))
            .drop("parsed"))


def validate_second_third(df: DataFrame, taxonomy: DataFrame, reply_col: str = "reply",
                          first_col: str = "first_level_tag", literal: bool = False) -> DataFrame:
    """Second/third-level reply: the three keys present and the path
    (first, second, third) an edge of the taxonomy; stored lower-cased."""
    p = parse_reply(df, "second_level_tag string, third_level_tag string, explanation string",
                    reply_col, ("second_level_tag", "third_level_tag", "explanation"), literal)
    edges = (taxonomy.select(F.lower("first").alias("_f"), F.col("second").alias("_s"),
                             F.col("third").alias("_t")).distinct().withColumn("_hit", F.lit(True)))
    j = p.join(edges, (F.lower(F.col(first_col)) == F.col("_f"))
               & (F.col("parsed.second_level_tag") == F.col("_s"))
               & (F.col("parsed.third_level_tag") == F.col("_t")), "left")
    bad = (F.col("status") == "ok") & F.col("_hit").isNull()
    ok = F.col("status") == "ok"
    return (j.withColumn("status", F.when(bad, F.lit("bad_path")).otherwise(F.col("status")))
            .withColumn(first_col, F.when(ok, F.lower(F.col(first_col))).otherwise(F.col(first_col)))
            .withColumn("second_level_tag", F.when(ok, F.lower("parsed.second_level_tag")))
            .withColumn("third_level_tag", F.when(ok, F.lower("parsed.third_level_tag")))
            .withColumn("second_third_explanation", F.when(ok, F.col("parsed.explanation")))
            .drop("parsed", "_f", "_s", "_t", "_hit"))


def validate_flat_tags(df: DataFrame, reply_col: str = "reply",
                       vocabulary: list[str] = FIRST_LEVEL_TAGS,
                       literal: bool = False) -> DataFrame:
    """Flat three-level tags: a JSON array whose every element has ``tag`` and
    ``explanation``; keep elements whose tag has exactly three ``>`` parts and
    a known (trimmed, case-sensitive) first part; reject when none is left.
    Adds ``tags`` (array of struct<tag, explanation>)."""
    body = literal_to_json(remove_fence(reply_col)) if literal else json_body(reply_col)
    items = F.from_json(body, "array<map<string,string>>")
    vocab = F.array(*[F.lit(v) for v in vocabulary])
    d = df.withColumn("_items", F.when(F.json_array_length(body).isNotNull(), items))
    all_keys = F.forall("_items", lambda m: F.map_contains_key(m, "tag")
                        & F.map_contains_key(m, "explanation"))
    kept = F.filter("_items", lambda m: (F.size(F.split(m["tag"], ">", -1)) == 3)
                    & F.coalesce(F.array_contains(vocab, strip_ws(F.split(m["tag"], ">", -1)[0])),
                                 F.lit(False)))
    status = (F.when(F.col(reply_col).isNull() | (F.col(reply_col) == FAILED), F.lit("failed"))
              .when(F.col("_items").isNull(), F.lit("no_json"))
              .when(~all_keys, F.lit("missing_key"))
              .when(F.size(kept) == 0, F.lit("not_three_levels"))
              .otherwise(F.lit("ok")))
    return (d.withColumn("status", status)
            .withColumn("tags", F.when(F.col("status") == "ok", F.transform(
                kept, lambda m: F.struct(m["tag"].alias("tag"),
                                         m["explanation"].alias("explanation")))))
            .drop("_items"))


def split_status(df: DataFrame, status_col: str = "status") -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected rows with their reason)."""
    return (df.filter(F.col(status_col) == "ok"), df.filter(F.col(status_col) != "ok"))


def reject_reasons(df: DataFrame, status_col: str = "status") -> DataFrame:
    """Rows per status."""
    return df.groupBy(status_col).agg(F.count(F.lit(1)).alias("n"))
