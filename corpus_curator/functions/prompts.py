"""Prompt templates and their rendering as column expressions.

A template is text with named slots ``{name}`` (or one positional ``{}``) and
``{{`` / ``}}`` for literal braces. Rendering splits the template once on the
driver into literal segments and slots and builds ``concat(lit, col, lit, ...)``:
a text that itself contains ``{text_2}`` is never expanded again (chained
``replace`` would do that), and the work stays a JVM expression.
"""

from __future__ import annotations

import os
import re
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import MAX_PROMPT_TOKENS, SMALL_PROMPT_TOKENS

TEMPLATE_DIR = os.path.join(os.path.dirname(os.path.dirname(__file__)), "templates")
_SLOT = re.compile(r"\{\{|\}\}|\{([A-Za-z_][A-Za-z0-9_]*)?\}")

# token counter default: one token per CJK ideograph, one per run of letters/digits
TOKEN_PATTERN = r"[\x{4e00}-\x{9fff}]|[\p{L}\p{N}]+"


def default_templates() -> dict[str, str]:
    """The templates shipped with the package (own wording), by task name."""
    out = {}
    for name in sorted(os.listdir(TEMPLATE_DIR)):
        if name.endswith(".txt"):
            with open(os.path.join(TEMPLATE_DIR, name), encoding="utf-8") as fh:
                out[name[:-4]] = fh.read()
    return out


def split_template(template: str) -> list[tuple[str, str]]:
    """[('lit', text) | ('slot', name)]; positional ``{}`` is slot ''."""
    parts: list[tuple[str, str]] = []
    buf, pos = [], 0
    for m in _SLOT.finditer(template):
        buf.append(template[pos:m.start()])
        tok = m.group(0)
        if tok == "{{":
            buf.append("{")
        elif tok == "}}":
            buf.append("}")
        else:
            parts.append(("lit", "".join(buf)))
            buf = []
            parts.append(("slot", m.group(1) or ""))
        pos = m.end()
    buf.append(template[pos:])
    parts.append(("lit", "".join(buf)))
    return [p for p in parts if p != ("lit", "")]


def render(template: str, slots: Mapping[str, Column | str], append: Column | str | None = None) -> Column:
    """The template with each slot replaced by its column. A template without
    any slot gets ``append`` added at the end (when given)."""
    pieces = []
    has_slot = False
    for kind, val in split_template(template):
        if kind == "lit":
            pieces.append(F.lit(val))
        else:
            has_slot = True
            if val not in slots:
                raise KeyError(f"no column for slot {{{val}}}")
            c = slots[val]
            pieces.append(F.col(c) if isinstance(c, str) else c)
    if not has_slot and append is not None:
        pieces.append(F.col(append) if isinstance(append, str) else append)
    return F.concat(*pieces) if pieces else F.lit("")


def render_pair_prompt(df: DataFrame, template: str, text_1: str = "text_1",
                       text_2: str = "text_2", out: str = "prompt") -> DataFrame:
    """Pairwise prompt from both texts."""
    return df.withColumn(out, render(template, {"text_1": text_1, "text_2": text_2}))


def render_prompt(df: DataFrame, template: str, text_col: str = "text", max_chars: int | None = None,
                  out: str = "prompt", extra: Mapping[str, Column | str] | None = None) -> DataFrame:
    """One-document prompt (``{instance}``) of the whole text; ``max_chars`` cuts it."""
    text = F.col(text_col) if max_chars is None else F.substring(F.col(text_col), 1, max_chars)
    slots = {"instance": text, **(extra or {})}
    return df.withColumn(out, render(template, slots))


def subtree_json(taxonomy: DataFrame) -> DataFrame:
    """``first -> JSON {second: {third: ""}}`` with keys in sorted order, one
    row per first-level tag (grouped from the small edge table)."""
    lvl2 = (taxonomy.groupBy(F.lower("first").alias("first"), "second")
            .agg(F.map_from_entries(F.array_sort(F.collect_set(
                F.struct(F.col("third").alias("k"), F.lit("").alias("v"))))).alias("m")))
    by_key = lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)
    lvl1 = lvl2.groupBy("first").agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct(F.col("second").alias("k"), F.col("m").alias("v"))), by_key)).alias("tree"))
    return lvl1.select("first", F.to_json("tree").alias("tag_tree"))


def render_subtree_prompt(df: DataFrame, taxonomy: DataFrame, template: str,
                          text_col: str = "text", first_col: str = "first_level_tag",
                          max_chars: int | None = None, out: str = "prompt") -> DataFrame:
    """Second/third-level prompt with the first tag and that tag's subtree.
    A first tag missing from the taxonomy gets a null prompt and
    ``status = 'bad_first_level'``."""
    trees = subtree_json(taxonomy).withColumnRenamed("first", "_first")
    j = df.join(trees, F.lower(F.col(first_col)) == F.col("_first"), "left")
    text = F.col(text_col) if max_chars is None else F.substring(F.col(text_col), 1, max_chars)
    prompt = render(template, {"instance": text, "first_level_tag": F.col(first_col),
                               "tag_tree": F.col("tag_tree")})
    return (j.withColumn(out, F.when(F.col("_first").isNotNull(), prompt))
            .withColumn("status", F.when(F.col("_first").isNull(), F.lit("bad_first_level"))
                        .otherwise(F.lit("ok")))
            .drop("_first", "tag_tree"))


def render_edit_prompt(df: DataFrame, templates: Mapping[str, str], lang_col: str = "lang",
                       text_col: str = "text", out: str = "prompt") -> DataFrame:
    """Paraphrase prompt by language: ``edit_zh`` for Chinese, ``edit_en``
    otherwise; a template without a slot gets the text appended."""
    en = render(templates["edit_en"], {"": text_col}, append=text_col)
    zh = render(templates["edit_zh"], {"": text_col}, append=text_col)
    return df.withColumn(out, F.when(F.col(lang_col) == "zh", zh).otherwise(en))


def token_count(c: Column | str, pattern: str = TOKEN_PATTERN) -> Column:
    """Approximate token count: matches of ``pattern``."""
    col = F.col(c) if isinstance(c, str) else c
    return F.size(F.regexp_extract_all(col, F.lit(pattern), 0)).cast("long")


def classify_prompt_size(df: DataFrame, prompt_col: str = "prompt", counter=None,
                         out: str = "size_class") -> DataFrame:
    """``n_tokens`` and ``size_class``: small (< 3800), large (< 16000) or
    fail. ``counter`` maps the prompt column to a count column (e.g. a pandas
    UDF over a real tokenizer); default is ``token_count``."""
    n = (counter or token_count)(F.col(prompt_col))
    d = df.withColumn("n_tokens", n)
    return d.withColumn(out, F.when(F.col("n_tokens") < SMALL_PROMPT_TOKENS, F.lit("small"))
                        .when(F.col("n_tokens") < MAX_PROMPT_TOKENS, F.lit("large"))
                        .otherwise(F.lit("fail")))


def pandas_token_counter(count_one):
    """Wrap a Python ``str -> int`` tokenizer count (e.g. a local BPE model) as
    an Arrow-batched pandas UDF usable as ``classify_prompt_size(counter=...)``.
    The tokenizer is created once per Python worker by the caller's closure."""

    @F.pandas_udf("long")
    def _count(prompts: pd.Series) -> pd.Series:
        return prompts.map(lambda p: None if p is None else int(count_one(p))).astype("Int64")

    return lambda c: _count(c)
