"""Record shapes of the toolkit derived from the driver tables.

The enriched corpus (rating columns, tag columns), the taxonomy and model
replies are not part of the given data, so they are derived from ``documents``
by md5 rules (``U[k]`` = uniform variate of the string k; ``K(name)`` =
``doc_id || ':' || name``). The same rules are written as SQL for the oracle,
so both engines see identical inputs. Every derived table grows with
``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import FIRST_LEVEL_TAGS, PAIR_COMPARE, PAIR_SEED, SCORE_FIELDS
from ..functions.rand import uniform
from ..operators.shape import stable_uuid
from ..session import materialize

FIRST_LOWER = [n.lower() for n in FIRST_LEVEL_TAGS]

# derived tables stand for input files: built once per session and scale
# directory (checkpointed), then read like files by every later query
_BUILT: dict = {}


def _once(name: str, spark: SparkSession, sf_dir: str, build) -> DataFrame:
    key = (name, sf_dir, spark.sparkContext.applicationId)
    if key not in _BUILT:
        _BUILT[key] = build()
    return _BUILT[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, as it is."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _dirty_score(f: str, u: Column, v: Column) -> Column:
    return (F.when(u < 0.01, F.lit("n/a")).when(u < 0.02, F.lit("-3"))
            .when(u < 0.03, F.lit("104")).when(u < 0.035, F.lit(None).cast("string"))
            .when(u < 0.04, F.lit("nan"))
            .otherwise(F.floor(F.lit(101) * v).cast("int").cast("string")))


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``uuid, dataset, doc_id`` + eight string score columns (some dirty).
    Materialised like the enriched files it stands for."""
    return _once("rated", spark, sf_dir, lambda: _rated(spark, sf_dir))


def _rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    # the variates get a projection of their own so each md5 runs once per row
    d = d.select("doc_id", "source",
                 *[uniform("doc_id", f).alias(f"_u{i}") for i, f in enumerate(SCORE_FIELDS)],
                 *[uniform("doc_id", f"{f}:v").alias(f"_v{i}") for i, f in enumerate(SCORE_FIELDS)])
    return materialize(d.select(
        stable_uuid("doc_id").alias("uuid"), F.col("source").alias("dataset"), "doc_id",
        *[_dirty_score(f, F.col(f"_u{i}"), F.col(f"_v{i}")).alias(f)
          for i, f in enumerate(SCORE_FIELDS)]))


def with_text(spark: SparkSession, sf_dir: str, records: DataFrame) -> DataFrame:
    """Enriched records that carry their document (text, language), as the
    enriched corpus files do. Materialised."""
    d = documents(spark, sf_dir).select("doc_id", "text", "lang")
    return materialize(records.join(d, "doc_id"))


def _pick_first(u: Column, proper: bool = False) -> Column:
    names = FIRST_LEVEL_TAGS if proper else FIRST_LOWER
    return F.element_at(F.array(*[F.lit(n) for n in names]),
                        (F.floor(F.lit(21) * u * u) + 1).cast("int"))


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``uuid, dataset, doc_id``, three (skewed) tags and the ``in_tree`` flag.
    Materialised like the enriched files it stands for."""
    return _once("tagged", spark, sf_dir, lambda: _tagged(spark, sf_dir))


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    # variates first, then the tag path, then the strings: each md5 runs once
    d = d.select("doc_id", "source", uniform("doc_id", "t1").alias("_u1"),
                 uniform("doc_id", "t2").alias("_u2"), uniform("doc_id", "t3").alias("_u3"),
                 uniform("doc_id", "tree").alias("_ut"))
    d = d.select("doc_id", "source", "_ut", _pick_first(F.col("_u1")).alias("_f"),
                 F.floor(F.lit(5) * F.col("_u2") * F.col("_u2")).cast("int").cast("string").alias("_sx"),
                 F.floor(F.lit(4) * F.col("_u3")).cast("int").cast("string").alias("_tx"))
    ut = F.col("_ut")
    return materialize(d.select(
        stable_uuid("doc_id").alias("uuid"), F.col("source").alias("dataset"),
        "doc_id", F.col("_f").alias("first_level_tag"),
        F.concat("_f", F.lit(" s"), "_sx").alias("second_level_tag"),
        F.concat("_f", F.lit(" s"), "_sx", F.lit(" t"), "_tx").alias("third_level_tag"),
        F.when(ut < 0.02, F.lit(None).cast("boolean")).otherwise(ut >= 0.1).alias("in_tree")))


def _capital(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 20))


def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``first, second, third`` edges: the distinct tag paths of the documents,
    with capitals, minus about a tenth. Materialised like a stored taxonomy."""
    def build():
        paths = tagged(spark, sf_dir).select(
            "first_level_tag", "second_level_tag", "third_level_tag").distinct()
        return materialize(paths.filter(uniform("third_level_tag") >= 0.1).select(
            _capital("first_level_tag").alias("first"),
            _capital("second_level_tag").alias("second"),
            _capital("third_level_tag").alias("third")))
    return _once("taxonomy", spark, sf_dir, build)


def boost_list() -> list[str]:
    """Tags whose documents are up-weighted in the tag sampler (parameter)."""
    return ["law", "education s1", "sports s0 t2", "military s2 t1"]


PAIRS_PER_DOC = 3
RATE_TASK, OTHER_TASK = "educational_value", "writing_style"  # by the pair's parity


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balanced comparison pairs over all documents: 3 random pairs per
    document, topped up to 6 comparisons each. Materialised."""
    from ..operators.pairs import balanced_pairs

    def build():
        ids = documents(spark, sf_dir).select(F.col("doc_id").alias("id"))
        n = ids.count()
        return materialize(balanced_pairs(ids, PAIRS_PER_DOC * n, PAIR_COMPARE, PAIR_SEED))
    return _once("pairs", spark, sf_dir, build)


def pair_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pair_id, id_1, id_2, reply``: model reply per pair (failed calls,
    ambiguous answers, leading blanks included)."""
    d = documents(spark, sf_dir).select(F.col("doc_id").alias("id_1"), F.col("n_chars").alias("_n1"))
    p = pairs(spark, sf_dir).join(d, "id_1").withColumn("_u", uniform("pair_id", "r"))
    u = F.col("_u")
    reply = (F.when(u < 0.04, F.lit("<<FAILED>>"))
             .when(u < 0.08, F.lit("Choice: 1\nChoice: 2"))
             .when(F.pmod(F.col("_n1"), F.lit(2)) == 0, F.lit("Choice: 1\nWhy: even length"))
             .otherwise(F.lit("  Choice: 2\nWhy: odd length")))
    return p.select("pair_id", "id_1", "id_2", reply.alias("reply"))


def judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``task, pair_id, pair_ids, win, why`` for the pairs with a valid choice.
    Materialised like the judgement files it stands for."""
    from ..functions.replies import parse_choice

    def build():
        j = parse_choice(pair_replies(spark, sf_dir)).filter(F.col("status") == "ok")
        task = F.when(F.col("pair_id") % 2 == 0, RATE_TASK).otherwise(OTHER_TASK)
        return materialize(j.select(task.alias("task"), "pair_id",
                                    F.array("id_1", "id_2").alias("pair_ids"), "win", "why"))
    return _once("judgements", spark, sf_dir, build)


def planted_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``task, winner, loser``: cycles of five documents, joined one way."""
    d = documents(spark, sf_dir).select("doc_id")
    g, k = F.floor(F.col("doc_id") / 5), F.col("doc_id") % 5
    inside = d.filter((k < 4) | (g % 7 != 0)).select(
        F.col("doc_id").alias("winner"), (g * 5 + (k + 1) % 5).alias("loser"))
    across = d.filter((k == 0) & (g % 3 != 2)).select(
        F.col("doc_id").alias("winner"), (F.col("doc_id") + 5).alias("loser"))
    known = d.select(F.col("doc_id").alias("loser"))
    return inside.unionByName(across).join(known, "loser", "left_semi").select(
        F.lit("planted").alias("task"), "winner", F.col("loser").cast("long").alias("loser"))


def tag_replies(docs: DataFrame) -> DataFrame:
    """``doc_id, reply``: a first-level tag reply per document with the failure
    kinds a model produces (fenced, unknown tag, wrong case, missing key,
    trailing text, failed call)."""
    d = docs.select("doc_id", uniform("doc_id", "t1").alias("_u1"),
                    uniform("doc_id", "j").alias("_uj"))
    d = d.select("doc_id", "_uj", _pick_first(F.col("_u1"), proper=True).alias("_name"))
    name, u = F.col("_name"), F.col("_uj")
    body = F.concat(F.lit('{"tag": "'), name, F.lit('", "explanation": "rule"}'))
    reply = (F.when(u < 0.10, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
             .when(u < 0.15, F.lit('{"tag": "Cooking", "explanation": "rule"}'))
             .when(u < 0.20, F.concat(F.lit('{"tag": "'), F.lower(name),
                                      F.lit('", "explanation": "rule"}')))
             .when(u < 0.25, F.concat(F.lit('{"tag": "'), name, F.lit('"}')))
             .when(u < 0.28, F.concat(body, F.lit(" trailing")))
             .when(u < 0.30, F.concat(body, F.lit(" or "), body))
             .when(u < 0.32, F.lit("<<FAILED>>"))
             .otherwise(body))
    return d.select("doc_id", reply.alias("reply"))


def summary_replies(docs: DataFrame) -> DataFrame:
    """``doc_id, reply``: summary replies (failed, missing key, not JSON, ok)."""
    d = docs.select("doc_id", "n_chars", "lang", uniform("doc_id", "sm").alias("_u"))
    u = F.col("_u")
    ok = F.concat(F.lit('{"summary": "A text of '), F.col("n_chars").cast("string"),
                  F.lit(" characters in "), F.col("lang"), F.lit('."}'))
    reply = (F.when(u < 0.05, F.lit("<<FAILED>>"))
             .when(u < 0.10, F.lit('{"note": "none"}'))
             .when(u < 0.15, F.lit("Summary: plain text"))
             .otherwise(ok))
    return d.select("doc_id", reply.alias("reply"))


def second_third_replies(docs: DataFrame) -> DataFrame:
    """``doc_id, first_level_tag, reply``: second/third-level replies for the
    first tag of each document (failed, missing key, foreign path, ok; about a
    tenth of the paths are not in the taxonomy, whose names have capitals)."""
    d = docs.select("doc_id", uniform("doc_id", "t1").alias("_u1"),
                    uniform("doc_id", "s2").alias("_u2"), uniform("doc_id", "s3").alias("_u3"),
                    uniform("doc_id", "st").alias("_uv"))
    d = d.select("doc_id", "_uv", _pick_first(F.col("_u1")).alias("_f"),
                 F.floor(F.lit(5) * F.col("_u2")).cast("int").cast("string").alias("_sx"),
                 F.floor(F.lit(4) * F.col("_u3")).cast("int").cast("string").alias("_tx"))
    second = _capital(F.concat("_f", F.lit(" s"), "_sx"))
    third = _capital(F.concat("_f", F.lit(" s"), "_sx", F.lit(" t"), "_tx"))
    u = F.col("_uv")
    full = F.concat(F.lit('{"second_level_tag": "'), second, F.lit('", "third_level_tag": "'),
                    third, F.lit('", "explanation": "rule"}'))
    reply = (F.when(u < 0.05, F.lit("<<FAILED>>"))
             .when(u < 0.10, F.concat(F.lit('{"second_level_tag": "'), second,
                                      F.lit('", "explanation": "rule"}')))
             .when(u < 0.15, F.lit('{"second_level_tag": "cooking s1", "third_level_tag": '
                                   '"cooking s1 t0", "explanation": "rule"}'))
             .otherwise(full))
    return d.select("doc_id", F.col("_f").alias("first_level_tag"), reply.alias("reply"))


def flat_replies(docs: DataFrame) -> DataFrame:
    """``doc_id, reply``: flat three-level tag lists (missing key, two-level
    only, failed, unknown first part, ok with one two-level element dropped)."""
    d = docs.select("doc_id", uniform("doc_id", "t1").alias("_u1"),
                    uniform("doc_id", "t2").alias("_u2"), uniform("doc_id", "t3").alias("_u3"),
                    uniform("doc_id", "ft").alias("_uv"))
    d = d.select("doc_id", "_uv", _pick_first(F.col("_u1"), proper=True).alias("_name"),
                 _pick_first(F.col("_u1")).alias("_f"),
                 F.floor(F.lit(5) * F.col("_u2")).cast("int").cast("string").alias("_sx"),
                 F.floor(F.lit(4) * F.col("_u3")).cast("int").cast("string").alias("_tx"))
    path = F.concat(F.lit(" > "), "_f", F.lit(" s"), "_sx", F.lit(" > "), "_f", F.lit(" s"), "_sx",
                    F.lit(" t"), "_tx")
    good = F.concat(F.lit('{"tag": "'), F.col("_name"), path, F.lit('", "explanation": "rule"}'))
    tab = F.concat(F.lit('{"tag": "\\t'), F.col("_name"), path, F.lit('", "explanation": "rule"}'))
    lower = F.concat(F.lit('{"tag": "'), F.col("_f"), path, F.lit('", "explanation": "rule"}'))
    two = F.concat(F.lit('{"tag": "'), F.col("_name"), F.lit(' > misc", "explanation": "rule"}'))
    two_nokey = F.concat(F.lit('{"tag": "'), F.col("_name"), F.lit(' > misc"}'))
    u = F.col("_uv")
    reply = (F.when(u < 0.10, F.concat(F.lit("["), good, F.lit(", "), two_nokey, F.lit("]")))
             .when(u < 0.20, F.concat(F.lit("["), two, F.lit("]")))
             .when(u < 0.25, F.lit("<<FAILED>>"))
             .when(u < 0.30, F.concat(F.lit("["), lower, F.lit(", "), two, F.lit("]")))
             .when(u < 0.35, F.concat(F.lit("["), tab, F.lit("]")))
             .otherwise(F.concat(F.lit("["), good, F.lit(", "), two, F.lit("]"))))
    return d.select("doc_id", reply.alias("reply"))
