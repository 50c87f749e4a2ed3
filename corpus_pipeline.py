"""A corpus pipeline: language ID, near-dedup, suffix dedup, decontamination, packing.

Every stage reads the documents its predecessor wrote. All but the last return
the columns of ``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_curator.llm import decontam, langid, near_dup, packing, suffix_dedup
from corpus_curator.llm.queries import tokenizer_path
from corpus_curator.llm.tables import numbered, saved, table

#: A document whose predicted language holds less of the posterior is rejected.
MIN_LANGUAGE_SCORE = 0.5

#: Rows of an Arrow batch.
BATCH_ROWS = 1000

#: Documents of this Jaccard similarity (of five-word shingles) are near-duplicates.
NEAR_PERCENT = 80


def steady(spark: SparkSession) -> None:
    """At most ``BATCH_ROWS`` rows cross to Python at once in this session: whole texts
    are large, and workers and JVM hold a batch each on both ways."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(setting)) > BATCH_ROWS:
        spark.conf.set(setting, str(BATCH_ROWS))


def unused(docs: DataFrame) -> str:
    """A prefix of result columns that no column of ``docs`` has."""
    prefix = "stage_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    return prefix


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised. Texts without a letter go, and
    those in which no language holds half of the words' posterior. The field is
    learnt from the documents at hand."""
    steady(spark)
    own = unused(docs)
    found = langid.predict(docs, langid.learn(docs), carry=True, prefix=own)
    keep = ((F.col(f"{own}lang_pred") != "und")
            & (F.col(f"{own}score") >= MIN_LANGUAGE_SCORE))
    return found.filter(keep).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the one of the smallest id, a null
    id after all others. Rows that repeat an id are documents of their own.
    Documents without a shingle stay."""
    steady(spark)
    rows, row = numbered(docs, "near-rows")
    found = near_dup.link(rows, percent=NEAR_PERCENT, row=row)
    gone = saved(found.filter(~F.col("kept")).select(row), "near-gone")
    return rows.join(gone, row, "left_anti").select(*docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that repeat. What is left of a character
    that was cut in two is dropped; ``n_chars`` counts the text that stays."""
    steady(spark)
    carry = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    own = unused(docs)
    found = suffix_dedup.remove_repeats(docs, carry=carry, with_text=True, prefix=own)

    @F.pandas_udf("string")
    def decoded(kept):
        return kept.map(lambda b: b.decode("utf-8", "ignore"))

    out = found.withColumn("text", decoded(f"{own}kept")).withColumn("n_chars", F.length("text").cast(
        docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain no benchmark item, whatever their id."""
    steady(spark)
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), by_row=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences."""
    steady(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language_id", language),
    ("near_dedup", near_duplicates),
    ("suffix_dedup", repeats),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: SQL cannot express the learnt, compressed and packing stages; the pipeline is
#: tested against a brute-force form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
