"""The queries of the numbered operators, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle
from .tables import remainder, table


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def _held_out(modulus: int, rest: int):
    return F.coalesce(remainder("doc_id", modulus) == rest, F.lit(False)).alias("held_out")


def _predicted():
    return (F.col("score") >= 0.5).cast("int").alias("predicted")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality
    scored = quality.score_quality(table(spark, sf_dir, "documents"),
                                   table(spark, sf_dir, "labels"))
    return scored.select("doc_id", _held_out(3, 1), "score", _predicted())


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid
    found = langid.identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", _held_out(3, 1), "lang_pred", "score", "switches", "n_words")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontam
    return decontam.find_items(table(spark, sf_dir, "documents"),
                               table(spark, sf_dir, "benchmark"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import license_scan
    return license_scan.digest(license_scan.find_notices(table(spark, sf_dir, "documents")))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lm_score
    scored = lm_score.score(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffix_dedup
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity
    scored = toxicity.score_toxicity(table(spark, sf_dir, "documents"),
                                     table(spark, sf_dir, "labels"))
    return scored.select("doc_id", _held_out(5, 0), "score", _predicted())


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ann
    rows = table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.filter(F.col("vec_id") % 50 == 0), k=5)


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import near_dup
    return near_dup.link(table(spark, sf_dir, "documents"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import repair
    return repair.repaired(table(spark, sf_dir, "conversations"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import align
    sides = align.public_sides(public_tokenizers.path("byte_bpe_50k.json"),
                               public_tokenizers.path("piece_bpe_32k.model"))
    return align.align(table(spark, sf_dir, "documents"), sides)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc
    return warc.archived(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_language_id": op2_language_id,
    "op3_decontamination": op3_decontamination,
    "op4_license_scan": op4_license_scan,
    "op5_lm_score": op5_lm_score,
    "op6_packing": op6_packing,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_nearest": op9_nearest,
    "op10_near_dup": op10_near_dup,
    "op11_repair": op11_repair,
    "op12_alignment": op12_alignment,
    "op13_warc": op13_warc,
    "pipeline": pipeline,
}

#: The others learn, pack, or work on bytes, which SQL cannot express; they are
#: tested against brute-force forms and held-out labels in tests/llm.
ORACLE_SQL: dict[str, str] = dict(oracle.SQL)
