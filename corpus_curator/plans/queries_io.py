"""Registered queries for sources, sinks, record shaping and streaming.

File formats are exercised by writing data derived from the given tables to a
fresh folder under the shared checkpoint root and reading it back; the oracle
computes the expected rows from the tables directly."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import MD_SAMPLE_MARKER
from ..functions import annotators as A
from ..functions import prompts as PR
from ..functions import replies as RP
from ..functions.rand import uniform
from ..operators import bradley_terry as BT
from ..operators import sampling, shape
from ..operators.retrieve import retrieve_by_uuid
from ..session import scratch_path
from ..sources import derived as D
from ..sources import readers as RD
from ..sources import writers as W
from ..streaming.annotate_stream import annotate_stream, read_annotated
from ..streaming.resume import remaining_stream
from .queries import SEED, _corpus, _rating_weights, r6

TEXT_SCHEMA = "doc_id long, text string, lang string"


def _raw_records(spark, sf) -> DataFrame:
    """Raw JSONL shapes derived from documents: own ``instance_id`` for about
    half, text under ``original_content`` (JSON string with ``clean_text`` or
    ``raw_content``), ``content`` or ``summary`` by language."""
    d = D.documents(spark, sf).select("doc_id", "text", "lang", uniform("doc_id", "iid").alias("_u"))
    oc = (F.when(F.col("lang") == "en", F.to_json(F.struct(F.col("text").alias("clean_text"))))
          .when(F.col("lang") == "de", F.to_json(F.struct(F.col("text").alias("raw_content")))))
    return d.select(F.col("doc_id").alias("key"),
                    F.when(F.col("_u") < 0.5, F.col("doc_id")).alias("instance_id"),
                    oc.alias("original_content"),
                    F.when(F.col("lang") == "fr", F.col("text")).alias("content"),
                    F.when(F.col("lang") == "es", F.col("text")).alias("summary"))


def _titled(spark, sf) -> DataFrame:
    """Records with two optional content keys (``title`` may be null or empty,
    ``before`` may be null)."""
    d = D.documents(spark, sf).select("doc_id", "source", "text",
                                      uniform("doc_id", "title").alias("_u1"),
                                      uniform("doc_id", "before").alias("_u2"))
    return d.select("doc_id",
                    F.when(F.col("_u1") < 0.3, F.lit(None).cast("string"))
                    .when(F.col("_u1") < 0.4, F.lit("")).otherwise(F.col("source")).alias("title"),
                    F.when(F.col("_u2") < 0.1, F.lit(None).cast("string"))
                    .otherwise(F.col("text")).alias("before"))


def q_roundtrip_records(spark, sf):
    """Records by dataset, among them lines that break off; each keeps its status."""
    path = scratch_path(spark, "records")
    docs = D.documents(spark, sf).select("doc_id", "text", "lang", F.col("source").alias("dataset"))
    W.write_records(docs, path, partition_by="dataset")
    docs.filter(uniform("doc_id", "broken") < 0.03).select("dataset", F.format_string(
        '{"doc_id": %d, "te', "doc_id").alias("value")).write.mode("append").partitionBy(
        "dataset").text(path)
    back = RD.read_records(spark, path, TEXT_SCHEMA)
    return back.select("doc_id", "dataset", F.md5("text").alias("text_md5"), "status",
                       F.col("_corrupt_record").alias("broken"))


def q_dataset_from_path(spark, sf):
    """Records stored one directory per dataset (plain names); the dataset
    comes from the path of each file."""
    base = scratch_path(spark, "by-dir")
    docs = D.documents(spark, sf).select("doc_id", "text", "lang", "source")
    # one write; Spark names the folders source=<name>, renamed by the reader rule
    W.write_records(docs, base, partition_by="source")
    back = RD.read_records(spark, f"{base}/*/*.json", "doc_id long, text string, lang string",
                           dataset_from_path=True)
    return back.select("doc_id", F.regexp_replace("dataset", "^source=", "").alias("dataset"))


def q_assign_uuid_random(spark, sf):
    """Random uuids: written once (they change on every computation), then
    checked for format and uniqueness."""
    path = scratch_path(spark, "random-uuid")
    shape.assign_uuid(D.documents(spark, sf).select("doc_id"), mode="random").write.json(path)
    back = spark.read.schema("doc_id long, uuid string").json(path)
    pattern = "^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
    return back.agg(F.count(F.lit(1)).alias("n_rows"),
                    F.count_distinct("uuid").alias("n_distinct"),
                    F.count_if(F.col("uuid").rlike(pattern)).alias("n_v4"))


def q_normalize_records(spark, sf):
    n = shape.normalize_records(_raw_records(spark, sf))
    return n.select("key", "instance_id", F.md5("text").alias("text_md5"))


def q_read_raw(spark, sf):
    path = scratch_path(spark, "raw") + ".jsonl"
    W.write_records(_raw_records(spark, sf), path)
    back = RD.read_raw_jsonl(spark, path, T.StructType([T.StructField("key", T.LongType())]))
    return back.select("key", "instance_id", F.md5("text").alias("text_md5"))


def q_read_raw_txt(spark, sf):
    path = scratch_path(spark, "raw") + ".txt"
    d = D.documents(spark, sf)
    line = F.to_json(F.struct(F.col("doc_id").alias("instance_id"),
                              F.to_json(F.struct(F.col("text").alias("raw_content")))
                              .alias("original_content")))
    line = F.when(uniform("doc_id", "broken") < 0.03, F.concat(F.lit("no record "), "doc_id")
                  ).otherwise(line)
    d.select(line.alias("value")).write.mode("overwrite").text(path)
    back = RD.read_raw(spark, path)
    return back.select("instance_id", F.md5("text").alias("text_md5"),
                       F.col("_corrupt_record").alias("broken"))


def q_read_md(spark, sf):
    path = scratch_path(spark, "samples") + ".md"
    d = D.documents(spark, sf)
    block = F.concat(F.lit(MD_SAMPLE_MARKER + " "), F.col("doc_id").cast("string"), F.lit("\n"),
                     F.col("text"))
    d.select(block.alias("value")).write.mode("overwrite").text(path)
    back = RD.read_raw(spark, path)
    return back.select(F.col("label").cast("long").alias("doc_id"), F.md5("text").alias("text_md5"))


def q_retrieve_bucketed(spark, sf):
    """A draw joined back to a corpus bucketed by id, which is not shuffled."""
    path = scratch_path(spark, "bucketed")
    name = os.path.basename(path).replace("-", "_")
    W.write_bucketed(_corpus(spark, sf), name, "uuid", buckets=16, path=path)
    w = _rating_weights(spark, sf)
    ids = sampling.weighted_sample(w, w.count() // 2, seed=SEED).select("uuid")
    return retrieve_by_uuid(ids, spark.table(name)).select(
        "uuid", "doc_id", F.md5("text").alias("text_md5"))


def q_assign_instance_id(spark, sf):
    path = scratch_path(spark, "raw") + ".jsonl"
    W.write_records(_raw_records(spark, sf), path)
    back = RD.read_raw_jsonl(spark, path, T.StructType([T.StructField("key", T.LongType())]))
    return shape.assign_instance_id(back, ["key"], start=1_000_000, row_key=["key"]).select(
        "key", "instance_id")


def q_concat_keys(spark, sf):
    c = shape.concat_keys(_titled(spark, sf), ["title", "missing_key", "before"], out="content")
    return c.select("doc_id", F.md5("content").alias("content_md5"),
                    F.length("content").cast("long").alias("content_len"))


def q_empty_content(spark, sf):
    c = shape.concat_keys(_titled(spark, sf), ["title", "missing_key", "before"], out="content")
    return shape.empty_content_report(c, "content")


def q_truncate_text(spark, sf):
    t = shape.truncate_text(D.documents(spark, sf), 2500, out="cut")
    return t.select("doc_id", F.length("cut").cast("long").alias("cut_len"), F.md5("cut").alias("cut_md5"))


def q_read_pairs(spark, sf):
    pairs = D.pairs(spark, sf)
    path = scratch_path(spark, "pairs")
    n = D.documents(spark, sf).count()
    W.write_pairs(pairs, path, n=n, compare=6)
    back = RD.read_pairs(spark, path)
    meta = RD.read_pairs_meta(spark, path).first()  # one line
    return back.select("pair_id", "id_1", "id_2", "added",
                       *[F.lit(meta[c]).cast("long").alias(c) for c in ("n", "n_pairs", "compare")])


def q_read_judgements(spark, sf):
    path = scratch_path(spark, "judgements")
    judged = D.judgements(spark, sf)
    broken = uniform("pair_id", "broken") < 0.03
    W.append_records(judged.filter(~broken), path)
    cut = F.to_json(F.struct(*judged.columns))  # lines that end too early
    judged.filter(broken).select(F.substring(cut, 1, 30).alias("value")).write.mode(
        "append").text(path)
    back = RD.read_judgements(spark, path)
    return back.select("task", "pair_id", "pair_ids", "win", "why", "status")


def q_read_taxonomy(spark, sf):
    path = scratch_path(spark, "taxonomy")
    W.write_taxonomy(D.taxonomy(spark, sf), path)
    return RD.read_taxonomy(spark, path)


def q_write_ids(spark, sf):
    w = _rating_weights(spark, sf).select("uuid", "weight")
    n = w.filter(F.col("weight") > 0).count() // 2
    ids = sampling.weighted_sample(w, n, seed=SEED)
    path = scratch_path(spark, "ids")
    W.write_ids(ids, path)
    return spark.read.schema("uuid string").json(path)


def q_write_scores(spark, sf):
    rec = BT.item_record(BT.to_matches(D.judgements(spark, sf)))
    net = rec.select("task", "id", (F.col("wins") - F.col("losses")).cast("double").alias("theta"))
    scores = BT.finalize_scores(net, "uniform")
    path = scratch_path(spark, "scores")
    W.write_scores(scores, path)
    back = RD.read_scores(spark, path)
    return back.select("task", "id", r6("score").alias("score"))


def q_annotate_stream(spark, sf):
    """Summary annotation as a catch-up streaming job over prompt files; a
    second run over the same folder adds nothing."""
    base = scratch_path(spark, "stream")
    in_dir, out_dir, ckpt = f"{base}/in", f"{base}/out", f"{base}/checkpoint"
    docs = D.documents(spark, sf)
    prompts = PR.render_prompt(docs.select(F.col("doc_id").alias("instance_id"), "text"),
                               PR.default_templates()["summary"]).drop("text")
    prompts.write.mode("overwrite").json(in_dir)
    schema = "instance_id long, prompt string"
    for _ in range(2):
        annotate_stream(spark, in_dir, out_dir, ckpt, A.summary_rule, schema)
    out = read_annotated(spark, out_dir, schema + ", reply string")
    v = RP.validate_summary(out)
    return v.select("instance_id", "status", "summary")


def q_remaining_stream(spark, sf):
    """Resume as a stream: the finished pairs pass first, then a file that replays all
    pairs arrives; a third run has nothing new. What the second run let through."""
    base = scratch_path(spark, "resume")
    in_dir, out_dir, ckpt = f"{base}/in", f"{base}/out", f"{base}/checkpoint"
    pairs = D.pairs(spark, sf).select("pair_id", "id_1", "id_2")
    done = pairs.join(D.judgements(spark, sf), "pair_id", "left_semi")
    schema = "pair_id long, id_1 long, id_2 long, round long"
    for i, rows in enumerate((done, pairs, None)):
        if rows is not None:
            rows.withColumn("round", F.lit(i)).write.mode("append").json(in_dir)
        remaining_stream(spark, in_dir, out_dir, ckpt, schema, "pair_id")
    return read_annotated(spark, out_dir, schema).filter("round = 1").drop("round")


QUERIES = {name: fn for name, fn in list(globals().items())
           if name.startswith("q_") and callable(fn)}
