"""Registered queries for prompts, annotators and the annotation flows.

The annotator is the offline rule set of ``functions.annotators`` run through
``mapInPandas``; the oracle computes the same rule in SQL from the same
rendered prompt."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import PAIR_SEED
from ..functions import annotators as A
from ..functions import prompts as PR
from ..functions.rand import uniform
from ..operators import annotate as AN
from ..operators import bradley_terry as BT
from ..operators import pairs as P
from ..session import materialize
from ..sources import derived as D
from . import flows
from .queries import r6

TASK = "educational_value"
TASKS = [TASK, "expertise"]


def _docs(spark, sf):
    return D.documents(spark, sf)


def _summaries(spark, sf):
    return materialize(AN.summarize(_docs(spark, sf), A.summary_rule)
                       .filter(F.col("status") == "ok"))


def _first_levels(spark, sf):
    return materialize(AN.tag_first_level(_summaries(spark, sf), A.first_level_rule)
                       .filter(F.col("status") == "ok"))


def q_render_pair_prompt(spark, sf):
    t = P.pair_texts(D.pairs(spark, sf), _docs(spark, sf))
    p = PR.render_pair_prompt(t, PR.default_templates()[TASK])
    return p.select("pair_id", F.md5("prompt").alias("prompt_md5"),
                    F.length("prompt").cast("long").alias("prompt_len"))


def q_render_prompt(spark, sf):
    p = PR.render_prompt(_docs(spark, sf), PR.default_templates()["summary"])
    return p.select("doc_id", F.md5("prompt").alias("prompt_md5"))


def q_render_subtree_prompt(spark, sf):
    recs = D.tagged(spark, sf).select("doc_id", "first_level_tag").join(
        _docs(spark, sf).select("doc_id", "text"), "doc_id")
    p = PR.render_subtree_prompt(recs, D.taxonomy(spark, sf),
                                 PR.default_templates()["tag_second_third_level"])
    return p.select("doc_id", "status", F.md5("prompt").alias("prompt_md5"))


def _edit_docs(spark, sf):
    """Documents of which about a tenth count as Chinese."""
    lang = F.when(uniform("doc_id", "zh") < 0.1, "zh").otherwise(F.col("lang"))
    return _docs(spark, sf).withColumn("lang", lang)


def q_render_edit_prompt(spark, sf):
    p = PR.render_edit_prompt(_edit_docs(spark, sf), PR.default_templates())
    return p.select("doc_id", F.md5("prompt").alias("prompt_md5"))


def q_classify_prompt_size(spark, sf):
    t = P.pair_texts(D.pairs(spark, sf), _docs(spark, sf))
    p = PR.render_pair_prompt(t, PR.default_templates()[TASK])
    return PR.classify_prompt_size(p).select("pair_id", "n_tokens", "size_class")


def q_annotate_rate(spark, sf):
    j = AN.rate_pairs(_docs(spark, sf), D.pairs(spark, sf), TASK, A.rate_rule)
    return j.select("task", "pair_id", "status", "win", "why")


def q_annotate_summary(spark, sf):
    s = AN.summarize(_docs(spark, sf), A.summary_rule)
    return s.select("instance_id", "status", "summary")


def q_annotate_first_level(spark, sf):
    f = AN.tag_first_level(_summaries(spark, sf), A.first_level_rule)
    return f.select("instance_id", "status", "first_level_tag")


def q_annotate_second_third(spark, sf):
    t = AN.tag_second_third(_first_levels(spark, sf), D.taxonomy(spark, sf), A.second_third_rule)
    return t.select("instance_id", "status", "first_level_tag", "second_level_tag",
                    "third_level_tag")


def q_annotate_flat(spark, sf):
    t = AN.tag_flat(_docs(spark, sf), A.flat_rule)
    return t.select("instance_id", "status", F.size("tags").cast("long").alias("n_tags"),
                    F.array_join(F.transform("tags", lambda x: x["tag"]), "|").alias("tags_joined"))


def q_annotate_edit(spark, sf):
    e = AN.edit_documents(_edit_docs(spark, sf), A.edit_rule)
    return e.select("doc_id", "edited_text")


def q_rate_scores(spark, sf):
    """The rating flow over two criteria: pairs, judgements, scores to tolerance, with
    the wins they come from and how far expected wins are from them."""
    docs = _docs(spark, sf)
    n = docs.count()
    m = flows.judge(docs, TASKS, A.rate_rule, n_pairs=3 * n, compare=6, seed=PAIR_SEED)
    scores = BT.bt_scores(m, prior=0.5, centre=False)
    off = BT.bt_residuals(m, scores, prior=0.5)
    return BT.item_record(m).join(off, ["task", "id"]).select(
        "task", "id", "wins", "losses", (F.round("residual", 3) + F.lit(0.0)).alias("residual"))


def q_tag_documents(spark, sf):
    t = flows.tag(_docs(spark, sf), D.taxonomy(spark, sf), A.summary_rule, A.first_level_rule,
                      A.second_third_rule)
    return t.select("instance_id", "first_level_tag", "second_level_tag", "third_level_tag",
                    "in_tree")


QUERIES = {name: fn for name, fn in list(globals().items())
           if name.startswith("q_") and callable(fn)}
