"""Registered queries: one per operator of the inventory, each reading the given
tables (or data Spark derives from them) at ``sf_dir``.

Doubles are rounded to 6 decimals at the very end so the SQL oracle can be
compared value by value; every computed column has an explicit name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import SCORE_FIELDS
from ..functions.rand import uniform
from ..operators import rank, sampling, scores, shape, tags
from ..operators.retrieve import retrieve_by_uuid
from ..sources import derived as D
from ..session import materialize
from . import flows

SEED = 7
R = 6  # decimals kept in the comparison


def r6(c) -> Column:
    """Round to 6 decimals; adding 0.0 turns -0.0 into 0.0 (same in SQL)."""
    col = F.col(f"`{c}`") if isinstance(c, str) else c
    return F.round(col, R) + F.lit(0.0)


def _round(df: DataFrame, cols) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, r6(c))
    return df


def _corpus(spark, sf) -> DataFrame:
    """Documents with their stable uuid: what the sampled ids join back to."""
    return D.documents(spark, sf).withColumn("uuid", shape.stable_uuid("doc_id"))


def _rating_weights(spark, sf) -> DataFrame:
    return materialize(scores.rating_probability(D.rated(spark, sf), keep=("uuid", "dataset")))


def _tag_prob(spark, sf, normalize=False) -> DataFrame:
    return tags.tag_probability(tags.filter_in_tree(D.tagged(spark, sf)), normalize=normalize)


# ---------------------------------------------------------------- scores
def q_clean_scores(spark, sf):
    df = scores.clean_scores(D.rated(spark, sf))
    return df.select("uuid", "dataset", *[F.col(f"`{f}`") for f in SCORE_FIELDS])


def q_score_stats(spark, sf):
    st = scores.score_stats(scores.clean_scores(D.rated(spark, sf)))
    return _round(st, st.columns)


def q_exp_zscores(spark, sf):
    z = scores.exp_zscores(scores.clean_scores(D.rated(spark, sf)))
    return _round(z, SCORE_FIELDS)


def q_rating_weight(spark, sf):
    return _round(_rating_weights(spark, sf).select("uuid", "weight"), ["weight"])


# ---------------------------------------------------------------- tags
def q_tag_counts_l1(spark, sf):
    return tags.tag_counts(D.tagged(spark, sf), 1)


def q_tag_counts_l2(spark, sf):
    return tags.tag_counts(D.tagged(spark, sf), 2)


def q_tag_counts_l3(spark, sf):
    return tags.tag_counts(D.tagged(spark, sf), 3)


def q_tag_level_table(spark, sf):
    lv = tags.tag_level_table(tags.filter_in_tree(D.tagged(spark, sf)))
    return _round(lv, ["sum_weight_a", "sum_weight_b", "sum_weight_c"])


def q_tag_probability(spark, sf):
    p = _tag_prob(spark, sf).select("uuid", *tags.TAGS, "probability")
    return _round(p, ["probability"])


def q_tag_probability_normalized(spark, sf):
    p = _tag_prob(spark, sf, normalize=True).select("uuid", *tags.TAGS, "probability")
    return _round(p, ["probability"])


def q_filter_in_tree(spark, sf):
    return tags.filter_in_tree(D.tagged(spark, sf)).select("uuid", *tags.TAGS)


def q_mark_in_tree(spark, sf):
    m = tags.mark_in_tree(D.tagged(spark, sf), D.taxonomy(spark, sf))
    return m.select("uuid", F.col("in_tree").alias("path_in_tree"))


def q_boost_weight(spark, sf):
    b = tags.boost_weight(_tag_prob(spark, sf), D.boost_list(), name="weight")
    return _round(b.select("uuid", "weight"), ["weight"])


# ---------------------------------------------------------------- sampling
def q_weighted_sample(spark, sf):
    w = _rating_weights(spark, sf).select("uuid", "weight")
    n = w.filter(F.col("weight") > 0).count() // 2
    return sampling.weighted_sample(w, n, seed=SEED).select("uuid")


def q_weighted_sample_by(spark, sf):
    p = _tag_prob(spark, sf).select("uuid", "dataset", "probability")
    quotas = (p.filter(F.col("probability") > 0).groupBy("dataset")
              .agg(F.floor(F.count(F.lit(1)) / 2).cast("long").alias("n")))
    s = sampling.weighted_sample_by(p, quotas, weight="probability", seed=SEED)
    return s.select("uuid", "dataset")


def _lineitem_keyed(spark, sf):
    li = D.table(spark, sf, "lineitem")
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in
                             ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    return li.select(key.alias("lkey"), F.col("l_extendedprice").alias("weight"))


def q_weighted_sample_lineitem(spark, sf):
    """Half of lineitem, weighted by extended price (the large-n path)."""
    w = _lineitem_keyed(spark, sf)
    return sampling.weighted_sample(w, key="lkey", seed=SEED, fraction=0.5).select("lkey")


def q_weighted_sample_repeats(spark, sf):
    """Exactly half of lineitem with a key that repeats: lines of one order share
    a variate, ties of key and weight go by the line number."""
    li = D.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber",
                                               F.col("l_quantity").alias("weight"))
    n = li.count() // 2
    return sampling.weighted_sample(li, n, key="l_orderkey", seed=SEED,
                                    tie=["l_orderkey", "l_linenumber"]).select(
        "l_orderkey", "l_linenumber")


def q_sample_k(spark, sf):
    d = D.documents(spark, sf).select("doc_id")
    k = d.count() // 2
    return sampling.sample_k(d, k, "doc_id", SEED)


def q_shuffle_rows(spark, sf):
    d = sampling.shuffle_rows(D.documents(spark, sf), "doc_id", SEED, row_key=["doc_id"])
    return d.select("doc_id", "position")


def q_head_k(spark, sf):
    return sampling.head_k(D.documents(spark, sf).select("doc_id", "source"), 100, ["doc_id"])


def q_slice_input(spark, sf):
    d = D.documents(spark, sf).select("doc_id", "n_chars")
    return sampling.slice_input(d, 100, 500, "doc_id")


def q_slice_input_mixed(spark, sf):
    """About half the records have an id of their own, the others go by position."""
    own = F.when(uniform("doc_id", "iid") < 0.5, F.col("doc_id") + 3)
    d = D.documents(spark, sf).select("doc_id", own.alias("instance_id"))
    return sampling.slice_input(d, 100, 500, "instance_id", ["doc_id"], ["doc_id"]).select(
        "doc_id", "instance_id", "position")


def q_assign_batches(spark, sf):
    d = D.documents(spark, sf).select("doc_id")
    return sampling.assign_batches(d, 20, order="input", order_by=["doc_id"], row_key=["doc_id"])


def q_global_rank(spark, sf):
    d = D.documents(spark, sf).select("doc_id", "n_chars")
    return rank.global_rank(d, [F.col("n_chars").desc(), F.col("doc_id")], name="rank")


def q_global_rank_distributed(spark, sf):
    """The same rank over the rows dealt to many partitions first."""
    d = D.documents(spark, sf).select("doc_id", "n_chars").repartition(16, "doc_id")
    return rank.global_rank(d, [F.col("n_chars").desc(), F.col("doc_id")], name="rank")


def q_global_rank_by(spark, sf):
    d = D.documents(spark, sf).select("doc_id", "source", "n_chars")
    return rank.global_rank(d, [F.col("n_chars").desc(), F.col("doc_id")], by=["source"],
                            name="rank")


def q_assign_uuid(spark, sf):
    return _corpus(spark, sf).select("doc_id", "uuid")


def q_retrieve_by_uuid(spark, sf):
    w = _rating_weights(spark, sf).select("uuid", "weight")
    n = w.filter(F.col("weight") > 0).count() // 2
    ids = sampling.weighted_sample(w, n, seed=SEED).select("uuid")
    return retrieve_by_uuid(ids, _corpus(spark, sf)).select("uuid", "doc_id", "source", "text")


def q_rating_sample(spark, sf):
    out = flows.rating_sample(D.rated(spark, sf), _corpus(spark, sf), seed=SEED)
    return out.select("uuid", "doc_id", "source", "lang", "text")


def q_tag_sample(spark, sf):
    out = flows.tag_sample(D.tagged(spark, sf), _corpus(spark, sf),
                               boost_tags=D.boost_list(), seed=SEED)
    return out.select("uuid", "doc_id", "source", "lang", "text")


def q_rating_sample_records(spark, sf):
    """O-Q3 on records that carry their text: the sample is a filter, no join."""
    recs = D.with_text(spark, sf, D.rated(spark, sf))
    out = flows.rating_sample(recs, corpus=None, seed=SEED)
    return out.select("uuid", "doc_id", "dataset", "lang", "text",
                      r6("weight").alias("weight"))


def q_tag_sample_records(spark, sf):
    """O-Q4 on records that carry their text: the sample is a filter, no join."""
    recs = D.with_text(spark, sf, D.tagged(spark, sf))
    out = flows.tag_sample(recs, corpus=None, boost_tags=D.boost_list(), seed=SEED)
    return out.select("uuid", "doc_id", "dataset", "lang", "text",
                      r6("probability").alias("probability"))


def q_union_datasets(spark, sf):
    docs = D.documents(spark, sf).select(F.col("doc_id").alias("id"), "text",
                                         F.col("source").alias("dataset"))
    bench = D.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    return shape.union_datasets([(docs, None), (bench, "benchmark")])


def q_total_quota(spark, sf):
    quotas = D.documents(spark, sf).groupBy(F.col("source").alias("dataset")).agg(
        F.floor(F.count(F.lit(1)) / 2).cast("long").alias("n"))
    return sampling.total_quota(quotas)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: fn for name, fn in list(globals().items()) if name.startswith("q_") and callable(fn)}


# ---------------------------------------------------------------- pairs
from ..constants import PAIR_SEED  # noqa: E402
from ..functions import replies as RP  # noqa: E402
from ..operators import bradley_terry as BT  # noqa: E402
from ..operators import pairs as P  # noqa: E402


def q_random_pairs(spark, sf):
    ids = D.documents(spark, sf).select(F.col("doc_id").alias("id"))
    n = ids.count()
    return P.random_pairs(ids, D.PAIRS_PER_DOC * n, PAIR_SEED)


def q_balanced_pairs(spark, sf):
    return D.pairs(spark, sf).select("pair_id", "id_1", "id_2", "added")


def q_pair_degrees(spark, sf):
    return P.pair_degrees(D.pairs(spark, sf))


def q_pair_budget(spark, sf):
    d = D.documents(spark, sf)
    return P.pair_budget(d, 2 * d.count(), 6)


def q_pair_report(spark, sf):
    return P.pair_report(D.pairs(spark, sf))


def q_pair_texts(spark, sf):
    t = P.pair_texts(D.pairs(spark, sf), D.documents(spark, sf))
    return t.select("pair_id", "id_1", "id_2", F.md5("text_1").alias("md5_1"),
                    F.md5("text_2").alias("md5_2"))


def q_check_pairs(spark, sf):
    return P.check_pairs(D.pairs(spark, sf), D.documents(spark, sf))


def q_remaining_anti(spark, sf):
    return P.remaining(D.pairs(spark, sf), D.judgements(spark, sf), "anti").select(
        "pair_id", "id_1", "id_2")


def q_remaining_watermark(spark, sf):
    pairs = D.pairs(spark, sf)
    first_round = pairs.filter(~F.col("added")).select("pair_id")
    done = D.judgements(spark, sf).join(first_round, "pair_id", "left_semi")
    return P.remaining(pairs, done, "watermark").select("pair_id", "id_1", "id_2")


# ---------------------------------------------------------------- replies
def q_parse_choice(spark, sf):
    return RP.parse_choice(D.pair_replies(spark, sf)).select("pair_id", "status", "win", "why")


def q_parse_reply(spark, sf):
    r = RP.parse_reply(D.tag_replies(D.documents(spark, sf)), "tag string, explanation string",
                       required=("tag", "explanation"))
    return r.select("doc_id", "status", F.col("parsed.tag").alias("tag"))


def q_validate_first_level(spark, sf):
    v = RP.validate_first_level(D.tag_replies(D.documents(spark, sf)))
    return v.select("doc_id", "status", "first_level_tag", "first_level_explanation")


def q_validate_first_level_literal(spark, sf):
    """The same replies read as Python literals (ast.literal_eval in a pandas UDF)."""
    v = RP.validate_first_level(D.tag_replies(D.documents(spark, sf)), literal=True)
    return v.select("doc_id", "status", "first_level_tag", "first_level_explanation")


def q_validate_summary(spark, sf):
    v = RP.validate_summary(D.summary_replies(D.documents(spark, sf)))
    return v.select("doc_id", "status", "summary")


def q_validate_second_third(spark, sf):
    v = RP.validate_second_third(D.second_third_replies(D.documents(spark, sf)), D.taxonomy(spark, sf))
    return v.select("doc_id", "status", "first_level_tag", "second_level_tag", "third_level_tag")


def q_validate_flat_tags(spark, sf):
    v = RP.validate_flat_tags(D.flat_replies(D.documents(spark, sf)))
    return v.select("doc_id", "status", F.size("tags").cast("long").alias("n_tags"),
                    F.array_join(F.transform("tags", lambda t: t["tag"]), "|").alias("tags_joined"))


def q_reject_reasons(spark, sf):
    v = RP.validate_first_level(D.tag_replies(D.documents(spark, sf)))
    return RP.reject_reasons(v)


# ---------------------------------------------------------------- Bradley-Terry
def _matches(spark, sf):
    return BT.to_matches(D.judgements(spark, sf))


def _net_scores(spark, sf):
    rec = BT.item_record(_matches(spark, sf))
    return rec.select("task", "id", (F.col("wins") - F.col("losses")).cast("double").alias("theta"))


def q_matches(spark, sf):
    return _matches(spark, sf)


def q_match_counts(spark, sf):
    return BT.match_counts(_matches(spark, sf))


def q_all_items(spark, sf):
    return BT.all_items(_matches(spark, sf))


def q_item_record(spark, sf):
    return BT.item_record(_matches(spark, sf))


def q_index_items(spark, sf):
    return BT.index_items(_matches(spark, sf))


def q_bt_gradient(spark, sf):
    return _round(BT.bt_gradient(_matches(spark, sf), 0.05, 5), ["theta"])


def q_bt_gradient_grouped(spark, sf):
    """The same steps over all tasks, handed over every second step."""
    return _round(BT.bt_gradient(_matches(spark, sf), 0.05, 5, checkpoint_every=2), ["theta"])


def q_bt_loss(spark, sf):
    m = _matches(spark, sf)
    return _round(BT.bt_loss(m, BT.bt_gradient(m, 0.05, 5)), ["loss"])


def _optimal(matches, scores, prior=0.0):
    """Scores as what SQL can check: the component, whether the optimum is finite, and
    how far expected wins are from wins (0 at the optimum)."""
    off = BT.bt_residuals(matches, scores, prior)
    return scores.join(off, ["task", "id"], "left").select(
        "task", "id", "component", "finite",
        (F.round("residual", 3) + F.lit(0.0)).alias("residual"))


def q_bt_mle(spark, sf):
    """The maximum-likelihood scores of both tasks, to tolerance."""
    m = _matches(spark, sf)
    return _optimal(m, BT.bt_scores(m))


def q_bt_components(spark, sf):
    """Planted groups of five documents: each beats the next in a cycle, but for every
    seventh group, whose cycle is open; the first of two groups in three also beats
    the first of the next group. Only cycles have finite optima, each on its own."""
    m = D.planted_matches(spark, sf)
    return _optimal(m, BT.bt_scores(m))


def q_uniform_scores(spark, sf):
    u = BT.uniform_scores(_net_scores(spark, sf))
    return _round(u.select("task", "id", "score"), ["score"])


def q_order_scores(spark, sf):
    return BT.order_scores(_net_scores(spark, sf)).select("task", "id", "theta", "rank")


def q_finalize_scores(spark, sf):
    net = _net_scores(spark, sf)
    bt = BT.finalize_scores(net, "bradley_terry").withColumnRenamed("score", "score_bt")
    un = BT.finalize_scores(net, "uniform").withColumnRenamed("score", "score_uniform")
    return _round(bt.join(un, ["task", "id"]), ["score_bt", "score_uniform"])


QUERIES = {name: fn for name, fn in list(globals().items())
           if name.startswith("q_") and callable(fn)}
