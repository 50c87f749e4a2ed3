"""End-to-end flows as single DataFrame plans (no exit from the cluster)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import RATING_WEIGHTS, SCORE_FIELDS, TAG_EXPONENTS
from ..operators import sampling, scores, tags
from ..operators.retrieve import retrieve_by_uuid
from ..session import materialize


def rating_sample(rated: DataFrame, corpus: DataFrame | None = None, n: int | None = None,
                  seed: int | str = 0, fields: Sequence[str] = SCORE_FIELDS,
                  weights: Mapping[str, float] = RATING_WEIGHTS,
                  fraction: float | None = None, key: str = "uuid",
                  cap: bool = False) -> DataFrame:
    """Rating-based sampling: clean scores -> exp z-scores -> combined weight ->
    n records weighted without replacement (``fraction`` instead of ``n``:
    that share of the rows with a positive weight; default one half). More
    rows than there are weighted records is an error unless ``cap``.

    ``corpus=None``: the rated records are the corpus; the sample is a filter
    over them (no join). With a separate ``corpus`` the sampled ids are joined
    back to it (left join from the ids)."""
    if n is None and fraction is None:
        fraction = 0.5
    rated = scores.canonical_fields(rated, fields)
    recs = rated if corpus is None else rated.select(key, *[F.col(f"`{f}`") for f in fields])
    counts: dict = {}
    weighted = scores.with_rating_weight(recs, fields, weights, counts=counts,
                                         log_name="_log_weight")
    # the statistics pass counted the candidates; the draw goes by log weights (an
    # outlier's exponential can overflow)
    if n is None:
        n = int(counts["rows"] * fraction)
    if n > counts["rows"]:
        if not cap:
            raise ValueError(f"cannot draw {n} rows: only {counts['rows']} are weighted")
        n = counts["rows"]
    # the decision reads only (key, weight); the records are filtered once
    rule = sampling.draw_rule(weighted, key=key, seed=seed, n=n, log_weight="_log_weight")
    if corpus is None:
        return rule(weighted).drop("_log_weight")
    ids = rule(weighted.select(key, "_log_weight")).select(key)
    return retrieve_by_uuid(ids, corpus, key)


def tag_weights(tagged: DataFrame, boost_tags: Sequence[str] = (),
                exponents: tuple[float, float, float] = TAG_EXPONENTS,
                normalize: bool = False) -> DataFrame:
    """in_tree filter -> tag probability -> boost."""
    t = tags.filter_in_tree(tagged)
    p = tags.tag_probability(t, *exponents, normalize=normalize)
    if boost_tags:
        p = tags.boost_weight(p, boost_tags)
    return p


def tag_sample(tagged: DataFrame, corpus: DataFrame | None = None,
               quotas: DataFrame | Mapping[str, int] | None = None,
               boost_tags: Sequence[str] = (), seed: int | str = 0, by: str = "dataset",
               fraction: float = 0.5, key: str = "uuid", cap: bool = False) -> DataFrame:
    """Tag-based sampling with per-dataset quotas. Without ``quotas`` each
    dataset gets ``fraction`` of its rows with a positive weight; given
    quotas larger than a dataset's weighted rows are an error unless ``cap``.
    ``corpus=None``: the tagged records are the corpus (a filter, no join);
    otherwise the sampled ids are joined back to ``corpus``."""
    recs = tagged if corpus is None else tagged.select(key, by, *tags.TAGS, "in_tree")
    p = tag_weights(recs, boost_tags)
    check = quotas is not None  # derived quotas fit by construction
    if quotas is None:
        quotas = (p.filter(F.col("probability") > 0).groupBy(by)
                  .agg(F.floor(F.count(F.lit(1)) * F.lit(fraction)).cast("long").alias("n")))
    rule = sampling.draw_rule(p, "probability", key, seed, quotas=quotas, by=by, cap=cap,
                              validate=check)
    if corpus is None:
        return rule(p)
    ids = rule(p.select(key, by, "probability")).select(key)
    return retrieve_by_uuid(ids, corpus, key)


def judge(docs: DataFrame, task: str | Sequence[str], fn, n_pairs: int | None = None,
          compare: int = 6, seed: int | str = 0, templates=None, id_col: str = "doc_id",
          text_col: str = "text", **kw) -> DataFrame:
    """Balanced pairs -> prompts -> annotator -> matches ``(task, pair_id, winner,
    loser)``. ``task`` may be a list: all tasks are judged over the same pairs. Pairs
    and matches are written once, as the toolkit hands them over by file."""
    from ..operators import bradley_terry as BT
    from ..operators.annotate import rate_pairs
    from ..operators.pairs import balanced_pairs
    ids = docs.select(F.col(id_col).alias("id"))
    if n_pairs is None:
        n_pairs = 5 * ids.count()
    pairs = materialize(balanced_pairs(ids, n_pairs, compare, seed))
    judged = rate_pairs(docs, pairs, task, fn, templates, id_col, text_col, **kw)
    return materialize(BT.to_matches(judged.filter(F.col("status") == "ok")))


def rate(docs: DataFrame, task: str | Sequence[str], fn, n_pairs: int | None = None, compare: int = 6,
         seed: int | str = 0, method: str = "mle", iterations: int = 600,
         lr: float = 0.05, prior: float = 0.5, score_type: str = "uniform",
         templates=None, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """Pairwise rating pipeline: ``judge`` -> Bradley-Terry -> scores ``(task, id,
    score)``. ``mle``: the optimum (``prior`` keeps it finite, ``iterations`` bounds
    the passes); ``gradient``: that many steps of the original rule. All tasks are
    fitted at once."""
    from ..operators import bradley_terry as BT
    matches = judge(docs, task, fn, n_pairs, compare, seed, templates, id_col, text_col, **kw)
    if method == "gradient":
        theta = BT.bt_gradient(matches, lr, iterations)
    elif method == "mle":
        theta = BT.bt_scores(matches, prior=prior, max_iter=iterations)
    else:
        raise ValueError("method must be 'gradient' or 'mle'")
    return BT.finalize_scores(theta, score_type)


def tag(docs: DataFrame, taxonomy: DataFrame, summary_fn, first_fn, second_fn,
        templates=None, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """Tagging pipeline: summary -> first-level tag -> second/third-level tag
    -> in_tree flag. Each accepted stage is written once before the next."""
    from ..operators.annotate import summarize, tag_first_level, tag_second_third
    s = materialize(summarize(docs, summary_fn, templates, id_col, text_col, **kw)
                    .filter(F.col("status") == "ok"))
    f = materialize(tag_first_level(s, first_fn, templates, **kw).filter(F.col("status") == "ok"))
    t = tag_second_third(f, taxonomy, second_fn, templates, **kw).filter(F.col("status") == "ok")
    return tags.mark_in_tree(t.drop("status"), taxonomy)
