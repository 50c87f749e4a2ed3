"""Pairwise judgements -> Bradley-Terry scores.

P(i beats j) = sigmoid(theta_i - theta_j). Matches are compressed to
``(task, winner, loser, n)`` first, so every later pass touches one row per
distinct ordered pair, not per judgement.

bt_gradient  full-batch gradient ascent from theta = 0 (the toolkit's fitting
             rule, step for step): each step joins theta to both ends of every
             match, sums +n(1-p) / -n(1-p) per item, and adds lr times that.
bt_scores    the optimum those steps approach, by Newton steps with distributed
             conjugate gradients, so that tens of passes reach it. It stops when
             expected wins equal wins. What has no finite optimum is named
             (strongly connected components).

Both iterate over distributed tables of items and compressed pairs, all tasks
at once, and hand the item table over by file every step or two, so that the plan
does not grow. ``bt_scores`` joins by one number per (task, item) and lays the pairs
out by their item once for each Newton step, so that a step of the conjugate
gradients moves sums only. Nothing but the largest residual and counts reaches the
driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import BT_LEARNING_RATE, UNIFORM_BOTTOM, UNIFORM_TOP
from ..session import materialize
from .connectivity import strong_components
from .rank import dense_index, global_rank


def to_matches(judgements: DataFrame) -> DataFrame:
    """``win == '1'`` -> the first id won, anything else -> the second."""
    first, second = F.element_at("pair_ids", 1), F.element_at("pair_ids", 2)
    one = F.col("win") == "1"
    task = F.col("task") if "task" in judgements.columns else F.lit("default")
    return judgements.select(task.alias("task"), "pair_id",
                             F.when(one, first).otherwise(second).alias("winner"),
                             F.when(one, second).otherwise(first).alias("loser"))


def match_counts(matches: DataFrame) -> DataFrame:
    """``(task, winner, loser, n)``."""
    return matches.groupBy("task", "winner", "loser").agg(F.count(F.lit(1)).alias("n"))


def all_items(matches: DataFrame) -> DataFrame:
    """Distinct ``(task, id)`` over winners and losers."""
    return (matches.select("task", F.col("winner").alias("id"))
            .union(matches.select("task", F.col("loser").alias("id"))).distinct())


def item_record(matches: DataFrame) -> DataFrame:
    """``(task, id, wins, losses)`` per item."""
    side = matches.select("task", F.explode(F.array(
        F.struct(F.col("winner").alias("id"), F.lit(1).alias("w"), F.lit(0).alias("l")),
        F.struct(F.col("loser").alias("id"), F.lit(0).alias("w"), F.lit(1).alias("l")))).alias("s"))
    return side.groupBy("task", F.col("s.id").alias("id")).agg(
        F.sum("s.w").cast("long").alias("wins"), F.sum("s.l").cast("long").alias("losses"))


def index_items(matches: DataFrame) -> DataFrame:
    """``(task, id, idx)``: dense 0..k-1 index over all (task, item)."""
    return dense_index(all_items(matches), ["task", "id"], name="idx")


def _gradient(counts: DataFrame, theta: DataFrame) -> DataFrame:
    tw = theta.select("task", F.col("id").alias("winner"), F.col("theta").alias("_tw"))
    tl = theta.select("task", F.col("id").alias("loser"), F.col("theta").alias("_tl"))
    j = counts.join(tw, ["task", "winner"]).join(tl, ["task", "loser"])
    # n * (1 - p) with p = sigmoid(tw - tl)
    q = F.col("n") / (F.lit(1.0) + F.exp(F.col("_tw") - F.col("_tl")))
    parts = j.select("task", F.explode(F.array(
        F.struct(F.col("winner").alias("id"), q.alias("g")),
        F.struct(F.col("loser").alias("id"), (-q).alias("g")))).alias("s"))
    return parts.groupBy("task", F.col("s.id").alias("id")).agg(F.sum("s.g").alias("_g"))


def bt_gradient(matches: DataFrame, lr: float = BT_LEARNING_RATE, iterations: int = 5,
                checkpoint_every: int = 1) -> DataFrame:
    """``(task, id, theta)`` after ``iterations`` gradient steps from 0.

    A step reads the previous theta three times (both ends of a match and the
    update), so an uncut plan grows as 3^steps: theta is handed over by file
    after every ``checkpoint_every`` steps (default: each one)."""
    counts = materialize(match_counts(matches))
    theta = all_items(matches).withColumn("theta", F.lit(0.0))
    for step in range(1, iterations + 1):
        g = _gradient(counts, theta)
        theta = (theta.join(g, ["task", "id"], "left")
                 .select("task", "id", (F.col("theta") + F.lit(lr) * F.coalesce(F.col("_g"), F.lit(0.0)))
                         .alias("theta")))
        if step % checkpoint_every == 0:
            theta = materialize(theta)
    return theta


def bt_loss(matches: DataFrame, scores: DataFrame) -> DataFrame:
    """``(task, loss)`` = -sum n * ln sigmoid(theta_w - theta_l)."""
    counts = match_counts(matches)
    tw = scores.select("task", F.col("id").alias("winner"), F.col("theta").alias("_tw"))
    tl = scores.select("task", F.col("id").alias("loser"), F.col("theta").alias("_tl"))
    j = counts.join(tw, ["task", "winner"]).join(tl, ["task", "loser"])
    nll = F.col("n") * F.log1p(F.exp(F.col("_tl") - F.col("_tw")))
    return j.groupBy("task").agg(F.sum(nll).alias("loss"))


#: Rows of pairs that make a partition of their layout worth while.
_PART_ROWS = 50_000


def _linearised(items: DataFrame, pairs: DataFrame, prior: float,
                parts: int) -> tuple[DataFrame, DataFrame]:
    """The Newton system at ``theta``: weights ``(node, other, w)`` of the pairs, kept by
    the executors in ``parts`` partitions by ``node`` (release them with ``unpersist``),
    and the start state of the conjugate gradients: ``r`` (wins minus expected wins),
    ``diag``, and the step so far, ``d``."""
    other = items.select(F.col("node").alias("other"), F.col("theta").alias("_to"))
    own = items.select("node", F.col("theta").alias("_t"))
    p = 1 / (1 + F.exp(F.col("_to") - F.col("_t")))
    joined = (pairs.join(other, "other").join(own, "node").select(
        "node", "other", (F.col("n") * p * (1 - p)).alias("w"),
        (F.col("n") * p).alias("expected"))
        .repartition(parts, "node").sortWithinPartitions("node").persist())
    sums = joined.groupBy("node").agg(F.sum("w").alias("diag"),
                                      F.sum("expected").alias("expected"))
    mine = 1 / (1 + F.exp(-F.col("theta")))  # against the prior's opponent

    def known(c):
        return F.coalesce(c, F.lit(0.0))

    g = F.col("wins") + prior - known("expected") - 2 * prior * mine
    diag = known("diag") + 2 * prior * mine * (1 - mine)
    start = items.join(sums, "node", "left").select(
        "node", "grp", diag.alias("diag"), g.alias("r"),
        *[F.lit(0.0).alias(c) for c in ("p", "s", "d")])
    return joined, materialize(start)


def _imaged(now: DataFrame, weights: DataFrame) -> DataFrame:
    """``now`` with ``_w``, the image of the preconditioned residual. The Newton matrix is
    never formed: it is applied by a join and a sum. It is symmetric, so every item sends
    its share to the others: the pairs stay where they are."""
    z = F.col("r") / F.col("diag")
    sums = (weights.join(now.select("node", z.alias("_z")), "node")
            .groupBy(F.col("other").alias("node")).agg(F.sum(F.col("w") * F.col("_z")).alias("_s")))
    image = F.col("diag") * z - F.coalesce("_s", F.lit(0.0))
    return now.join(sums, "node", "left").withColumn("_w", image).drop("_s")


def _norms(imaged: DataFrame, before: DataFrame | None) -> DataFrame:
    """``(grp, alpha, beta, rz, rz0)`` of a step of the conjugate gradients, preconditioned
    by the diagonal, in every component: both inner products of a step come from one
    aggregate. ``before``: the same of the last step."""
    z = F.col("r") / F.col("diag")
    sums = imaged.groupBy("grp").agg(F.sum(F.col("r") * z).alias("_rz"),
                                     F.sum(z * F.col("_w")).alias("_zw"))
    beta = curve = F.lit(0.0)
    first = F.col("_rz")
    if before is not None:
        sums = sums.join(before, "grp")
        beta = F.when(F.col("alpha") > 0, F.col("_rz") / F.col("rz")).otherwise(F.lit(0.0))
        curve = F.when(F.col("alpha") > 0, beta * F.col("_rz") / F.col("alpha")).otherwise(
            F.lit(0.0))
        first = F.greatest("rz0", "_rz")
    curve = F.col("_zw") - curve
    alpha = F.when((curve > 0) & (F.col("_rz") > 0), F.col("_rz") / curve).otherwise(F.lit(0.0))
    return sums.select("grp", alpha.alias("alpha"), beta.alias("beta"), F.col("_rz").alias("rz"),
                       first.alias("rz0"))


def _gradient_step(imaged: DataFrame, norms: DataFrame) -> DataFrame:
    """One step in every component (``p`` and its image ``s`` follow by recurrence)."""
    return (imaged.join(norms.select("grp", "alpha", "beta"), "grp")
            .withColumn("p", F.col("r") / F.col("diag") + F.col("beta") * F.col("p"))
            .withColumn("s", F.col("_w") + F.col("beta") * F.col("s"))
            .withColumn("d", F.col("d") + F.col("alpha") * F.col("p"))
            .withColumn("r", F.col("r") - F.col("alpha") * F.col("s"))
            .drop("_w", "alpha", "beta"))


#: The largest and least share of the residual norm at which the conjugate gradients
#: stop; the largest move of a theta in one Newton step.
_FORCING, _FINEST, _REACH = 0.05, 1e-3, 2.0


def _forcing(gap: float, tol: float) -> float:
    """Near the optimum a Newton step is worth solving as exactly as it is good, but for
    no more than ``tol``."""
    return min(_FORCING, max(gap / 2, tol / (2 * gap), _FINEST))


def _newton_step(items: DataFrame, start: DataFrame, weights: DataFrame, budget: int,
                 forcing: float) -> tuple[DataFrame, int]:
    """Items with the next ``theta``, and the passes made."""
    now, norms, made = start, None, 0
    while made < budget:
        imaged = materialize(_imaged(now, weights))
        norms = materialize(_norms(imaged, norms))
        now, made = _gradient_step(imaged, norms), made + 1
        if not norms.filter(F.col("rz") > F.col("rz0") * (forcing * forcing)).limit(1).count():
            break
    far = materialize(now.groupBy("grp").agg(F.max(F.abs("d")).alias("_far")))
    scale = F.least(F.lit(1.0), F.lit(_REACH) / F.greatest("_far", F.lit(1e-300)))
    return items.join(now.select("node", "d"), "node").join(far, "grp").select(
        "node", "grp", "wins", (F.col("theta") + scale * F.col("d")).alias("theta")), made


def bt_scores(matches: DataFrame, prior: float = 0.0, max_iter: int = 600,
              tol: float = 1e-4, centre: bool = True) -> DataFrame:
    """``(task, id, theta, finite, component)``: the Bradley-Terry maximum-likelihood
    scores of all tasks.

    Scores of two items have a finite difference only if each is reached from the
    other by wins: ``component`` names the strongly connected component of the
    graph of wins (its smallest id), scores are fitted inside components from their
    own matches and centred to mean 0 there. An item alone in its component has no
    finite optimum: ``finite`` is false and theta null.

    ``prior`` gives every item that many wins and as many losses against an
    opponent of strength 1 (theta 0): all items of a task are one component then and
    all optima finite. ``centre=False`` leaves those relative to that opponent.

    Newton steps whose systems are solved by conjugate gradients, each a pass over
    the compressed pairs. Stops when no item's expected wins differ from its wins by
    more than ``tol``; raises if ``max_iter`` passes do not get there (``tol=0``: makes
    about that many)."""
    counts = materialize(match_counts(matches))
    if prior > 0:
        least = counts.groupBy("task").agg(F.least(F.min("winner"), F.min("loser"))
                                           .alias("component"))
        parts = all_items(counts).join(least, "task")
    else:
        parts = strong_components(counts.select(
            "task", F.col("winner").alias("a"), F.col("loser").alias("b")))
    parts = materialize(parts.withColumn("node", F.monotonically_increasing_id()))
    group = parts.groupBy("task", "component").agg(F.min("node").alias("grp"))
    ends = [parts.select("task", F.col("id").alias(c), F.col("component").alias(f"_{c}"),
                         F.col("node").alias(n))
            for c, n in (("winner", "a"), ("loser", "b"))]
    counts = materialize(counts.join(ends[0], ["task", "winner"]).join(ends[1], ["task", "loser"])
                         .filter("_winner = _loser and a <> b").select("a", "b", "n"))
    sides = (counts.select(F.col("a").alias("node"), F.col("b").alias("other"), "n",
                           F.col("n").alias("won"))
             .unionByName(counts.select(F.col("b").alias("node"), F.col("a").alias("other"), "n",
                                        F.lit(0).cast("long").alias("won")))
             .groupBy("node", "other").agg(F.sum("n").alias("n"), F.sum("won").alias("won")))
    sides = materialize(sides)
    pairs = sides.drop("won")
    # an item whose only matches are with itself has no pair, only the prior
    played = sides.groupBy("node").agg(F.sum("won").alias("wins"), F.sum("n").alias("games"))
    nodes = parts.filter("id is not null").join(group, ["task", "component"]).select("node", "grp")
    if prior > 0:
        items = nodes.join(played, "node", "left").fillna(0, ["wins", "games"])
        # as against opponents of strength 1 throughout
        theta = F.log((F.col("wins") + prior) / (F.col("games") - F.col("wins") + prior))
    else:
        items, theta = nodes.join(played, "node"), F.lit(0.0)
    items = materialize(items.withColumn("theta", theta).drop("games"))
    spread = min(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                 1 + sides.count() // _PART_ROWS)
    made = 0
    while True:
        weights, start = _linearised(items, pairs, prior, spread)
        made += 1
        gap = start.agg(F.max(F.abs("r"))).first()[0]
        last = gap is None or gap <= tol or (made >= max_iter and not tol)
        if not last and made < max_iter:
            items, more = _newton_step(items, start, weights, max_iter - made,
                                       _forcing(gap, tol))
            items, made = materialize(items), made + more
            weights.unpersist()
            continue
        weights.unpersist()
        if last:
            break
        raise RuntimeError(f"theta still moves: expected wins are off by {gap:.2g} after "
                           f"{made} passes")
    theta = items.select("node", "grp", "theta")
    if centre:
        mean = theta.groupBy("grp").agg(F.avg("theta").alias("_m"))
        theta = theta.join(mean, "grp").select(
            "node", (F.col("theta") - F.col("_m")).alias("theta"))
    return (parts.join(theta.select("node", "theta"), "node", "left")
            .select("task", "id", "theta", F.col("theta").isNotNull().alias("finite"),
                    "component"))


def bt_residuals(matches: DataFrame, scores: DataFrame, prior: float = 0.0) -> DataFrame:
    """``(task, id, residual)``: wins minus expected wins of every item of ``scores``
    with a finite score, over its matches inside its component; 0 at the optimum.
    With a ``prior`` the scores must not be centred."""
    side = [scores.filter("finite").select("task", F.col("id").alias(c),
                                           F.col("theta").alias(f"_t{c[0]}"),
                                           F.col("component").alias(f"_c{c[0]}"))
            for c in ("winner", "loser")]
    lost = (match_counts(matches).filter("winner <> loser").join(side[0], ["task", "winner"])
            .join(side[1], ["task", "loser"]).filter("_cw = _cl")
            .withColumn("_q", F.col("n") / (1 + F.exp(F.col("_tw") - F.col("_tl")))))
    parts = lost.select("task", F.explode(F.array(
        F.struct(F.col("winner").alias("id"), F.col("_q").alias("g")),
        F.struct(F.col("loser").alias("id"), (-F.col("_q")).alias("g")))).alias("s"))
    sums = parts.groupBy("task", F.col("s.id").alias("id")).agg(F.sum("s.g").alias("_g"))
    own = F.lit(prior) - F.lit(2.0 * prior) / (1 + F.exp(-F.col("theta")))
    return scores.filter("finite").join(sums, ["task", "id"], "left").select(
        "task", "id", (F.coalesce("_g", F.lit(0.0)) + own).alias("residual"))


def uniform_scores(scores: DataFrame, score_col: str = "theta", name: str = "score") -> DataFrame:
    """Best item 99, worst 1, evenly spaced by rank within each task (ties by
    id); a single item gets 99."""
    ranked = global_rank(scores, [F.col(score_col).desc(), F.col("id")], by=["task"], name="_r")
    n = scores.groupBy("task").agg(F.count(F.lit(1)).alias("_n"))
    span = UNIFORM_TOP - UNIFORM_BOTTOM
    s = F.when(F.col("_n") == 1, F.lit(UNIFORM_TOP)).otherwise(
        F.lit(UNIFORM_TOP) - (F.col("_r") - 1) * F.lit(span) / (F.col("_n") - 1))
    return ranked.join(n, "task").withColumn(name, s).drop("_r", "_n")


def order_scores(scores: DataFrame, score_col: str = "theta") -> DataFrame:
    """Adds ``rank`` (1 = best) within each task; ties by id."""
    return global_rank(scores, [F.col(score_col).desc(), F.col("id")], by=["task"], name="rank")


def finalize_scores(scores: DataFrame, score_type: str = "bradley_terry",
                    score_col: str = "theta") -> DataFrame:
    """``(task, id, score)``: raw theta (``bradley_terry``) or ``uniform``."""
    if score_type == "bradley_terry":
        return scores.select("task", "id", F.col(score_col).alias("score"))
    if score_type == "uniform":
        return uniform_scores(scores, score_col).select("task", "id", "score")
    raise ValueError("score_type must be 'bradley_terry' or 'uniform'")
