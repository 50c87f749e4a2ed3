"""Approximate nearest neighbours by cosine: a robust-pruned directed graph per shard.

Rows are dealt to shards of bounded size by the hash of their id and vector. In a shard
greedy searches from the medoid propose the neighbours of each vector, and
relaxed distance pruning keeps a few diverse ones (a candidate goes when an
already kept neighbour is closer to it by the factor ALPHA). Queries run a beam
search over every shard's graph; the best of all shards is the answer, scored
exactly on the original vectors. Equal vectors are one vertex with many ids.

All steps work on batches of vectors at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import saved

SHARD = 4000
DEGREE = 32
BUILD_BEAM = 64
SEARCH_BEAM = 96
ALPHA = 1.2
BATCH = 256
QUERY_BLOCK = 1000


def beam_search(x: np.ndarray, graph: np.ndarray, starts: np.ndarray, queries: np.ndarray,
                beam: int, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Ids and squared distances of the ``beam`` nearest vertices found for each
    query (-1 and infinity where there are fewer), nearest first."""
    q, n = len(queries), len(x)
    seen = np.zeros((q, n + 1), bool)
    seen[:, n] = True
    ids = np.full((q, beam), n, np.int64)
    dist = np.full((q, beam), np.inf)
    starts = starts[:beam]
    ids[:, :len(starts)] = starts
    dist[:, :len(starts)] = 2 - 2 * queries @ x[starts].T
    seen[:, starts] = True
    done = ids == n
    rows = np.arange(q)[:, None]
    while True:
        waiting = np.where(done, np.inf, dist)
        k = min(expand, beam)
        pick = np.argpartition(waiting, k - 1, axis=1)[:, :k] if k < beam else np.tile(
            np.arange(beam), (q, 1))
        live = np.isfinite(waiting[rows, pick])
        active = np.flatnonzero(live.any(1))
        if not len(active):
            break
        pick, live, own = pick[active], live[active], active[:, None]
        done[own, pick] = True
        near = np.where(live[:, :, None], graph[np.where(live, ids[own, pick], 0)], n)
        near = np.sort(near.reshape(len(active), -1), axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        near[seen[own, near]] = n
        seen[own, near] = True
        d = 2 - 2 * np.einsum("bkd,bd->bk", x[np.minimum(near, n - 1)], queries[active])
        d[near == n] = np.inf
        all_d = np.concatenate([dist[active], d], 1)
        order = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        local = np.arange(len(active))[:, None]
        ids[active] = np.concatenate([ids[active], near], 1)[local, order]
        done[active] = np.concatenate([done[active], near == n], 1)[local, order]
        dist[active] = all_d[local, order]
    order = np.argsort(dist, axis=1, kind="stable")
    ids, dist = ids[rows, order], dist[rows, order]
    return np.where(np.isfinite(dist), ids, -1), dist


def robust_prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int,
                 alpha: float) -> np.ndarray:
    """Neighbours (len(points), degree) kept of each point's candidates (``len(x)``: none)."""
    n = len(x)
    candidates = np.sort(candidates, axis=1)
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = n
    candidates[candidates == points[:, None]] = n
    v = x[np.minimum(candidates, n - 1)]
    d = 2 - 2 * np.einsum("bkd,bd->bk", v, x[points])
    d[candidates == n] = np.inf
    order = np.argsort(d, axis=1, kind="stable")
    rows = np.arange(len(points))[:, None]
    candidates, d, v = candidates[rows, order], d[rows, order], v[rows, order]
    between = 2 - 2 * v @ v.transpose(0, 2, 1)
    alive = np.isfinite(d)
    out = np.full((len(points), degree), n, np.int64)
    flat = rows[:, 0]
    for k in range(degree):
        some = alive.any(1)
        if not some.any():
            break
        first = alive.argmax(1)
        out[some, k] = candidates[flat, first][some]
        near = np.maximum(between[flat, first], 0)
        alive &= alpha * alpha * near > np.where(np.isfinite(d), d, 0)
        alive[flat, first] = False
    return out


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA,
          seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Graph (n, degree) of unit vectors, ``n`` meaning no edge, and the start vertices."""
    n = len(x)
    rng = np.random.default_rng(seed)
    graph = rng.integers(0, n, (n, degree)) if n > 1 else np.full((n, degree), n)
    graph[graph == np.arange(n)[:, None]] = n
    centre = x.mean(0)
    starts = np.unique(np.append(rng.integers(0, n, min(n, 7)), int((x @ centre).argmax())))
    for slack in (1.0, alpha):
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            points = order[at:at + BATCH]
            found, _ = beam_search(x, graph, starts, x[points], beam)
            found = np.where(found < 0, n, found)
            graph[points] = robust_prune(x, points, np.concatenate([found, graph[points]], 1),
                                         degree, slack)
            # the way back: vertices that gain too many edges are pruned again
            a, b = np.repeat(points, degree), graph[points].ravel()
            a, b = a[b < n], b[b < n]
            by = np.argsort(b, kind="stable")
            a, b = a[by], b[by]
            target, first, count = np.unique(b, return_index=True, return_counts=True)
            for lo in range(0, len(target), BATCH):
                t, f, c = target[lo:lo + BATCH], first[lo:lo + BATCH], count[lo:lo + BATCH]
                gain = np.full((len(t), int(c.max())), n)
                place = np.repeat(np.arange(len(t)), c)
                inner = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
                gain[place, inner] = a[np.repeat(f, c) + inner]
                both = np.sort(np.concatenate([graph[t], gain], 1), axis=1)
                both[:, 1:][both[:, 1:] == both[:, :-1]] = n
                both.sort(axis=1)
                fits = (both < n).sum(1) <= degree
                graph[t[fits]] = both[fits][:, :degree]
                if not fits.all():
                    graph[t[~fits]] = robust_prune(x, t[~fits], both[~fits], degree, slack)
    return graph, starts


def _vectors(column) -> np.ndarray:
    flat = np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray)
                      else column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1)


def _scaled(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors times a power of two each, so that their squares neither overflow nor
    vanish, and their norms: a cosine is the same to the last bit."""
    _, exponent = np.frexp(np.abs(v).max(1, initial=0.0))
    v = np.ldexp(v, -exponent[:, None])
    return v, np.sqrt((v * v).sum(1))


def _index(key, table):
    """One row per shard: ids, vectors and copies of its rows by vertex, and the graph."""
    ids = np.asarray(table.column("vec_id"))
    v, norms = _scaled(_vectors(table.column("v")))
    order = np.lexsort((*v.T[::-1], ids))
    ids, v, norms = ids[order], v[order], norms[order]
    copies = np.asarray(table.column("copies"))[order]
    points, vertex = np.unique(v / norms[:, None], axis=0, return_inverse=True)
    graph, starts = build(points)
    return pa.table({
        "space": pa.array([key[0].as_py()], pa.int32()),
        "shard": pa.array([key[1].as_py()], pa.int32()),
        "ids": pa.array([ids.tobytes()], pa.binary()),
        "vectors": pa.array([v.tobytes()], pa.binary()),
        "copies": pa.array([copies.astype(np.int64).tobytes()], pa.binary()),
        "vertex": pa.array([vertex.reshape(-1).astype(np.int32).tobytes()], pa.binary()),
        "graph": pa.array([graph.astype(np.int32).tobytes()], pa.binary()),
        "starts": pa.array([starts.astype(np.int64).tobytes()], pa.binary())})


def _search(key, left, right, k: int, beam: int):
    """The best of one shard for a block of queries."""
    out: list[tuple] = []
    if left.num_rows and right.num_rows:
        row = {c: left.column(c)[0].as_py() for c in left.column_names}
        ids = np.frombuffer(row["ids"], np.int64)
        v = np.frombuffer(row["vectors"], np.float64).reshape(len(ids), -1)
        copies = np.frombuffer(row["copies"], np.int64)
        vertex = np.frombuffer(row["vertex"], np.int32)
        norms = np.sqrt((v * v).sum(1))
        graph = np.frombuffer(row["graph"], np.int32).reshape(-1, DEGREE).astype(np.int64)
        order = np.argsort(vertex, kind="stable")  # members of a vertex, smallest id first
        begin = np.searchsorted(vertex[order], np.arange(len(graph) + 1))
        x = (v / norms[:, None])[order[begin[:-1]]]
        starts = np.frombuffer(row["starts"], np.int64)
        names, numbers = np.asarray(right.column("vec_id")), np.asarray(right.column("q"))
        q, q_norms = _scaled(_vectors(right.column("v")))
        for at in range(0, len(q), BATCH):
            found, _ = beam_search(x, graph, starts, q[at:at + BATCH]
                                   / q_norms[at:at + BATCH, None], beam)
            for i, near in enumerate(found, start=at):
                near = near[near >= 0][:k + 12]
                rows = np.concatenate([order[begin[p]:min(begin[p] + k + 1, begin[p + 1])]
                                       for p in near])
                # every row but the query's own: one copy of it stays away
                own = (ids[rows] == names[i]) & (v[rows] == q[i]).all(1)
                rows = np.repeat(rows, np.minimum(copies[rows] - own, k))
                score = v[rows] @ q[i] / (norms[rows] * q_norms[i])
                best = np.lexsort((ids[rows], -score))[:k]
                out += [(numbers[i], ids[rows[j]], score[j]) for j in best]
    columns = list(zip(*out)) or [(), (), ()]
    return pa.table({"q": pa.array(columns[0], pa.int64()),
                     "vec_id": pa.array(columns[1], pa.int64()),
                     "score": pa.array(columns[2], pa.float64())})


def usable(embeddings: DataFrame) -> DataFrame:
    """``vec_id, v`` (doubles) of rows with an id and a finite vector that is not zero."""
    v = F.col("embedding").cast("array<double>")
    good = (F.col("vec_id").isNotNull() & (F.size("embedding") > 0)
            & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)
                       & (F.abs(x) != float("inf")))
            & F.exists("embedding", lambda x: x != 0))
    return embeddings.filter(F.coalesce(good, F.lit(False))).select("vec_id", v.alias("v"))


def _distinct(rows: DataFrame) -> DataFrame:
    """Usable rows, equal ones (id and vector) once with their number: a row that makes
    up much of the table is one row of a shard."""
    return (usable(rows).groupBy("vec_id", "v").agg(F.count("*").alias("copies"))
            .withColumn("space", F.size("v")))


def nearest(embeddings: DataFrame, queries: DataFrame, k: int = 5, shard: int = SHARD,
            beam: int = SEARCH_BEAM) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each query row, among
    all rows but itself.

    Vectors that are null, zero, or hold null or non-finite components take no
    part; any finite magnitude does. Rows that repeat an id are rows of their own, as
    queries and as candidates: also another row of the query's id, and an equal one,
    can be found. Vectors of different sizes never meet; equal scores go to the smaller
    id; other columns are ignored; empty tables give an empty result. With fewer than
    ``k`` candidates all are returned.
    """
    rows = saved(_distinct(embeddings), "ann-rows")
    counts = {r["space"]: r["count"] for r in rows.groupBy("space").count().collect()}
    shards = {d: max(1, -(-n // shard)) for d, n in counts.items()} or {0: 1}
    number = F.create_map(*[F.lit(x) for pair in sorted(shards.items()) for x in pair])[
        F.col("space")]
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), number).cast("int"))
    # a task for each shard: adaptive execution would join their small inputs
    index = saved(dealt.repartition(sum(shards.values()), "space", "shard")
                  .groupBy("space", "shard").applyInArrow(
        _index, "space int, shard int, ids binary, vectors binary, copies binary, "
                "vertex binary, graph binary, starts binary"), "ann-index")
    blocks_of = F.greatest(F.lit(1), F.ceil(F.lit(sum(counts.values()))
                                            / F.lit(50 * QUERY_BLOCK)))
    numbered = saved(_distinct(queries).withColumn("q", F.monotonically_increasing_id()),
                     "ann-queries")
    asked = (numbered.drop("copies")
             .withColumn("block", F.pmod(F.xxhash64("q", F.lit(3)), blocks_of).cast("int"))
             .withColumn("shard", F.explode(F.sequence(F.lit(0), number - 1))))
    blocks = asked.select("space", "block").distinct()
    target = index.join(blocks, "space").toDF("i_space", "i_shard", "ids", "vectors", "copies",
                                              "vertex", "graph", "starts", "i_block")
    found = (target.groupBy("i_space", "i_shard", "i_block").cogroup(
        asked.groupBy("space", "shard", "block"))
        .applyInArrow(lambda key, a, b: _search(key, a, b, k, beam),
                      "q bigint, vec_id bigint, score double"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    ranked = (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
              .join(numbered.select("q", F.col("vec_id").alias("query_id"), "copies"), "q"))
    # equal query rows have equal answers
    return ranked.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(
        "query_id", "rank", "vec_id", "score")
