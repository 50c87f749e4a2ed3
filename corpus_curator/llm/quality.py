"""Quality scores: random Fourier features, ridge by normal equations, isotonic calibration.

Statistics of every whole text are standardised and mapped to random Fourier
features, whose inner products approximate a Gaussian kernel. Each partition
sums its part of the normal equations, the parts are added in a tree, and the
driver solves one small system per fold. Scores that each fold gets from the
model of the others are calibrated by isotonic regression on a fixed grid.
"""

from __future__ import annotations

import itertools
import operator
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import remainder, saved, slices, text_bytes

FEATURES = 256
FOLDS = 4
RIDGES = (1e-4, 1e-3, 1e-2, 1e-1)
GRID = 2000
SEED = 11

_GROUPS = {"lower": range(0x61, 0x7B), "upper": range(0x41, 0x5B), "digit": range(0x30, 0x3A),
           "high": range(0x80, 0x100), "blank": (0x20, 0x09), "line": (0x0A,), "stop": b".",
           "comma": b",", "bang": b"!?", "mark": b"#*%$&@^~", "bar": b"|", "quote": b"\"'`",
           "bracket": b"()[]{}<>", "colon": b":;", "dash": b"-_=+/\\"}
_CLASS = np.full(256, len(_GROUPS))
for _k, _bytes in enumerate(_GROUPS.values()):
    _CLASS[list(_bytes)] = _k
N_STATS = len(_GROUPS) + 1 + 18


def statistics(text: bytes) -> np.ndarray:
    """Statistics of a whole text; zeros for an empty one."""
    out = np.zeros(N_STATS)
    n = len(text)
    if not n:
        return out
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    groups = np.bincount(_CLASS, counts, minlength=len(_GROUPS) + 1)
    k = len(groups)
    out[:k] = np.sqrt(groups / n)
    p = counts[counts > 0] / n
    words = text.split()
    m = len(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    more = [np.log1p(n), -(p * np.log(p)).sum(), np.log1p(m), np.log1p(len(lines))]
    if m:
        seen = Counter(words)
        lengths = np.fromiter(map(len, words), np.int64, m)
        tops = sorted(seen.values(), reverse=True)[:5]
        pairs = len(set(zip(words, words[1:])))
        last = Counter(w[-1] for w in words)
        odd = sum(c for b, c in last.items() if _CLASS[b] in (8, 9, 10))
        more += [len(seen) / m, len(seen) / m ** 0.8, lengths.mean(), lengths.std(),
                 np.log1p(lengths.max()), tops[0] / m, sum(tops) / m,
                 sum(map(operator.eq, words, itertools.islice(words, 1, None))) / m,
                 pairs / max(m - 1, 1), sum(map(bytes.isupper, words)) / m, odd / m,
                 last.get(0x2E, 0) / m, len(set(lines)) / max(len(lines), 1),
                 np.log1p(m / max(len(lines), 1))]
    out[k:k + len(more)] = more
    return out


def document_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, stats`` (array of doubles) of every document."""
    def run(batches):
        for ids, texts in slices(batches):
            flat = np.concatenate([statistics(t) for t in texts])
            offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * N_STATS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(flat))],
                names=["doc_id", "stats"])

    return docs.select("doc_id", text_bytes()).mapInArrow(run, "doc_id bigint, stats array<double>")


def fourier(x: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    """Standardised statistics, their random Fourier features, and a constant."""
    z = np.clip((x - mean) / std, -6, 6)
    rng = np.random.default_rng(SEED)
    w = rng.standard_normal((x.shape[1], FEATURES)) / np.sqrt(x.shape[1])
    b = rng.uniform(0, 2 * np.pi, FEATURES)
    return np.hstack([z * 0.1, np.sqrt(2 / FEATURES) * np.cos(z @ w + b), np.ones((len(x), 1))])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; centres and levels of the blocks."""
    blocks: list[list[float]] = []
    for a, b, w in zip(x, y, weight):
        blocks.append([a * w, b * w, w])
        while len(blocks) > 1 and (blocks[-2][1] * blocks[-1][2]
                                   >= blocks[-1][1] * blocks[-2][2]):
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return (np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks]))


class Model:
    """Standardisation, ridge weights and calibration."""

    def __init__(self, mean, std, weights, centres, levels):
        self.mean, self.std, self.weights = mean, std, weights
        self.centres, self.levels = centres, levels

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        raw = fourier(x, self.mean, self.std) @ self.weights
        # a hundredth of the raw score keeps the order inside a level
        smooth = 1 / (1 + np.exp(-np.clip(4 * (raw - 0.5), -30, 30)))
        return np.clip(0.99 * np.interp(raw, self.centres, self.levels) + 0.01 * smooth, 0, 1)


def learn(stats: DataFrame, labels: DataFrame) -> Model:
    """Fit on all labelled rows of ``labels`` (``doc_id``, ``quality``) whose id
    may be learnt from."""
    known = (labels.select("doc_id", F.col("quality").cast("double").alias("y"))
             .filter("y is not null").filter(remainder("doc_id", 3) != 1)
             .groupBy("doc_id").agg(F.max("y").alias("y")))
    rows = saved(stats.join(known, "doc_id").select(
        "stats", "y", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold")),
        "quality-rows")
    moments = rows.select(*[F.avg(F.col("stats")[i]).alias(f"m{i}") for i in range(N_STATS)],
                          *[F.stddev_pop(F.col("stats")[i]).alias(f"s{i}")
                            for i in range(N_STATS)], F.count("*").alias("n")).first()
    if not moments["n"]:
        return Model(None, None, None, None, None)
    mean = np.array([moments[f"m{i}"] for i in range(N_STATS)])
    std = np.maximum(np.array([moments[f"s{i}"] for i in range(N_STATS)]), 1e-6)
    size = N_STATS + FEATURES + 1

    def equations(batches):
        parts = np.zeros((FOLDS, size + 1, size + 1))
        for batch in batches:
            z = fourier(_matrix(batch.column("stats")), mean, std)
            z = np.hstack([z, np.asarray(batch.column("y"))[:, None]])
            fold = np.asarray(batch.column("fold"))
            for k in range(FOLDS):
                part = z[fold == k]
                parts[k] += part.T @ part
        yield pa.RecordBatch.from_arrays([pa.array([parts.tobytes()], pa.binary())],
                                         names=["sums"])

    zero = np.zeros((FOLDS, size + 1, size + 1))
    sums = (rows.mapInArrow(equations, "sums binary").rdd
            .map(lambda r: np.frombuffer(r[0]).reshape(FOLDS, size + 1, size + 1))
            .treeAggregate(zero, np.add, np.add, 2))
    whole = sums.sum(0)

    def solve(total, ridge):
        a, b = total[:-1, :-1], total[:-1, -1]
        keep = np.eye(size)
        keep[-1, -1] = 0
        return np.linalg.lstsq(a + ridge * max(total[-2, -2], 1) * keep, b, rcond=None)[0]

    def loss(w, part):
        return part[-1, -1] - 2 * w @ part[:-1, -1] + w @ part[:-1, :-1] @ w

    trials = {r: [solve(whole - sums[k], r) for k in range(FOLDS)] for r in RIDGES}
    ridge = min(RIDGES, key=lambda r: sum(loss(w, sums[k]) for k, w in enumerate(trials[r])))
    others = np.stack(trials[ridge])

    def held(batches):
        for batch in batches:
            z = fourier(_matrix(batch.column("stats")), mean, std)
            raw = (z * others[np.asarray(batch.column("fold"))]).sum(1)
            cell = np.clip(np.round((raw + 0.5) * GRID / 2), 0, GRID).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column("y")],
                                             names=["cell", "y"])

    cells = (rows.mapInArrow(held, "cell int, y double").groupBy("cell")
             .agg(F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("cell").collect())
    centres, levels = isotonic(np.array([c["cell"] * 2 / GRID - 0.5 for c in cells]),
                               np.array([c["y"] for c in cells]),
                               np.array([float(c["n"]) for c in cells]))
    return Model(mean, std, solve(whole, ridge), centres, levels)


def predict(stats: DataFrame, model: Model) -> DataFrame:
    shared = stats.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers

    def run(batches):
        model = shared.value
        for batch in batches:
            if batch.num_rows:
                score = model.score(_matrix(batch.column("stats")))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return stats.select("doc_id", "stats").mapInArrow(run, "doc_id bigint, score double")


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, score`` (0 to 1) of every document.

    Null text counts as empty and gets a score like any other; repeated rows each
    give a row (a repeated label counts once); null ids stay null and teach
    nothing; null labels are left out; without labels every score is 0.5; other
    columns are ignored; an empty table gives an empty result.
    """
    stats = saved(document_statistics(docs), "quality-stats")
    return predict(stats, learn(stats, labels))
