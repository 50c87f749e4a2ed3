"""Language of whole texts from word labels: a linear-chain conditional random field.

Every word gets a score per language from affix, character n-gram and lexicon
features; learned transitions tie neighbouring words, so code-switched text is
labelled word by word; forward-backward gives each word's posterior. The
document's language is the one with the largest summed posterior.

Forward-backward runs over all words of a batch at once: the word sequence is
cut into blocks whose transfer matrices are multiplied together, so the work
inside is vectorised over the blocks, and the result is exact (documents of
any length are labelled whole).
"""

from __future__ import annotations

import itertools
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import remainder, tidy

#: Rows the field is fitted on: about this many per language (whole texts), of which parts with
#: at most MAX_WORDS words in all, as many of each language, in random order.
SAMPLE_PER_LANGUAGE = 200
MAX_WORDS = 200_000
BUCKETS = 1 << 17
STEPS = 20
BLOCK = 256
#: Documents labelled at once in a task; bounds its memory.
SLICE = 256


def _words(text: str) -> list[str]:
    return text.lower().split()


def _core(word: str) -> str:
    """The word without what is no letter at its ends; empty if it has no letter."""
    a, b = 0, len(word)
    while a < b and not word[a].isalpha():
        a += 1
    while b > a and not word[b - 1].isalpha():
        b -= 1
    return word[a:b]


def features(word: str, lexicon: dict[str, int]) -> list[int]:
    """Buckets of the features of a lower-cased word core: its lexicon entry, the
    word, affixes and the trigrams of its bytes (a kind is a start value of the
    checksum)."""
    crc, b = zlib.crc32, word.encode()
    found = [crc(b, 1), lexicon.get(word, 0)]
    found += [crc(b[:k], 10 + k) for k in (1, 2, 3, 4)]
    found += [crc(b[-k:], 20 + k) for k in (1, 2, 3, 4, 5)]
    found += [crc(b[i:i + 3], 30) for i in range(len(b) - 2)]
    return [f & (BUCKETS - 1) for f in found]


def forward_backward(e: np.ndarray, trans: np.ndarray, start: np.ndarray, begins: np.ndarray,
                     block: int = BLOCK, pairs: bool = False):
    """Posteriors of all words. ``e``: (n, k) positive word scores; ``begins``
    marks the first word of a sequence. With ``pairs`` also the summed posterior
    of neighbouring label pairs."""
    n, k = e.shape
    rows = max(1, -(-n // block))
    fill = rows * block - n
    kind = e.dtype
    trans, start = trans.astype(kind), start.astype(kind)
    e = np.concatenate([e, np.ones((fill, k), kind)]).reshape(rows, block, k)
    e = np.ascontiguousarray(e.transpose(1, 0, 2))  # by place in the block
    new = np.concatenate([begins, np.ones(fill, bool)]).reshape(rows, block).T.copy()
    whole = np.tile(np.eye(k, dtype=kind), (rows, 1, 1))
    for t in range(block):
        fresh = np.flatnonzero(new[t])
        step = (whole.reshape(-1, k) @ trans).reshape(rows, k, k)
        step[fresh] = whole[fresh].sum(2, keepdims=True) * start
        whole = step * e[t][:, None, :]
        if t % 4 == 3 or t == block - 1:
            whole /= whole.max((1, 2), keepdims=True)
    first, last = np.empty((rows, k), kind), np.empty((rows, k), kind)
    a = np.ones(k) / k
    for r in range(rows):
        first[r] = a
        a = a @ whole[r]
        a = a / a.sum()
    b = np.ones(k)
    for r in range(rows - 1, -1, -1):
        last[r] = b
        b = whole[r] @ b
        b = b / b.max()
    alpha = np.empty((block, rows, k), kind)
    a = first
    for t in range(block):
        a = a @ trans
        a[new[t]] = start
        a *= e[t]
        a /= a.sum(1, keepdims=True)
        alpha[t] = a
    gamma = np.empty((block, rows, k), kind)
    both = np.zeros((k, k))
    b = last
    for t in range(block - 1, -1, -1):
        g = alpha[t] * b
        gamma[t] = g / g.sum(1, keepdims=True)
        right = e[t] * b
        if pairs:
            left = alpha[t - 1] if t else first
            xi = left[:, :, None] * trans * right[:, None, :]
            xi /= xi.sum((1, 2), keepdims=True)
            both += xi[~new[t]].sum(0)
        b = right @ trans.T
        fresh = new[t]
        b[fresh] = (right[fresh] * start).sum(1, keepdims=True)
        b /= b.max(1, keepdims=True)
    return gamma.transpose(1, 0, 2).reshape(-1, k)[:n], both


@dataclass
class Field:
    """A fitted field: label names, feature weights, transitions, lexicon."""
    labels: list[str]
    weights: np.ndarray
    trans: np.ndarray
    start: np.ndarray
    lexicon: dict[str, int]

    def scores(self, cores: list[str]) -> np.ndarray:
        """Positive scores (words, labels) of word cores."""
        found = [features(c, self.lexicon) for c in cores]
        begin = np.cumsum([0] + [len(f) for f in found[:-1]])
        flat = np.fromiter(itertools.chain.from_iterable(found), np.int32)
        s = np.add.reduceat(self.weights[flat], begin, axis=0)
        return np.exp(np.clip(s - s.max(1, keepdims=True), -30, 0))


class Emissions(dict):
    """Word -> row of ``table``, its scores; -1 for a word without a letter. New
    words get a row at once and their scores together. Bounded: starts anew when
    it is full, between batches, so results never depend on it."""

    def __init__(self, field: Field, limit: int = 200_000):
        super().__init__()
        self.field, self.limit = field, limit
        self.table = np.empty((0, len(field.labels)), np.float32)
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        core = _core(word)
        at = -1
        if core:
            at = len(self.table) + len(self.new)
            self.new.append(core)
        self[word] = at
        return at

    def rows(self, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        """Rows of the words of each text, and the table they point into."""
        if len(self.table) > self.limit:
            self.clear()
            self.table = self.table[:0]
        found = [np.fromiter(map(self.__getitem__, _words(t)), np.int32) for t in texts]
        if self.new:
            self.table = np.concatenate([self.table, self.field.scores(self.new)])
            self.new = []
        return found, self.table


def _lexicon(rows: list[tuple[int, list[str]]], k: int) -> dict[str, int]:
    """Word -> 1 + language, for words nearly always seen in one language."""
    seen: dict[str, np.ndarray] = {}
    for label, words in rows:
        for w in set(words):
            seen.setdefault(w, np.zeros(k))[label] += 1
    return {w: 1 + int(c.argmax()) for w, c in seen.items() if c.sum() >= 3
            and c.max() >= 0.9 * c.sum()}


def fit(texts: list[tuple[str, str]], seed: int = 7, steps: int = STEPS) -> Field:
    """Fit the field on (text, language) rows: every word carries its text's
    language; pieces of texts in different languages are joined in turn so that
    the transitions learn switches. Adam on the exact likelihood gradient."""
    labels = sorted({lang for _, lang in texts})
    k, index = len(labels), {lang: i for i, lang in enumerate(labels)}
    rows = []
    for text, lang in texts:
        words = [c for c in map(_core, _words(text)) if c]
        if words:
            rows.append((index[lang], words))
    if not rows:
        return Field(labels or ["und"], np.zeros((BUCKETS, max(k, 1)), np.float32),
                     np.full((max(k, 1),) * 2, 1 / max(k, 1)), np.ones(max(k, 1)) / max(k, 1), {})
    # half the texts fit the lexicon's use on unseen words: features see a lexicon of the other half
    halves = [_lexicon(rows[i::2], k) for i in (0, 1)]
    types: dict[tuple[int, str], int] = {}
    rng = np.random.default_rng(seed)
    parts = []
    for i, (label, words) in enumerate(rows):
        ids = [types.setdefault((1 - i % 2, w), len(types)) for w in words]
        cuts = [0, *np.cumsum(rng.integers(8, 60, size=len(ids) // 8 + 1)).tolist()]
        parts += [(label, ids[a:b]) for a, b in zip(cuts, [*cuts[1:], len(ids)]) if ids[a:b]]
    parts = [parts[j] for j in rng.permutation(len(parts))]
    order, begins, y, taken, used = [], [], [], 0, [0] * k
    for label, ids in parts:
        if used[label] >= MAX_WORDS / k:
            continue
        order += ids
        begins += [taken % 6 == 0] + [False] * (len(ids) - 1)
        y += [label] * len(ids)
        taken += 1
        used[label] += len(ids)
    order, begins, y = np.array(order), np.array(begins), np.array(y)
    found = [np.array(features(w, halves[h]), np.int32) for h, w in types]
    flat = np.concatenate(found)
    owner = np.repeat(np.arange(len(found), dtype=np.int32), [len(fs) for fs in found])
    hot = np.zeros((len(types), k))
    np.add.at(hot, (order, y), 1)
    seen = np.zeros((k, k))
    inner = np.flatnonzero(~begins)
    np.add.at(seen, (y[inner - 1], y[inner]), 1)
    start = np.bincount(y[begins], minlength=k) + 1.0
    start /= start.sum()
    w, t = np.zeros((BUCKETS, k)), np.zeros((k, k))
    mw, vw, mt, vt = np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)
    n = len(order)
    for step in range(1, steps + 1):
        s = np.stack([np.bincount(owner, w[flat, c], minlength=len(found)) for c in range(k)], 1)
        e = np.exp(np.clip(s - s.max(1, keepdims=True), -30, 0))[order]
        gamma, both = forward_backward(e, np.exp(t), start, begins, pairs=True)
        got = np.stack([np.bincount(order, gamma[:, c], minlength=len(found))
                        for c in range(k)], 1)
        per = (hot - got) / n
        gw = np.stack([np.bincount(flat, per[owner, c], minlength=BUCKETS)
                       for c in range(k)], 1) - 1e-7 * w
        gt = (seen - both) / n - 1e-4 * t
        for x, g, m, v, rate in ((w, gw, mw, vw, 0.15), (t, gt, mt, vt, 0.3)):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-9)
    return Field(labels, w.astype(np.float32), np.exp(t), start, _lexicon(rows, k))


def learn(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Field:
    """Fit on a bounded sample: rows with a language and a learnable id, about
    ``per_language`` of each language, chosen by the hash of their id."""
    rows = docs.select("doc_id", "text", "lang").filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder("doc_id", 3) != 1))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return fit([])
    unit = (F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 30) - 1))) / float(1 << 30)
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items())
                           for x in (lang, min(1.0, per_language / n))])
    picked = rows.filter(unit < share[F.col("lang")]).orderBy(
        F.xxhash64("doc_id", "text"), "doc_id", "text").limit(2 * per_language * len(counts))
    return fit([(r["text"], r["lang"]) for r in
                sorted(picked.collect(), key=lambda r: (r["doc_id"], r["text"]))])


def predict(docs: DataFrame, field: Field, carry: bool = False, prefix: str = "") -> DataFrame:
    """One row per document: ``doc_id, lang_pred, score, switches, n_words``; with
    ``carry`` all columns of ``docs`` instead of ``doc_id`` (of those that have a
    name of the result, the document's). ``prefix`` is put before the names of the
    result, where they would clash.

    ``score`` is the share of the posterior mass of all words (those with a
    letter) on the predicted language; ``switches`` counts changes of label
    between neighbouring words. Null text or text without a letter gives
    ``und`` and 0. Repeated rows each give a row, a null doc_id stays null,
    other columns are ignored, an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)  # size fixed by BUCKETS
    own = T.StructType([
        T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("switches", T.LongType()), T.StructField("n_words", T.LongType())])
    names = docs.columns if carry else ["doc_id"]
    rows = docs.select(*[F.col(c).alias(f"c_{c}") for c in names],
                       *([] if carry else ["text"]))  # the text crosses once
    schema = T.StructType(rows.schema.fields[:len(names)] + own.fields)
    place = names.index("text") if carry else len(names)

    def run(batches):
        field = shared.value
        k = len(field.labels)
        memo = Emissions(field)

        def flush(others, texts):
            found, scores = memo.rows([t or "" for t in texts])
            rows = np.concatenate(found)
            owner = np.repeat(np.arange(len(texts)), [len(f) for f in found])
            owner, rows = owner[rows >= 0], rows[rows >= 0]
            sizes = np.bincount(owner, minlength=len(texts))
            n, docs = len(rows), len(texts)
            pred, score = ["und"] * docs, np.zeros(docs)
            changes = np.zeros(docs, dtype=np.int64)
            if n:
                e = scores[rows]
                begins = np.ones(n, bool)
                begins[1:] = owner[1:] != owner[:-1]
                gamma, _ = forward_backward(e, field.trans, field.start, begins)
                mass = np.stack([np.bincount(owner, gamma[:, c], minlength=docs)
                                 for c in range(k)], 1)
                top = gamma.argmax(1)
                moved = np.zeros(n, bool)
                moved[1:] = (top[1:] != top[:-1]) & ~begins[1:]
                changes = np.bincount(owner, moved, minlength=docs).astype(np.int64)
                for i in np.flatnonzero(sizes):
                    pred[i] = field.labels[int(mass[i].argmax())]
                    score[i] = mass[i].max() / sizes[i]
            return pa.RecordBatch.from_arrays(
                [*others, pa.array(pred, pa.string()), pa.array(score),
                 pa.array(changes), pa.array(sizes, pa.int64())], names=schema.names)

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                columns = batch.slice(at, SLICE).columns
                yield flush(columns[:len(names)], columns[place].to_pylist())

    found = rows.mapInArrow(tidy(run), schema)
    return found.select(*[F.col(f"c_{c}").alias(c) for c in names],
                        *[F.col(c).alias(prefix + c) for c in own.names
                          if prefix + c not in names])


def identify(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """Learn from ``docs`` and label ``docs``."""
    return predict(docs, learn(docs, per_language))
