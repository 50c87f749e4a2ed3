"""Stupid-backoff scores of whole texts against the n-gram counts of the corpus.

Relationally: explode the n-grams of every document, count them, join the counts
back, sum per document. The relations are kept in compressed columns so that a
shuffle moves a few bytes per distinct n-gram: documents are grouped in blocks;
a block's n-grams of all orders (the order is part of the hash) are one sorted
column of distinct hashes with their counts, dealt by range of the hash to
buckets; a bucket adds up the columns of all blocks and answers each block with
the totals of its own n-grams, in order; the block joins them to its texts.

The hash is as wide as the corpus needs: at most about one n-gram in 65,000 shares
its hash with another one, whatever the size. The n-gram of order zero carries the
number of words. Repeated n-grams reach a bucket once per block, so no n-gram,
however frequent, makes a bucket large.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import WordHashes, mix64, text_bytes

ORDER = 3
BACKOFF = 0.4
#: Bytes of text to a block, and to the n-grams of a bucket.
BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20
#: Bits of a hash at least, and beyond the bits that number the n-grams: one
#: n-gram in two to the power of the latter may share its hash with another.
LEAST_BITS, COLLISION_BITS = 48, 16


def gram_hashes(texts: list[bytes], order: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and a matrix (order, words): the hash of the n-gram of
    each order that ends in a word; 0 where the text begins too late for it."""
    split = [t.lower().split() for t in texts]
    sizes = np.array([len(w) for w in split], dtype=np.int64)
    words = WordHashes()([w for ws in split for w in ws])
    place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.zeros((order, len(words)), np.uint64)
    chain = np.zeros(len(words), np.uint64)
    for n in range(order):
        back = np.zeros(len(words), np.uint64)
        back[n:] = words[:len(words) - n]
        chain = mix64(chain * np.uint64(3) + back + np.uint64(n + 1))
        h = chain >> np.uint64(64 - bits)
        out[n] = np.where(place >= n, np.maximum(h, 1), 0)
    return sizes, out


def _widths(sorted_hashes: np.ndarray) -> tuple[int, bytes]:
    """Differences of a sorted column in as few bytes as the largest needs."""
    gaps = np.diff(sorted_hashes, prepend=np.uint64(0))
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8)
    return width, gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _column(width: int, data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, width)
    full = np.zeros((len(raw), 8), np.uint8)
    full[:, :width] = raw
    return np.cumsum(full.view("<u8").reshape(-1))


def _numbers(a: np.ndarray) -> bytes:
    """Positive numbers as planes of bytes; most are small, so most planes are empty."""
    width = max(1, (int(a.max()).bit_length() + 7) // 8)
    return bytes([width]) + a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _read_numbers(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1)
    full = np.zeros((planes.shape[1], 8), np.uint8)
    full[:, :width] = planes.T
    return full.view("<i8").reshape(-1)


def _distinct(table, order: int, bits: int):
    sizes, grams = gram_hashes(table.column("text").to_pylist(), order, bits)
    every, place, counts = np.unique(np.append(grams.ravel(), np.uint64(0)),
                                     return_inverse=True, return_counts=True)
    counts[0] = grams.shape[1]  # order zero
    return sizes, grams, every, place[:-1].reshape(grams.shape), counts


def _explode(order: int, bits: int, bucket_bits: int):
    def run(key, table):
        _, _, every, _, counts = _distinct(table, order, bits)
        bucket = (every >> np.uint64(bits - bucket_bits)).astype(np.int64)
        cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(every))
        rows = []
        for a, b in zip(cuts, cuts[1:]):
            base = bucket[a] << (bits - bucket_bits)
            width, data = _widths(every[a:b] - np.uint64(base))
            rows.append((key[0].as_py(), int(bucket[a]), width, data, _numbers(counts[a:b])))
        return pa.table({n: pa.array(c, t) for n, c, t in zip(
            ("block", "bucket", "width", "hashes", "counts"), zip(*rows),
            (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))})

    return run


def _total(key, table):
    blocks = table.column("block").to_pylist()
    columns = [_column(w, d) for w, d in zip(table.column("width").to_pylist(),
                                             table.column("hashes").to_pylist())]
    counts = np.concatenate([_read_numbers(c) for c in table.column("counts").to_pylist()])
    _, place = np.unique(np.concatenate(columns), return_inverse=True)
    totals = np.bincount(place, counts).astype(np.int64)[place]
    ends = np.cumsum([len(c) for c in columns])
    return pa.table({
        "block": pa.array(blocks, pa.int64()),
        "bucket": pa.array([key[0].as_py()] * len(blocks), pa.int64()),
        "totals": pa.array([_numbers(totals[e - len(c):e]) for c, e in zip(columns, ends)],
                           pa.binary())})


def backoff(counts: np.ndarray, words: int, alpha: float = BACKOFF) -> np.ndarray:
    """Log scores of words. ``counts`` (2, order, words): of the n-gram of each
    order that ends in the word, and of its context (the n-gram without the word;
    order one: all words), both without this very occurrence; 0: not seen."""
    gram, context = counts
    order = len(gram)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = (order - 1) * np.log(alpha) + np.log(np.maximum(gram[0], 0.5) / max(words - 1, 1))
        for n in range(1, order):
            found = gram[n] > 0
            value = (order - 1 - n) * np.log(alpha) + np.log(gram[n] / context[n])
            out = np.where(found, value, out)
    return out


def _score(order: int, bits: int, alpha: float):
    def run(key, docs, totals):
        ids = docs.column("doc_id").to_pylist()
        if not ids:
            return pa.table({"doc_id": pa.array([], pa.int64()),
                             "n_words": pa.array([], pa.int64()),
                             "log_score": pa.array([], pa.float64())})
        sizes, grams, _, place, _ = _distinct(docs, order, bits)
        by = np.argsort(np.asarray(totals.column("bucket")))
        data = totals.column("totals").to_pylist()
        total = np.concatenate([_read_numbers(data[i]) for i in by])
        n = grams.shape[1]
        log = np.zeros(len(ids))
        if n:
            seen = np.where(grams > 0, total[place] - 1, 0)
            context = np.zeros_like(seen)
            # the context of an n-gram is the shorter one that ends a word earlier
            context[1:, 1:] = seen[:-1, :-1]
            start = np.cumsum(sizes) - sizes
            value = backoff(np.stack([seen, context]), int(total[0]), alpha)
            # an order that a word's place does not allow costs nothing
            owner = np.repeat(np.arange(len(ids)), sizes)
            short = order - 1 - np.minimum(np.arange(n) - start[owner], order - 1)
            log = np.bincount(owner, value - short * np.log(alpha), minlength=len(ids))
        return pa.table({"doc_id": pa.array(ids, pa.int64()),
                         "n_words": pa.array(sizes, pa.int64()),
                         "log_score": pa.array(log, pa.float64())})

    return run


def score(docs: DataFrame, order: int = ORDER, alpha: float = BACKOFF,
          block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``doc_id, n_words, log_score`` of every document: the sum over its words
    (runs without white space, A-Z in lower case) of the log stupid-backoff score.

    A word's n-gram counts over the whole corpus, without the occurrence that is
    scored: the longest n-gram seen elsewhere gives count / count of its context,
    times ``alpha`` for each order given up; a word seen nowhere else counts half.
    Near the start of a text the longest n-gram that fits counts as the full order.
    Null or empty texts have no words and score 0; repeated rows are documents of
    their own (their n-grams occur again); null ids stay null; other columns are
    ignored; an empty table gives an empty result.
    """
    size = docs.select(F.sum(F.length(text_bytes()))).first()[0] or 0
    bits = min(62, max(LEAST_BITS, (size * order).bit_length() + COLLISION_BITS))
    bucket_bits = max(1, (size // bucket_bytes).bit_length())
    blocks = max(1, -(-size // block_bytes))
    dealt = docs.select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("bigint").alias("block"),
        "doc_id", text_bytes())
    grams = dealt.groupBy("block").applyInArrow(
        _explode(order, bits, bucket_bits),
        "block bigint, bucket bigint, width int, hashes binary, counts binary")
    totals = grams.groupBy("bucket").applyInArrow(
        _total, "block bigint, bucket bigint, totals binary").toDF("t_block", "bucket", "totals")
    return dealt.groupBy("block").cogroup(totals.groupBy("t_block")).applyInArrow(
        _score(order, bits, alpha), "doc_id bigint, n_words bigint, log_score double")
