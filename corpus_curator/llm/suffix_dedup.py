"""Removal of byte strings that repeat anywhere in the corpus, by sorting suffixes.

Every 200-byte string holds one *anchor*: of the k-grams inside it, the one
whose hash is smallest (the leftmost of equals). Equal strings have the same
anchor at the same place, so only suffixes that pass through anchors with a
repeated k-gram need sorting. Neighbouring strings with one anchor form a
*context* (their union). The steps:

1. count the k-grams of all anchors, with the contexts they occur in;
2. read the texts again and keep the contexts of repeated k-grams (a Bloom
   filter of fixed size names them; what it lets through by chance is harmless);
   equal contexts are one, and all strings of a context that occurs twice repeat;
3. deal the distinct contexts by range of their leading bytes (Spark samples the
   splitters) and sort, bucket by bucket, all strings of the contexts by
   multikey quicksort, eight bytes at a time: runs of equal strings repeat. The
   range key is the whole k-gram, so equal strings never lie on both sides of a
   boundary; k-grams with very many contexts are split by string instead;
4. mark the strings in their documents and cut the bytes they cover.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import mix64, saved, slices, text_bytes, tidy

LENGTH = 200
GRAM = 96
#: Bytes worked on at once in a task.
CHUNK = 1 << 18
#: Bits of the Bloom filters for each repeated k-gram, and at most in all.
BITS_PER_KEY, MAX_BITS = 16, 1 << 29
#: A k-gram with more distinct contexts than this is split by string.
HOT_CONTEXTS = 20_000
#: Bytes of contexts to a sorting task.
BUCKET_BYTES = 4 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = np.random.default_rng(20240).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(n, CHUNK).bit_length()
        both = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p))
        _POWERS[:] = both
    return _POWERS[0], _POWERS[1]


class Anchors:
    """Anchor runs of a buffer of texts put one after another.

    ``first``/``last``: first and last string start of each run; ``place``: its
    anchor; ``gram``/``context``: hashes of the anchor's k-gram and of the context.
    """

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.ends = np.cumsum(sizes)
        self.data = b"".join(texts)
        x = np.frombuffer(self.data, np.uint8)
        n = len(x)
        self.first = self.last = self.place = np.empty(0, np.int64)
        self.gram = self.context = np.empty(0, np.uint64)
        if n < LENGTH:
            return
        up, down = _powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[x] * up[:n], out=sums[1:])
        h = mix64((sums[GRAM:] - sums[:-GRAM]) * down[:n - GRAM + 1])
        low = np.uint64((1 << max(n.bit_length(), 26)) - 1)  # alike in all buffers
        key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        width, have = LENGTH - GRAM + 1, 1
        while have * 2 <= width:
            key = np.minimum(key[:-have], key[have:])
            have *= 2
        if have < width:
            gap = width - have
            key = np.minimum(key[:-gap], key[gap:])
        place = (key & low).astype(np.int64)
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
        good = np.flatnonzero(owner[:n - LENGTH + 1] == owner[LENGTH - 1:])
        if not len(good):
            return
        place = place[good]
        new = np.concatenate([[True], (place[1:] != place[:-1])])
        self.first, self.place = good[new], place[new]
        self.last = good[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(good) - 1]])]
        self.owner = owner[self.first]
        self.gram = h[self.place]
        stop = self.last + LENGTH
        whole = (sums[stop] - sums[self.first]) * down[self.first]
        shape = ((stop - self.first) * 1024 + (self.place - self.first)).astype(np.uint64)
        self.context = mix64(whole ^ mix64(shape))


def _buffers(sizes: list[int]):
    """Index ranges of texts that together have about CHUNK bytes."""
    at = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > CHUNK:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)


def _signed(a: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(a).view(np.int64)


def _counts(batches):
    for (texts,) in slices(batches, 256):
        for a, b in _buffers([len(t) for t in texts]):
            found = Anchors(texts[a:b])
            gram, context = _signed(found.gram), _signed(found.context)  # ordered as in Spark
            order = np.lexsort((context, gram))
            gram, context = gram[order], context[order]
            if not len(gram):
                continue
            start = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
            end = np.concatenate([start[1:], [len(gram)]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram[start]), pa.array(end - start),
                 pa.array(context[start]), pa.array(context[end - 1])],
                names=["gram", "n", "low", "high"])


def _bloom(keys: DataFrame, bits: int) -> np.ndarray:
    """One bit per key hash, or-ed together over the partitions in a tree; its
    size is fixed by ``bits`` whatever the number of keys."""
    def part(batches):
        out = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            at = batch.column(0).to_numpy() & (bits - 1)
            np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
        if out.any():
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())],
                                             names=["bits"])

    found = keys.mapInArrow(part, "bits binary").rdd.map(
        lambda r: np.frombuffer(r[0], np.uint8))
    return found.treeAggregate(np.zeros(bits // 8, np.uint8), np.bitwise_or, np.bitwise_or, 2)


def _hits(bloom: np.ndarray, gram: np.ndarray) -> np.ndarray:
    at = gram & np.uint64(len(bloom) * 8 - 1)
    return (bloom[(at >> np.uint64(3)).astype(np.int64)]
            >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _sort_strings(data: bytes, starts: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which of the strings of LENGTH bytes at ``starts`` equal another one of
    their ``group``: multikey quicksort, whose characters are eight bytes. Each
    level sorts what is still tied by the next character; strings that are alone
    drop out, and what is tied after the last level is equal."""
    x = np.frombuffer(data + b"\0" * 8, np.uint8)
    n = len(x) - 8
    words = np.zeros(n, np.uint64)
    for j in range(8):
        words = (words << np.uint64(8)) | x[j:j + n]
    tied, mark = np.arange(len(starts)), np.zeros(len(starts), bool)
    for depth in range(-1, LENGTH // 8):
        if not len(tied):
            return mark
        if depth < 0:
            order = np.argsort(group[tied], kind="quicksort")
            tied = tied[order]
            level = group[tied]
            new = np.concatenate([[True], level[1:] != level[:-1]])
        else:
            word = words[starts[tied] + 8 * depth]
            order = np.lexsort((word, run))
            tied, word, run = tied[order], word[order], run[order]
            new = np.concatenate([[True], (run[1:] != run[:-1]) | (word[1:] != word[:-1])])
        run = np.cumsum(new)
        several = np.bincount(run)[run] > 1
        tied, run = tied[several], run[several]
    mark[tied] = True
    return mark


def _sorted_buckets(batches):
    """Contexts sorted by k-gram in; for every context that occurs once, the mask
    of its strings that also stand in another context."""
    def flush(rows):
        lengths = np.array([len(r[4]) for r in rows], dtype=np.int64)
        offset = np.cumsum(lengths) - lengths
        strings = lengths - LENGTH + 1
        owner = np.repeat(np.arange(len(rows)), strings)
        inner = np.arange(int(strings.sum())) - np.repeat(np.cumsum(strings) - strings, strings)
        _, gram = np.unique([r[0] for r in rows], return_inverse=True)
        place = np.array([r[3] for r in rows], dtype=np.int64)
        # strings can only be equal with the anchor at the same distance
        group = gram[owner] * 1024 + (place[owner] - inner + LENGTH)
        mark = _sort_strings(b"".join(r[4] for r in rows), offset[owner] + inner, group)
        out = []
        for i, r in enumerate(rows):
            lo = int((np.cumsum(strings) - strings)[i]) if i == 0 else hi
            hi = lo + int(strings[i])
            if r[2] == 1 and mark[lo:hi].any():
                out.append((r[0], r[1], np.packbits(mark[lo:hi]).tobytes()))
        return out

    def batch(out):
        return pa.RecordBatch.from_arrays(
            [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()),
             pa.array([o[2] for o in out], pa.binary())], names=["gram", "context", "mask"])

    rows, held = [], 0
    for gram, context, n, place, text in slices(batches):
        for row in zip(gram, context, n, place, text):
            if held >= CHUNK and rows[-1][0] != row[0]:
                yield batch(flush(rows))
                rows, held = [], 0
            rows.append(row)
            held += len(row[4])
    if rows:
        yield batch(flush(rows))


def _split_strings(batches):
    """Strings of contexts of a hot k-gram, one row each: distance and 128-bit hash."""
    import xxhash

    for gram, context, n, place, text in slices(batches, 128):
        out = []
        for g, c, k, p, t in zip(gram, context, n, place, text):
            for i in range(len(t) - LENGTH + 1):
                out.append((g, c, k, i, p - i, xxhash.xxh3_128_digest(t[i:i + LENGTH]),
                            len(t) - LENGTH + 1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(col), t) for col, t in zip(zip(*out), (
                pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(),
                pa.int32()))], names=["gram", "context", "n", "at", "distance", "hash", "strings"])


def _cut(text: bytes, spans: list[tuple[int, int, bytes | None]]) -> tuple[bytes, int]:
    """Text without the bytes of the marked strings, and the number of runs cut.
    A span: first string, strings, mask (None: all)."""
    edge = np.zeros(len(text) + 1, np.int32)
    for first, strings, mask in spans:
        if mask is None:
            edge[first] += 1
            edge[first + strings - 1 + LENGTH] -= 1
        else:
            bits = np.unpackbits(np.frombuffer(mask, np.uint8), count=strings)
            at = first + np.flatnonzero(bits)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + LENGTH, -1)
    gone = np.cumsum(edge[:-1]) > 0
    runs = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1))
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), runs


def remove_repeats(docs: DataFrame, carry: tuple[str, ...] = (),
                   with_text: bool = False, prefix: str = "") -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``,
    the columns named in ``carry`` and, with ``with_text``, ``kept`` (bytes left).
    ``prefix`` is put before the names of the result (not ``doc_id``, not carried ones),
    where they would clash.

    A byte goes if it lies in a string of 200 bytes that also starts elsewhere in
    the same or another document, as judged on the input. Null text counts as
    empty; shorter texts lose nothing. Repeated rows are documents of their own
    (their texts repeat). Ids play no part, so null or equal ids do no harm;
    columns not named are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    grams = saved(docs.select(text_bytes()).mapInArrow(
        tidy(_counts), "gram bigint, n bigint, low bigint, high bigint")
        .groupBy("gram").agg(F.sum("n").alias("n"), F.min("low").alias("low"),
                             F.max("high").alias("high")).filter("n > 1")
        .select("gram", (F.col("low") == F.col("high")).alias("same")), "repeat-grams")
    keys = max(1, grams.count())
    bits = min(MAX_BITS, 1 << (BITS_PER_KEY * keys).bit_length())
    repeated = spark.sparkContext.broadcast(_bloom(grams.select("gram"), bits))
    mixed = spark.sparkContext.broadcast(_bloom(grams.filter("not same").select("gram"), bits))

    types = {f.name: f.dataType for f in docs.schema.fields}
    schema = T.StructType(
        [T.StructField(f"c_{c}", types[c]) for c in carry]
        + [T.StructField("row", T.LongType()), T.StructField("doc_id", T.LongType()),
           T.StructField("text", T.BinaryType()), T.StructField("n_bytes", T.LongType()),
           T.StructField("sha", T.StringType()), T.StructField("hit", T.BooleanType()),
           T.StructField("runs", T.ArrayType(T.StructType([
               T.StructField("gram", T.LongType()), T.StructField("context", T.LongType()),
               T.StructField("first", T.IntegerType()), T.StructField("strings", T.IntegerType()),
               T.StructField("place", T.IntegerType()),
               T.StructField("bytes", T.BinaryType())])))])
    run_type = pa.list_(pa.struct([
        ("gram", pa.int64()), ("context", pa.int64()), ("first", pa.int32()),
        ("strings", pa.int32()), ("place", pa.int32()), ("bytes", pa.binary())]))

    def collect(batches):
        every, some = repeated.value, mixed.value
        for batch in batches:
            # about CHUNK bytes at once: they become Python objects and go back with them
            step = max(1, min(256, batch.num_rows * CHUNK // max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                *extra, rows, ids, column = part.columns
                texts = column.to_pylist()
                lists: list[list] = [[] for _ in texts]
                for a, b in _buffers([len(t) for t in texts]):
                    found = Anchors(texts[a:b])
                    begin = np.concatenate([[0], found.ends])
                    seen = set()
                    hit = np.flatnonzero(_hits(every, found.gram)) if len(found.gram) else ()
                    both = _hits(some, found.gram[hit]) if len(hit) else ()
                    for k, differ in zip(hit, both):
                        d = int(found.owner[k])
                        lo, hi = int(found.first[k]), int(found.last[k])
                        g, c = int(found.gram[k].view(np.int64)), int(
                            found.context[k].view(np.int64))
                        text = None
                        if differ and (g, c) not in seen:  # an equal one would say the same
                            seen.add((g, c))
                            text = found.data[lo:hi + LENGTH]
                        lists[a + d].append({
                            "gram": g, "context": c, "first": lo - int(begin[d]),
                            "strings": hi - lo + 1, "place": int(found.place[k]) - lo,
                            "bytes": text})
                keep = [with_text or bool(r) for r in lists]
                yield pa.RecordBatch.from_arrays(
                    [*extra, rows, ids,
                     pa.array([t if k else None for t, k in zip(texts, keep)], pa.binary()),
                     pa.array([len(t) for t in texts], pa.int64()),
                     pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                     pa.array([bool(r) for r in lists], pa.bool_()),
                     pa.array(lists, run_type)], names=schema.names)

    marked = saved(docs.select(*[F.col(c).alias(f"c_{c}") for c in carry],
                               F.monotonically_increasing_id().alias("row"),
                               F.col("doc_id").cast("bigint"), text_bytes())
                   .mapInArrow(tidy(collect), schema), "repeat-runs")

    runs = marked.filter("hit").select("row", F.inline("runs"))
    contexts = saved(runs.groupBy("gram", "context").agg(
        F.count("*").alias("n"), F.first("place").alias("place"),
        F.max("bytes").alias("bytes")), "repeat-contexts")
    told = contexts.filter("bytes is not null")
    per_gram = told.groupBy("gram").agg(F.count("*").alias("contexts"),
                                        F.min("n").alias("least"))
    # k-grams with a context that occurs once, next to others, need sorting
    open_grams = per_gram.filter("contexts > 1 and least = 1")
    todo = saved(told.join(open_grams, "gram").select(
        "gram", "context", "n", "place", "bytes", "contexts"), "repeat-open")
    size = todo.filter(F.col("contexts") <= HOT_CONTEXTS).agg(
        F.sum(F.length("bytes"))).first()[0] or 0
    columns = ["gram", "context", "n", "place", "bytes"]
    leading = F.expr(f"substring(bytes, place + 1, {GRAM})")
    sorted_ = (todo.filter(F.col("contexts") <= HOT_CONTEXTS).select(*columns)
               .repartitionByRange(max(1, -(-size // BUCKET_BYTES)), leading)
               .sortWithinPartitions(leading, "gram")
               .mapInArrow(_sorted_buckets, "gram bigint, context bigint, mask binary"))
    strings = (todo.filter(F.col("contexts") > HOT_CONTEXTS).select(*columns)
               .mapInArrow(_split_strings, "gram bigint, context bigint, n bigint, at int, "
                                           "distance int, hash binary, strings int"))
    twice = strings.groupBy("gram", "distance", "hash").agg(
        F.count("*").alias("k")).filter("k > 1")
    split = (strings.filter("n = 1").join(twice, ["gram", "distance", "hash"], "left_semi")
             .groupBy("gram", "context").agg(F.collect_set("at").alias("at"),
                                             F.max("strings").alias("strings")))

    @F.pandas_udf("binary")
    def pack(at, strings):
        import pandas as pd

        out = []
        for places, n in zip(at, strings):
            bits = np.zeros(n, bool)
            bits[np.asarray(places)] = True
            out.append(np.packbits(bits).tobytes())
        return pd.Series(out)

    masks = sorted_.unionByName(split.select(
        "gram", "context", pack("at", "strings").alias("mask")))
    known = (contexts.filter("n > 1").select("gram", "context",
                                             F.lit(None).cast("binary").alias("mask"))
             .unionByName(masks))
    spans = (runs.select("row", "gram", "context", "first", "strings")
             .join(known, ["gram", "context"])
             .groupBy("row").agg(F.collect_list(F.struct("first", "strings", "mask"))
                                 .alias("spans")))

    names = [f"c_{c}" for c in carry]
    body = marked.select(*names, "row", "doc_id", "text", "n_bytes", "sha", "hit")
    touched = (body.filter("hit").join(spans, "row", "left")
               .select(*names, "doc_id", "text", "n_bytes", "sha", "spans"))
    final = T.StructType(
        [T.StructField(n, types[c]) for n, c in zip(names, carry)]
        + [T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()),
           T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
           T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.BinaryType())])

    def cut(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                *extra, ids, column, n_bytes, sha, spans = batch.slice(at, 256).columns
                out = []
                for text, digest, where in zip(column.to_pylist(), sha.to_pylist(),
                                               spans.to_pylist()):
                    if not where:
                        out.append((0, 0, digest, text))
                        continue
                    kept, n = _cut(text, [(s["first"], s["strings"], s["mask"])
                                          for s in where])
                    out.append((len(text) - len(kept), n, hashlib.sha256(kept).hexdigest(), kept))
                yield pa.RecordBatch.from_arrays(
                    [*extra, ids, n_bytes, pa.array([o[0] for o in out], pa.int64()),
                     pa.array([o[1] for o in out], pa.int64()),
                     pa.array([o[2] for o in out], pa.string()),
                     pa.array([o[3] if with_text else None for o in out], pa.binary())],
                    names=final.names)

    rest = body.filter("not hit").select(
        *names, "doc_id", "n_bytes", F.lit(0).cast("bigint").alias("n_removed"),
        F.lit(0).cast("bigint").alias("n_spans"), F.col("sha").alias("kept_sha256"),
        F.col("text").alias("kept"))
    out = touched.mapInArrow(tidy(cut), final).unionByName(rest)
    named = [F.col(n).alias(c) for n, c in zip(names, carry) if c != "doc_id"]
    result = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])]
    return out.select("doc_id", *named, *[F.col(c).alias(prefix + c) for c in result])
