"""Benchmark decontamination: short test items inside long documents.

Items are partitioned by the size of their shingle set; the items of a
partition keep a bottom-k MinHash sketch whose k follows from the partition's
largest size: with k above the number of shingles an item may lack at the
threshold, every document that contains enough of the item holds at least one
value of its sketch, however long the document is. Documents are probed
shingle by shingle (a Bloom filter of fixed size drops what no item has), the
hits are joined to the sketches, and each candidate's exact containment is
computed from the full shingle sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import (WordHashes, WORD_BYTES, bloom, bloom_bits, bloom_hits, numbered, saved, shingle_hashes, slices, text_bytes, tidy)

SHINGLE = 5
#: A document contains an item when it has this share of the item's shingles.
CONTAINMENT_PERCENT = 80


def _shingles(text: bytes, width: int, hashes: WordHashes) -> np.ndarray:
    words = text.translate(WORD_BYTES).split()
    return shingle_hashes(hashes(words), width) if len(words) >= width else np.empty(
        0, np.uint64)


def sketch_size(n: int, percent: int) -> int:
    """k of the size partition of ``n`` shingles (partitions double: ..8, ..16, ..32)."""
    upper = max(8, 1 << (n - 1).bit_length())
    return upper * (100 - percent) // 100 + 1


def item_shingles(benchmark: DataFrame, percent: int = CONTAINMENT_PERCENT) -> DataFrame:
    """``item_id, width, shingles, sketch`` of every item with words; an item of
    fewer than five words is one shingle of that width. Items with the same id
    stay apart by ``item`` (their own hash)."""
    def run(batches):
        hashes = WordHashes()
        for ids, texts in slices(batches):
            rows = []
            for item, text in zip(ids, texts):
                width = min(SHINGLE, len(text.translate(WORD_BYTES).split()))
                if width:
                    s = np.unique(_shingles(text, width, hashes))  # hashes: their order is random
                    rows.append((item, width, s.view(np.int64).tolist(),
                                 s[:sketch_size(len(s), percent)].view(np.int64).tolist()))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (
                        pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())))],
                    names=["item_id", "width", "shingles", "sketch"])

    found = benchmark.select("item_id", text_bytes()).mapInArrow(
        run, "item_id bigint, width int, shingles array<bigint>, sketch array<bigint>")
    return found.withColumn("item", F.xxhash64("item_id", "shingles")).dropDuplicates(["item"])


def find_items(docs: DataFrame, benchmark: DataFrame,
               percent: int = CONTAINMENT_PERCENT, number: str | None = None) -> DataFrame:
    """One row per document and item it contains: ``doc_id, item_id, n_shingles``
    (of the item), ``matched, containment``.

    Null or empty texts contain nothing and null or empty items are contained
    nowhere; repeated documents each give their rows, repeated items count once;
    null ids stay null; other columns are ignored; empty tables give an empty
    result. Texts are read whole. ``number`` names a column that numbers the rows
    of ``docs``; the result then has it as ``row``.
    """
    items = saved(item_shingles(benchmark, percent), "bench-items")
    probes = items.select(F.explode("shingles").alias("hash"))
    widths = [r[0] for r in items.select("width").distinct().collect()]  # at most five
    bits = bloom_bits(probes.count())
    shared = docs.sparkSession.sparkContext.broadcast(bloom(probes, bits))

    def probe(batches):
        known, hashes = shared.value, WordHashes()
        for rows, ids, texts in slices(batches):
            out = []
            for row, doc_id, text in zip(rows, ids, texts):
                hits = [s[bloom_hits(known, s)] for s in (_shingles(text, w, hashes) for w in widths)]
                hits = np.unique(np.concatenate(hits)) if hits else ()
                if len(hits):
                    out.append((row, doc_id, hits.view(np.int64).tolist()))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (
                        pa.int64(), pa.int64(), pa.list_(pa.int64())))],
                    names=["row", "doc_id", "hits"])

    found = saved(docs.select((F.col(number) if number else F.monotonically_increasing_id())
                              .alias("row"), "doc_id",
                              text_bytes())
                  .mapInArrow(tidy(probe), "row bigint, doc_id bigint, hits array<bigint>"),
                  "bench-hits")
    sketches = items.select("item", F.explode("sketch").alias("hash"))
    pairs = (found.select("row", F.explode("hits").alias("hash")).join(sketches, "hash")
             .select("row", "item").distinct())
    matched = F.size(F.array_intersect("shingles", "hits"))
    return (pairs.join(items.select("item", "item_id", "shingles"), "item")
            .join(found, "row")
            .select(*(["row"] if number else []), "doc_id", "item_id", F.size("shingles").cast("bigint").alias("n_shingles"),
                    matched.cast("bigint").alias("matched"))
            .filter(F.col("matched") * 100 >= F.col("n_shingles") * percent)
            .withColumn("containment", F.col("matched") / F.col("n_shingles")))


def decontaminate(docs: DataFrame, benchmark: DataFrame,
                  percent: int = CONTAINMENT_PERCENT, by_row: bool = False) -> DataFrame:
    """``docs`` without the documents that contain an item; rows with a null id
    cannot be named and stay. With ``by_row`` exactly the rows that contain an
    item go, whatever their id."""
    if not by_row:
        hit = saved(find_items(docs, benchmark, percent).select("doc_id").distinct(),
                    "bench-drop")
        return docs.join(hit.filter("doc_id is not null"), "doc_id",
                         "left_anti").select(*docs.columns)
    rows, row = numbered(docs, "bench-rows")
    hit = saved(find_items(rows, benchmark, percent, row).select(F.col("row").alias(row))
                .distinct(), "bench-drop")
    return rows.join(hit, row, "left_anti").select(*docs.columns)
