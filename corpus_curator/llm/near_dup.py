"""MinHash near-duplicates with HyperMinHash registers.

The hash space of a document's shingles is dealt into buckets; of each bucket's
smallest hash a register keeps the count of leading zeros and a few mantissa
bits. Bands of these compressed registers bring likely pairs together; inside a
band the collision-corrected estimate of the Jaccard similarity prunes pairs
that cannot reach the threshold; what is left forms candidate components, in
which exact similarities of the full shingle sets confirm the links.

Documents with equal sets are one class from the start. No group reaches a task
whole: bands and candidate components are dealt in pairs of blocks
(``tables.block_pairs``), and a block pair gives at most one row per member.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .tables import (WordHashes, block_pairs, mix64, saved, shingle_hashes, slices, text_bytes,
                     tidy)

SHINGLE = 5
#: Link when PERCENT * union <= 100 * intersection.
PERCENT = 85
REGISTERS = 256
MANTISSA = 10
#: A pair at the threshold may be missed with this probability.
MISS = 4e-9
#: Standard errors by which an estimate may fall short of the threshold.
ERRORS = 5.0
BAND_BLOCK = 1024
EXACT_BLOCK = 256


def layout(percent: int) -> list[np.ndarray]:
    """Registers of each band: the fewest bands that miss a pair at the threshold
    with a probability of at most MISS (42 bands at 85, 51 at 80)."""
    for bands in range(1, REGISTERS + 1):
        out = np.array_split(np.arange(REGISTERS), bands)
        if np.prod([1 - (percent / 100) ** len(places) for places in out]) <= MISS:
            break
    return out


def registers(shingles: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of a shingle set: 0 for an empty bucket, else
    (leading zeros + 1) * 2**MANTISSA + the bits after the leading one."""
    out = np.zeros(REGISTERS, np.uint16)
    if not len(shingles):
        return out
    h = np.sort(mix64(shingles ^ np.uint64(0x5851F42D4C957F2D)))
    bucket = (h >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    low = (h[first] >> np.uint64(4)) & np.uint64((1 << 52) - 1)
    zeros = 52 - np.frexp(low.astype(np.float64))[1]
    after = (low << np.minimum(zeros + 1, 52).astype(np.uint64)) & np.uint64((1 << 52) - 1)
    out[bucket[first]] = (((zeros + 1) << MANTISSA)
                          + (after >> np.uint64(52 - MANTISSA)).astype(np.int64)).astype(np.uint16)
    return out


def band_keys(regs: np.ndarray, percent: int = PERCENT) -> list[int]:
    """64-bit keys of the bands that have a filled register."""
    keys = []
    for band, places in enumerate(layout(percent)):
        part = regs[places]
        if part.any():
            h = np.uint64(band + 1)
            for r in part:
                h = mix64((h ^ np.uint64(r)) + np.uint64(0x9E3779B97F4A7C15))
            keys.append(int(h))
    return keys


def _band_matrix(regs: np.ndarray, bands: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Keys (documents, bands) and which of them count."""
    keys = np.empty((len(regs), len(bands)), np.uint64)
    full = np.empty((len(regs), len(bands)), bool)
    for band, places in enumerate(bands):
        h = np.full(len(regs), band + 1, np.uint64)
        for p in places:
            h = mix64((h ^ regs[:, p].astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15))
        keys[:, band], full[:, band] = h, regs[:, places].any(1)
    return keys, full


def estimate(one: np.ndarray, many: np.ndarray, n_one: int, n_many: np.ndarray):
    """Collision-corrected Jaccard estimates of one register row against many,
    and the number of registers that either fills."""
    filled = ((one > 0) | (many > 0)).sum(1)
    same = ((one == many) & (one > 0)).sum(1)
    ratio = np.maximum(n_one, n_many) / np.maximum(np.minimum(n_one, n_many), 1)
    chance = 0.1699194871597391 * 4 * ratio / (1 + ratio) ** 2 * REGISTERS / 2 ** MANTISSA
    chance = np.minimum(chance, filled / 2 ** MANTISSA)
    return (same - chance) / np.maximum(filled, 1), filled


def _sketch(texts: list[bytes], hashes: WordHashes):
    for text in texts:
        yield np.unique(shingle_hashes(hashes(text.lower().split()), SHINGLE))


def _node(shingles: np.ndarray) -> bytes:
    import xxhash
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else b""


def sketches(docs: DataFrame, row: str | None = None) -> DataFrame:
    """``doc_id, n_shingles, node`` (hash of the set) and ``regs`` of every
    document, and the number ``row`` if there is one."""
    names = ["doc_id", row] if row else ["doc_id"]

    def run(batches):
        hashes = WordHashes()
        for *ids, texts in slices(batches):
            sets = list(_sketch(texts, hashes))
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(c, pa.int64()) for c in ids],
                 pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([_node(s) for s in sets], pa.binary()),
                 pa.array([registers(s).tobytes() for s in sets], pa.binary())],
                names=[*names, "n_shingles", "node", "regs"])

    return docs.select(*names, text_bytes()).mapInArrow(
        tidy(run), ", ".join(f"{c} bigint" for c in names)
        + ", n_shingles bigint, node binary, regs binary")


def _forest(n: int, rows, linked) -> np.ndarray:
    """Smallest member index each of ``n`` members is connected to. ``rows`` are
    the indices to start from; ``linked(i, open)`` gives the partners of ``i``
    among the indices ``open``, which are not connected with it yet."""
    label = np.arange(n)
    for i in rows:
        apart = np.flatnonzero(label != label[i])
        if not len(apart):
            break
        partners = linked(i, apart)
        if len(partners):
            joined = np.unique(np.append(label[partners], label[i]))
            label[np.isin(label, joined)] = joined[0]
    return label


def _edges(nodes: list[bytes], label: np.ndarray) -> pa.Table:
    moved = np.flatnonzero(label != np.arange(len(label)))
    return pa.table({"a": pa.array([nodes[label[i]] for i in moved], pa.binary()),
                     "b": pa.array([nodes[i] for i in moved], pa.binary())})


def _could_reach(n_one: int, n_many: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(n_one, n_many) >= percent * np.maximum(n_one, n_many)


def _candidates(percent: int):
    level = percent / 100

    def run(key, table):
        side = np.array(table.column("side").to_pylist())
        nodes, sizes = table.column("node").to_pylist(), np.array(table.column("n_shingles"))
        regs = np.frombuffer(b"".join(table.column("regs").to_pylist()), np.uint16)
        regs = regs.reshape(-1, REGISTERS)

        def linked(i, apart):
            if side[i] != 2:
                apart = apart[side[apart] != side[i]]
            apart = apart[_could_reach(sizes[i], sizes[apart], percent)]
            if not len(apart):
                return apart
            got, filled = estimate(regs[i], regs[apart], sizes[i], sizes[apart])
            slack = ERRORS * np.sqrt(level * (1 - level) / np.maximum(filled, 1))
            return apart[got + slack >= level]

        rows = np.flatnonzero(side != 1)
        return _edges(nodes, _forest(len(nodes), rows, linked))

    return run


def _confirmed(percent: int):
    def run(key, table):
        side = np.array(table.column("side").to_pylist())
        nodes = table.column("node").to_pylist()
        sets = [np.frombuffer(b, np.uint64) for b in table.column("shingles").to_pylist()]
        sizes = np.array([len(s) for s in sets])
        _, codes = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        codes = codes.astype(np.int32)
        seen = np.zeros(int(codes.max()) + 1, bool)

        def linked(i, apart):
            if side[i] != 2:
                apart = apart[side[apart] != side[i]]
            apart = apart[_could_reach(sizes[i], sizes[apart], percent)]
            if not len(apart):
                return apart
            own = codes[starts[i]:ends[i]]
            seen[own] = True
            if len(apart) > len(sizes) // 4:
                common = np.add.reduceat(seen[codes].astype(np.int32), starts)[apart]
            else:
                common = np.array([np.count_nonzero(seen[codes[starts[j]:ends[j]]])
                                   for j in apart])
            seen[own] = False
            return apart[100 * common >= percent * (sizes[i] + sizes[apart] - common)]

        rows = np.flatnonzero(side != 1)
        return _edges(nodes, _forest(len(nodes), rows, linked))

    return run


def link(docs: DataFrame, percent: int = PERCENT, band_block: int = BAND_BLOCK,
         exact_block: int = EXACT_BLOCK, row: str | None = None) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Empty or null texts have no shingles and are linked with nothing. Rows that
    repeat a doc_id are documents of their own with the same id. A row with a
    null doc_id takes no part: its component is null and it is kept. Other
    columns are ignored; an empty table gives an empty result.

    ``row`` names a column that numbers the rows (no number twice, none null).
    With it every row takes part, of a component one row is kept, the one of the
    smallest doc_id (null after all others) and number, and the result holds
    ``row`` too.
    """
    sketch = saved(sketches(docs, row), "near-sketch")
    name, known = F.col("doc_id"), "n_shingles > 0 and doc_id is not null"
    if row:
        name, known = F.struct(name.isNull().alias("unnamed"), name, F.col(row)), "n_shingles > 0"
    classes = saved(sketch.filter(known).groupBy("node")
                    .agg(F.min(name).alias("rep"), F.first("n_shingles").alias("n_shingles"),
                         F.first("regs").alias("regs")), "near-classes")

    places = layout(percent)

    def keys(batches):
        for nodes, regs in slices(batches):
            matrix = np.frombuffer(b"".join(regs), np.uint16).reshape(-1, REGISTERS)
            key, full = _band_matrix(matrix, places)
            which = np.nonzero(full)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[which].view(np.int64)),
                 pa.array(nodes, pa.binary()).take(pa.array(which[0]))], names=["key", "node"])

    bands = classes.select("node", "regs").mapInArrow(tidy(keys), "key bigint, node binary")
    # bands with the same members (most bands of a small group) are looked at once
    shared = (bands.groupBy("key").agg(F.count("*").alias("n_members"),
                                       F.bit_xor(F.xxhash64("node")).alias("x"),
                                       F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
              .filter("n_members > 1"))
    single = shared.groupBy("n_members", "x", "y").agg(F.min("key").alias("key"))
    members = bands.join(single.select("key", "n_members"), "key")
    dealt = block_pairs(members, "key", "node", band_block)
    loaded = dealt.join(classes.select("node", "n_shingles", "regs"), "node")
    likely = saved(loaded.select("pair", "side", "node", "n_shingles", "regs")
                   .groupBy("pair").applyInArrow(_candidates(percent), "a binary, b binary")
                   .distinct(), "near-likely")

    groups = saved(components(likely), "near-groups")
    sized = groups.join(groups.groupBy("component").agg(F.count("*").alias("n_members")),
                        "component")
    wanted = sized.join(classes.select("node", "rep"), "node")

    def sets(batches):
        hashes = WordHashes()
        for ids, texts in slices(batches, 256):
            found = list(_sketch(texts, hashes))
            yield pa.RecordBatch.from_arrays(
                [pa.array([_node(s) for s in found], pa.binary()),
                 pa.array([s.tobytes() for s in found], pa.binary())],
                names=["node", "shingles"])

    key = row or "doc_id"
    reps = wanted.select((F.col("rep")[row] if row else F.col("rep")).alias(key)).distinct()
    full = (docs.select(key, text_bytes()).join(reps, key, "left_semi")
            .mapInArrow(tidy(sets), "node binary, shingles binary").dropDuplicates(["node"]))
    pairs = block_pairs(wanted, "component", "node", exact_block)
    proven = saved(pairs.join(full, "node").select("pair", "side", "node", "shingles")
                   .groupBy("pair").applyInArrow(_confirmed(percent), "a binary, b binary")
                   .distinct(), "near-links")

    found = components(proven)
    named = found.join(classes.select("node", "rep"), "node")
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_node = (classes.select("node", "rep")
               .join(named.select("node", "component").join(least, "component")
                     .select("node", "component_id"), "node", "left")
               .select("node", F.coalesce("component_id", "rep").alias("component_id")))
    joined = (sketch.select("doc_id", *([row] if row else []), "n_shingles", "node")
              .join(of_node, "node", "left"))
    if row:
        least = F.col("component_id")
        return joined.select(
            "doc_id", row, "n_shingles",
            F.when(least.isNull(), F.col("doc_id")).otherwise(least["doc_id"]).alias(
                "component_id"),
            F.coalesce(least[row] == F.col(row), F.lit(True)).alias("kept"))
    component = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") == 0),
                       F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return (joined.withColumn("component_id", component)
            .select("doc_id", "n_shingles", "component_id",
                    F.coalesce(F.col("doc_id") == F.col("component_id"),
                               F.lit(True)).alias("kept")))
