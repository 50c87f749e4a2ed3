"""Best-fit packing of tokenised documents by a linear grouping scheme.

Documents longer than a sequence are cut into full pieces; what is left has a
length below the sequence size. Large lengths, sorted, form groups of equal
cardinality and count as the largest of their group; over these few sizes the
configuration programme (which mixes of sizes fill a sequence, and how many of
each) is solved by column generation; actual pieces then take the slots of
their group. Small pieces, and the few that rounding leaves over, are put by
best fit into what is still free.

Only the histogram of lengths (at most one entry per token count below the
sequence size) reaches the driver.
"""

from __future__ import annotations

import bisect
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import Memo, saved, slices, tidy

SEQUENCE = 4096
END_ID = 1
#: Lengths up to this share of a sequence are small; sizes of the programme.
SMALL_SHARE = 1 / 8
GROUPS = 48
#: Pieces that one best-fit task handles (a parameter of memory, not of results kept).
PER_SHARD = 100_000

PIECE_SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int"


#: What the tokenizer's own pattern takes as one piece of lower-case text.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


#: How byte-level vocabularies write a byte: printable Latin-1 as itself, the
#: others in order from U+0100.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_REST = [b for b in range(256) if b not in set(_PLAIN)]
BYTE_LETTERS = [chr(b) if b in set(_PLAIN) else chr(256 + _REST.index(b)) for b in range(256)]


class Encoder:
    """Texts to little-endian uint32 ids, remembering what it has met.

    No token, special ones included, spans a blank or a line feed, so texts are
    encoded by the chunks between those. A chunk of printable Latin characters
    is the sequence of its pieces (the pattern the tokenizer splits by); any
    other chunk goes through the tokenizer whole. Both memos are bounded.
    """

    def __init__(self, path: str, limit: int = 150_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.model = self.tokenizer.model
        self.split = regex.compile(PIECE).findall
        self.pieces, self.chunks = Memo(self._piece, limit), Memo(self._chunk, limit)

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _piece(self, text: str) -> bytes:
        """Ids of one piece, by the tokenizer's model itself."""
        if not text.isascii():
            text = "".join([BYTE_LETTERS[b] for b in text.encode()])
        ids = [t.id for t in self.model.tokenize(text)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunk(self, chunk: str) -> bytes:
        if not (chunk.isascii() or max(chunk) < "\u0250") or not chunk.isprintable() \
                or "<|" in chunk:
            return self._whole(chunk)
        low = chunk.lower()
        core = low.rstrip(".,;:!?|")
        if core.isalpha():
            tail = low[len(core):]
            return self.pieces[core] + self.pieces[tail] if tail else self.pieces[core]
        return b"".join(map(self.pieces.__getitem__, self.split(low)))

    def __call__(self, text: str) -> bytes:
        return b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").split(" ")))


def tokenize(docs: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE) -> DataFrame:
    """Pieces of at most ``sequence`` tokens: ``doc_id, piece, start, length,
    ids_crc32`` and ``part``, the task that made them."""
    end = np.asarray([END_ID], dtype="<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        encode, part = Encoder(tokenizer_path), TaskContext.get().partitionId()
        for ids, texts in slices(batches):
            rows = []
            for doc_id, text in zip(ids, texts):
                data = encode(text or "") + end
                for k, at in enumerate(range(0, len(data), 4 * sequence)):
                    one = data[at:at + 4 * sequence]
                    rows.append((doc_id, k, at // 4, len(one) // 4, zlib.crc32(one), part))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (
                    pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "part"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), PIECE_SCHEMA)


def _best_pattern(value: np.ndarray, sizes: np.ndarray, room: int) -> np.ndarray:
    """The mix of sizes of the largest total value that fits: unbounded knapsack."""
    best, last = np.zeros(room + 1), np.full(room + 1, -1)
    order = np.argsort(sizes)
    sizes_up, value_up = sizes[order].astype(np.int64), value[order]
    for c in range(int(sizes_up[0]), room + 1):
        n = np.searchsorted(sizes_up, c, side="right")
        got = best[c - sizes_up[:n]] + value_up[:n]
        k = int(got.argmax())
        if got[k] > best[c - 1] + 1e-12:
            best[c], last[c] = got[k], k
        else:
            best[c] = best[c - 1]
    pattern, c = np.zeros(len(sizes)), room
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            pattern[order[last[c]]] += 1
            c -= int(sizes_up[last[c]])
    return pattern


def configurations(sizes: np.ndarray, demand: np.ndarray, room: int,
                   rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """Mixes of the sizes with how often to use each: the linear programme
    min sum x, A x >= demand by revised simplex with generated columns,
    rounded down; what rounding leaves is for best fit."""
    g = len(sizes)
    basis = np.diag(np.floor(room / sizes))
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        x, prices = inverse @ demand, np.ones(g) @ inverse
        pattern = _best_pattern(np.maximum(prices, 0), sizes, room)
        if prices @ pattern <= 1 + 1e-7:
            break
        step = inverse @ pattern
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        trial = basis.copy()
        trial[:, int(ratio.argmin())] = pattern
        if abs(np.linalg.det(trial)) < 1e-9:
            break
        basis = trial
    x = np.linalg.solve(basis, demand)
    return [(basis[:, j].astype(int), int(x[j] + 1e-9)) for j in range(g) if x[j] >= 1 - 1e-9]


def plan(histogram: dict[int, int], sequence: int = SEQUENCE, small: float = SMALL_SHARE,
         groups: int = GROUPS) -> list[tuple[int, int, int, int, int]]:
    """Slots for the large pieces, ranked by length, longest first:
    (first rank, end rank, first sequence, pieces of this group in a sequence, slot).
    Ranks outside every entry go to best fit."""
    lengths = np.array(sorted((n for n in histogram if sequence * small < n < sequence),
                              reverse=True), dtype=np.int64)
    if not len(lengths):
        return []
    counts = np.array([histogram[int(n)] for n in lengths], dtype=np.int64)
    ends = np.cumsum(counts)
    total = int(ends[-1])
    cuts = np.unique(np.linspace(0, total, min(groups, total) + 1).astype(np.int64))
    sizes = lengths[np.searchsorted(ends, cuts[:-1], side="right")]
    distinct = np.unique(sizes)[::-1]
    firsts = [int(cuts[:-1][sizes == s][0]) for s in distinct]
    demand = np.array([int((cuts[1:] - cuts[:-1])[sizes == s].sum()) for s in distinct])
    used, out, at = np.zeros(len(distinct), dtype=np.int64), [], 0
    for pattern, times in configurations(distinct.astype(float), demand.astype(float), sequence):
        take = times
        for j in np.flatnonzero(pattern):
            take = min(take, int((demand[j] - used[j]) // pattern[j]))
        if take <= 0:
            continue
        slot = 0
        for j in np.flatnonzero(pattern):
            first = firsts[j] + int(used[j])
            out.append((first, first + take * int(pattern[j]), at, int(pattern[j]), slot))
            used[j] += take * int(pattern[j])
            slot += int(pattern[j])
        at += take
    return sorted(out)


def _best_fit(bins: list[tuple[int, int]], items: list[tuple[int, int]], sequence: int):
    """Put items (length, key), longest first, where least room stays; yields
    (key, bin or None, new bin index)."""
    room = sorted(bins)
    opened = 0
    for length, key in sorted(items, reverse=True):
        at = bisect.bisect_left(room, (length, -(1 << 62)))
        if at < len(room):
            left, name = room.pop(at)
        else:
            left, name = sequence, -1 - opened
            opened += 1
        yield key, name
        if left - length > 0:
            bisect.insort(room, (left - length, name))


def pack(docs: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE,
         small: float = SMALL_SHARE, groups: int = GROUPS,
         per_shard: int = PER_SHARD) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Null text counts as empty (one end token). Documents with the same doc_id
    are packed each on its own; a null doc_id stays null. Other columns are
    ignored. An empty table gives an empty result.
    """
    pieces = saved(tokenize(docs, tokenizer_path, sequence)
                   .withColumn("row", F.monotonically_increasing_id()), "pack-pieces")
    counts = pieces.groupBy("length", "part").count()
    by_length = counts.groupBy("length").agg(F.sum("count").alias("n"))
    histogram = {r["length"]: r["n"] for r in by_length.collect()}  # bounded by ``sequence``
    slots = plan(histogram, sequence, small, groups)
    first_new = 1 + max([s[2] + (s[1] - s[0]) // s[3] for s in slots], default=0)

    # rank of every large piece, longest first: lengths before it, tasks before it, own place
    large = (F.col("length") > sequence * small) & (F.col("length") < sequence)
    longer, ahead = {}, 0
    for n in sorted(histogram, reverse=True):
        if sequence * small < n < sequence:
            longer[n], ahead = ahead, ahead + histogram[n]
    tasks = (counts.filter(large)
             .withColumn("before", F.coalesce(F.sum("count").over(
                 Window.partitionBy("length").orderBy("part")
                 .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
             .drop("count"))
    spark = docs.sparkSession
    starts = spark.createDataFrame(sorted(longer.items()) or [], "length bigint, longer bigint")
    tasks = tasks.join(F.broadcast(starts), "length")
    own = F.row_number().over(Window.partitionBy("length", "part").orderBy("row")) - 1
    ranked = (pieces.filter(large).withColumn("own", own).join(tasks, ["length", "part"])
              .withColumn("rank", F.col("longer") + F.col("before") + F.col("own"))
              .drop("longer", "before", "own"))

    begins = [s[0] for s in slots]

    @F.pandas_udf("struct<sequence_id:bigint,slot:int>")
    def place(rank):
        import pandas as pd

        if not slots:
            return pd.DataFrame({"sequence_id": [None] * len(rank), "slot": [None] * len(rank)})
        table = np.asarray(slots, dtype=np.int64)
        r = rank.to_numpy()
        at = np.maximum(np.searchsorted(np.asarray(begins), r, side="right") - 1, 0)
        first, end, seq, per, slot = (table[at, k] for k in range(5))
        inside = (r >= first) & (r < end)
        return pd.DataFrame({
            "sequence_id": pd.Series(np.where(inside, seq + (r - first) // per, -1)),
            "slot": pd.Series(np.where(inside, slot + (r - first) % per, 0).astype("int32"))})

    # slots of one start rank never overlap: entries of a group follow one another
    keep = ["doc_id", "piece", "start", "length", "ids_crc32", "row"]
    placed = saved(ranked.withColumn("at", place("rank"))
                   .select(*keep, F.col("at.sequence_id").alias("sequence_id"),
                           F.col("at.slot").alias("slot")), "pack-placed")
    inside = placed.filter("sequence_id >= 0")
    room = inside.groupBy("sequence_id").agg(
        (F.lit(sequence) - F.sum("length")).alias("length"))
    rest = (pieces.filter(F.col("length") <= sequence * small).select(*keep)
            .unionByName(placed.filter("sequence_id < 0").select(*keep)))

    shards = max(1, -(-sum(histogram.values()) // per_shard))
    free = room.filter("length > 0").select(
        F.lit(None).cast("bigint").alias("row"), "sequence_id", "length")
    todo = rest.select("row", F.lit(None).cast("bigint").alias("sequence_id"), "length")
    dealt = free.unionByName(todo).withColumn(
        "shard", F.pmod(F.xxhash64("row", "sequence_id"), F.lit(shards)).cast("int"))

    def fit(key, table):
        shard = key[0].as_py()
        rows, seqs, lengths = (table.column(c).to_pylist()
                               for c in ("row", "sequence_id", "length"))
        bins = [(n, s) for n, s in zip(lengths, seqs) if s is not None]
        items = [(n, r) for n, r in zip(lengths, rows) if r is not None]
        out = list(_best_fit(bins, items, sequence))
        # new sequences: numbered by shard, spread so that shards never meet
        names = [b if b >= 0 else first_new + (-1 - b) * shards + shard for _, b in out]
        return pa.table({"row": pa.array([k for k, _ in out], pa.int64()),
                         "sequence_id": pa.array(names, pa.int64())})

    fitted = dealt.groupBy("shard").applyInArrow(fit, "row bigint, sequence_id bigint")
    late = rest.join(fitted, "row").withColumn("slot", F.lit(sequence))
    # pieces that fill a sequence alone get even negative numbers by their row
    full = pieces.filter(F.col("length") == sequence).select(
        *keep, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).alias("slot"))
    every = inside.select(*keep, "sequence_id", "slot").unionByName(
        late.select(*keep, "sequence_id", "slot"))
    before = F.coalesce(F.sum("length").over(
        Window.partitionBy("sequence_id").orderBy("slot", "row")
        .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id"]
    return (every.withColumn("offset", before).select(*columns, "offset")
            .unionByName(full.select(*columns, F.lit(0).cast("bigint").alias("offset"))))
