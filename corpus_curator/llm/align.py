"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Byte offsets at which a token of A and a token of B both end are cuts; tokens
between two cuts form a group, and every A token of a group is linked with every
B token of it. An id pair counts once for each document that holds it linked.

Texts of more than ``CHUNK`` bytes are cut into byte ranges that go to different
tasks. What a range knows is a fragment: the tokens up to its first cut (open
prefix), its closed groups, and the tokens after its last cut (open suffix).
Fragments form a monoid: composing two closes the group of the left one's suffix
and the right one's prefix; the identity is the empty fragment. A tree of
``FAN``-way compositions over Spark tasks reduces a document to one fragment.
Closed groups do not travel through the tree, only open tokens do. A short text
is one fragment whose both ends are cuts.

Pair counts are relational: documents are held in blocks with one sorted list of
the distinct pairs of the block, the counts of all pairs are summed by key, and
each block joins back the counts of its own pairs.

Defined results. Null or empty texts, and texts whose tokens do not spell
``" " + text`` (a tokenizer that rewrites its input), have no tokens: zeros and an
empty ``groups_sha256``. Rows that repeat an id are documents of their own, null
ids too. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache, partial, reduce
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import saved, tidy

#: Bytes of a byte range, of a block of short texts, and ranges composed at once.
CHUNK = 256 << 10
BLOCK = 2 << 20
FAN = 16

#: A blank between two characters that are not white space: both tokenizers start
#: a token there whatever stands around, so that text before and after it can be
#: encoded apart. Lead bytes C3-DF, E4-F4 start no white-space character.
SAFE = re.compile(
    rb"(?:(?<=[!-~])|(?<=[\xC3-\xDF][\x80-\xBF])|(?<=[\xE4-\xEF][\x80-\xBF][\x80-\xBF])"
    rb"|(?<=[\xF0-\xF4][\x80-\xBF][\x80-\xBF][\x80-\xBF])) (?=[!-~\xC3-\xDF\xE4-\xF4])")

#: The same places in a string, after its first character.
WORD_END = re.compile(r" (?=\S)(?<=\S )")

Pairs = Callable[[], tuple["Side", "Side"]]


class Side:
    """A tokenizer: ``encode(texts)`` gives id lists, ``token`` the bytes of ids;
    ``together`` words are best encoded as one text."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], token: list[bytes],
                 together: int = 1):
        self.encode, self.token, self.together = encode, token, together
        self.size = np.fromiter(map(len, token), np.int64, len(token))

    def spelt(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def _byte_letters() -> dict[str, int]:
    """The printable letter that a byte-level vocabulary writes for each byte:
    printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@lru_cache(1)
def public_pair(a_path: str, b_path: str) -> tuple[Side, Side]:
    """A byte-level BPE file and a sentence-piece model, loaded once per worker."""
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(a_path)
    a.encode_special_tokens = True
    letters = _byte_letters()
    size = a.get_vocab_size(with_added_tokens=True)
    a_token = [bytes(letters[c] for c in a.id_to_token(i)) if all(c in letters for c in
               a.id_to_token(i)) else a.id_to_token(i).encode() for i in range(size)]
    b = sentencepiece.SentencePieceProcessor(model_file=b_path)
    b_token = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else
               b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.vocab_size())]
    return (Side(lambda texts: [e.ids for e in a.encode_batch_fast(
                [" " + t for t in texts], add_special_tokens=False)], a_token, 16),
            Side(lambda texts: b.encode(texts, num_threads=1), b_token))


class Encoder:
    """Ids of texts under both tokenizers. A text is encoded in parts between safe
    places; parts are kept for a task, at most ``limit`` of them."""

    def __init__(self, sides: tuple[Side, Side], limit: int = 250_000):
        self.sides, self.limit, self.memo = sides, limit, {}

    def __call__(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Packed 32-bit ids of ``" " + text`` under A and of ``text`` under B; None
        where the tokens do not spell ``" " + text``."""
        parts = [WORD_END.split(t) for t in texts]
        words = set().union(*parts)
        new = list(words - self.memo.keys())
        if len(self.memo) + len(new) > self.limit:
            self.memo.clear()
            new = list(words)
        self._learn(new)
        found = []
        for words_ in parts:
            ids = [self.memo[w] for w in words_]
            found.append(None if None in ids else tuple(map(b"".join, zip(*ids))))
        for word in new:
            if len(word) > 64:
                del self.memo[word]
        return found


    def _learn(self, words: list[str]) -> None:
        """Encodes words, several as one text: the places between them are safe, so the
        tokens that end inside a word are its own. Words with white space at an end go
        alone. Where the tokens of all do not spell all, each word is looked at."""
        edge = {w for w in words if not w or w[0].isspace() or w[-1].isspace()}
        plain = [w for w in words if w not in edge]
        words = plain + list(edge)
        want = [(" " + w).encode() for w in words]
        stops_at = np.cumsum(np.fromiter(map(len, want), np.int64, len(want)))
        whole, packed = b"".join(want), []
        for side in self.sides:
            k = side.together
            texts = [" ".join(plain[i:i + k]) for i in range(0, len(plain), k)] + list(edge)
            ids = np.fromiter(chain.from_iterable(side.encode(texts)), np.int32)
            ends = np.cumsum(side.size[ids])
            if side.spelt(ids.tolist()) != whole:
                return self._learn_each(words, want)
            stops = np.searchsorted(ends, stops_at, "right")
            data, stops = ids.tobytes(), (4 * stops).tolist()
            packed.append([data[i:j] for i, j in zip([0, *stops], stops)])
        self.memo.update(zip(words, zip(*packed)))

    def _learn_each(self, words: list[str], want: list[bytes]) -> None:
        for word, text, *ids in zip(words, want, *(s.encode(words) for s in self.sides)):
            spelt = all(s.spelt(x) == text for s, x in zip(self.sides, ids))
            self.memo[word] = tuple(np.array(x, np.int32).tobytes() for x in ids) if spelt else None


def public_sides(a_path: str, b_path: str) -> Pairs:
    """The pair of these files, to be loaded in the tasks."""
    return partial(public_pair, a_path, b_path)


class Groups(NamedTuple):
    """Groups of a token stream whose first and last offset are cuts."""
    cuts: np.ndarray        # end offset of each group
    n_a: np.ndarray         # tokens of each group
    n_b: np.ndarray
    keys: np.ndarray        # linked id pairs, a * |B| + b, with their group
    at: np.ndarray
    times: np.ndarray


def _grouped(a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray,
             width: int) -> Groups:
    cuts = np.intersect1d(a_end, b_end, assume_unique=True)
    a_of, b_of = np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end)
    n_a, n_b = np.bincount(a_of, minlength=len(cuts)), np.bincount(b_of, minlength=len(cuts))
    b_from = np.cumsum(n_b) - n_b
    # groups of few links are expanded together; of a large one only its distinct
    # ids are multiplied
    large = n_a * n_b > 256
    near = ~large[a_of]
    reps = n_b[a_of[near]]
    first = np.cumsum(reps) - reps
    j = np.arange(reps.sum()) - np.repeat(first, reps) + np.repeat(b_from[a_of[near]], reps)
    keys = [np.repeat(a[near].astype(np.int64), reps) * width + b[j]]
    at, times = [np.repeat(a_of[near], reps)], [np.ones(len(j), np.int64)]
    for g in np.flatnonzero(large):
        ids, n = np.unique(a[a_of == g], return_counts=True)
        others, m = np.unique(b[b_of == g], return_counts=True)
        keys.append((ids[:, None].astype(np.int64) * width + others).ravel())
        times.append((n[:, None] * m).ravel())
        at.append(np.full(len(keys[-1]), g))
    return Groups(cuts, n_a, n_b, *map(np.concatenate, (keys, at, times)))


@lru_cache(2)
def _numerals(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Every id in decimal followed by "", ",", "|" and ";" as padded bytes, and
    the length of the decimal."""
    text = [str(i) for i in range(size)]
    table = np.array([[t + end for t in text] for end in ("", ",", "|", ";")], dtype="S")
    return table, np.fromiter(map(len, text), np.int64, size)


def _written(a: np.ndarray, b: np.ndarray, g: Groups, ends: np.ndarray) -> list[bytes]:
    """The groups as ``a1,a2|b1;...``, one text for every run of groups that ends
    with one of the group numbers ``ends``."""
    n = max(int(a.max(initial=0)), int(b.max(initial=0))) + 1
    table, digits = _numerals(1 << (n - 1).bit_length())
    a_last, b_last = np.cumsum(g.n_a) - 1, np.cumsum(g.n_b) - 1
    a_of, b_of = np.repeat(np.arange(len(g.n_a)), g.n_a), np.repeat(np.arange(len(g.n_b)), g.n_b)
    a_sep, b_sep = np.ones(len(a), np.int8), np.ones(len(b), np.int8)
    a_sep[a_last], b_sep[b_last] = 2, 3
    b_sep[b_last[ends]] = 0
    place_a = np.arange(len(a)) + (np.cumsum(g.n_b) - g.n_b)[a_of]
    place_b = np.arange(len(b)) + np.cumsum(g.n_a)[b_of]
    ids, sep = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.int8)
    ids[place_a], ids[place_b], sep[place_a], sep[place_b] = a, b, a_sep, b_sep
    size = np.cumsum(digits[ids] + (sep > 0))
    whole = table[sep, ids].tobytes().translate(None, b"\0")
    stops = size[place_b[b_last[ends]]]
    return [whole[i:j] for i, j in zip([0, *stops[:-1].tolist()], stops.tolist())]


def _stream(side: Side, packed: list[bytes], base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts as one array, and the offset at which each token ends."""
    ids = np.frombuffer(b"".join(packed), np.int32)
    ends = np.cumsum(side.size[ids])
    n = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
    before = np.concatenate([[0], ends])[np.cumsum(n) - n]
    return ids, ends + np.repeat(base - before, n)


def _block_row(block: int, doc_ids: list, ok: np.ndarray, parts: dict | None) -> dict:
    """One row of a block: the figures of its documents, and their pairs as places
    in the sorted list of the block's pairs."""
    zero = np.zeros(len(doc_ids), np.int64)
    row = {k: zero.copy() for k in ("n_a", "n_b", "n_groups", "n_links", "n_pairs")}
    sha = [""] * len(doc_ids)
    keys = held = np.zeros(0, np.int64)
    place = times = held
    if parts:
        for k in ("n_a", "n_b", "n_groups", "n_links"):
            row[k][ok] = parts[k]
        for i, text in zip(np.flatnonzero(ok), parts["sha"]):
            sha[i] = text
        keys, inverse = np.unique(parts["keys"], return_inverse=True)
        own, back = np.unique(parts["doc"] * len(keys) + inverse, return_inverse=True)
        times = np.bincount(back, parts["times"], len(own)).astype(np.int64)
        doc, place = own // len(keys), own % len(keys)
        row["n_pairs"][ok] = np.bincount(doc, minlength=int(ok.sum()))
        held = np.bincount(place, minlength=len(keys))
    return {"block": block, "ids": doc_ids, **row, "sha": sha, "keys": keys, "held": held,
            "place": zlib.compress(place.astype(np.int32).tobytes(), 1),
            "times": zlib.compress(times.astype(np.int64).tobytes(), 1)}


def _block_schema(id_type: str) -> str:
    longs = ", ".join(f"{c} array<long>" for c in ("n_a", "n_b", "n_groups", "n_links", "n_pairs"))
    return (f"block long, ids array<{id_type}>, {longs}, sha array<string>, keys array<long>, "
            "held array<long>, place binary, times binary")


def _texts_of(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of runs of rows of about ``limit`` bytes."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            text = batch.column(1)[i].as_py() or ""
            ids.append(batch.column(0)[i].as_py())
            texts.append(text)
            size += len(text) + 16
            if size >= limit:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _short_block(block: int, ids: list, texts: list[str], encoder: Encoder) -> dict:
    a_side, b_side = encoder.sides
    found = [(i, x) for i, x in enumerate(encoder(texts)) if x and texts[i]]
    ok = np.zeros(len(ids), bool)
    ok[[i for i, _ in found]] = True
    if not found:
        return _block_row(block, ids, ok, None)
    good = [x for _, x in found]
    size = np.array([1 + len(texts[i].encode()) for i, _ in found], np.int64)
    base = np.cumsum(size) - size
    a, a_end = _stream(a_side, [x for x, _ in good], base)
    b, b_end = _stream(b_side, [x for _, x in good], base)
    g = _grouped(a, a_end, b, b_end, len(b_side.token))
    doc_of = np.searchsorted(base + size, g.cuts)  # the document of each group

    def per_doc(values: np.ndarray) -> np.ndarray:
        return np.bincount(doc_of, values, len(good)).astype(np.int64)

    n_groups = np.bincount(doc_of, minlength=len(good))
    return _block_row(block, ids, ok, {
        "n_a": per_doc(g.n_a), "n_b": per_doc(g.n_b), "n_groups": n_groups,
        "n_links": per_doc(g.n_a * g.n_b), "keys": g.keys, "doc": doc_of[g.at], "times": g.times,
        "sha": [hashlib.sha256(t).hexdigest()
                for t in _written(a, b, g, np.cumsum(n_groups) - 1)]})


# ---------------------------------------------------------------- fragments

class Fragment(NamedTuple):
    """Open tokens of a byte range. ``cut``: the number of the chunk with its
    first cut, -1 if it has none (then all its tokens stand in the prefix)."""
    cut: int
    pa: bytes
    pb: bytes
    sa: bytes = b""
    sb: bytes = b""


EMPTY = Fragment(-1, b"", b"")


def compose(x: Fragment, y: Fragment) -> tuple[Fragment, tuple[int, bytes, bytes] | None]:
    """``x`` followed by ``y``, and the group that closes between them, if any:
    the chunk in which it ends and its tokens."""
    if y.cut < 0:
        if x.cut < 0:
            return Fragment(-1, x.pa + y.pa, x.pb + y.pb), None
        return Fragment(x.cut, x.pa, x.pb, x.sa + y.pa, x.sb + y.pb), None
    if x.cut < 0:
        return Fragment(y.cut, x.pa + y.pa, x.pb + y.pb, y.sa, y.sb), None
    return Fragment(x.cut, x.pa, x.pb, y.sa, y.sb), (y.cut, x.sa + y.pa, x.sb + y.pb)


def _cut_before(data: bytes, at: int) -> int:
    """The last safe place at or before ``at``, else 0."""
    width = 512
    while True:
        start = max(0, at - width)
        found = [m.start() for m in SAFE.finditer(data, start, min(len(data), at + 2 + 4))
                 if m.start() <= at]
        if found:
            return found[-1]
        if start == 0:
            return 0
        width *= 8


def _cut_after(data: bytes, at: int) -> int:
    found = SAFE.search(data, at)
    return found.start() if found else len(data)


def chunks(text: str, size: int) -> Iterator[tuple[int, int, int, str]]:
    """``(lo, hi, start, part)``: byte ranges (lo, hi] of ``" " + text``, each with
    the text from the safe place ``start`` at or before it to one at or after it.
    Where the text between two safe places is longer than a range, it stays whole
    (its encoding cannot be split), so that no byte is encoded often."""
    data = b" " + text.encode()
    lo, start = 0, 0
    while lo < len(data):
        hi = min(len(data), lo + size)
        end = _cut_after(data, hi) if hi < len(data) else hi
        before = _cut_before(data, hi) if hi < len(data) else hi
        if end - before > size:  # a long run without a safe place
            hi = before = end
        yield lo, hi, start, data[start:end].decode()
        lo, start = hi, before


def _group_row(row: int, no: int, sub: int, a: np.ndarray, a_end: np.ndarray, b: np.ndarray,
               b_end: np.ndarray, width: int) -> dict:
    g = _grouped(a, a_end, b, b_end, width)
    keys, inverse = np.unique(g.keys, return_inverse=True)
    return {"row": row, "no": no, "sub": sub, "kind": 1, "ok": True,
            "text": _written(a, b, g, np.array([len(g.cuts) - 1]))[0],
            "n_a": len(a), "n_b": len(b), "n_groups": len(g.cuts),
            "n_links": int((g.n_a * g.n_b).sum()), "keys": keys,
            "times": np.bincount(inverse, g.times).astype(np.int64)}


def _joint_row(row: int, no: int, pa_: bytes, pb_: bytes, width: int) -> dict:
    """One group, given by its tokens."""
    a, b = np.frombuffer(pa_, np.int32), np.frombuffer(pb_, np.int32)
    a_end, b_end = np.arange(1, len(a) + 1), np.arange(1, len(b) + 1)
    both = max(len(a), len(b)) + 1  # only the last offset is common
    return _group_row(row, no, 0, a, np.append(2 * a_end[:-1], 2 * both), b,
                      np.append(2 * b_end[:-1] + 1, 2 * both), width)


PIECE = ("row long, no int, sub int, kind int, ok boolean, cut int, pa binary, pb binary, "
         "sa binary, sb binary, text binary, n_a long, n_b long, n_groups long, n_links long, "
         "keys array<long>, times array<long>")


def _rows(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(T._parse_datatype_string(schema))


def _fragment(row: int, no: int, lo: int, hi: int, start: int, part: str,
              encoder: Encoder) -> list[dict]:
    """The fragment of one byte range, and a row of its closed groups."""
    found = encoder([part[1:]])[0]  # both encode with the blank that starts the part
    if not found:
        return [{"row": row, "no": no, "sub": 0, "kind": 0, "ok": False, **EMPTY._asdict()}]
    base = np.array([start], np.int64)
    (a, a_end), (b, b_end) = (_stream(s, [x], base)
                                  for s, x in zip(encoder.sides, found))
    a, a_end, b, b_end = (x[(lo < e) & (e <= hi)] for x, e in (
        (a, a_end), (a_end, a_end), (b, b_end), (b_end, b_end)))
    cuts = np.intersect1d(a_end, b_end, assume_unique=True)
    if not len(cuts):
        open_ = Fragment(-1, a.tobytes(), b.tobytes())
        return [{"row": row, "no": no, "sub": 0, "kind": 0, "ok": True, **open_._asdict()}]
    i, k = (np.searchsorted(e, cuts[[0, -1]], "right") for e in (a_end, b_end))
    found = Fragment(no, a[:i[0]].tobytes(), b[:k[0]].tobytes(), a[i[1]:].tobytes(),
                     b[k[1]:].tobytes())
    out = [{"row": row, "no": no, "sub": 0, "kind": 0, "ok": True, **found._asdict()}]
    if len(cuts) > 1:
        out.append(_group_row(row, no, 1, a[i[0]:i[1]], a_end[i[0]:i[1]], b[k[0]:k[1]],
                              b_end[k[0]:k[1]], len(encoder.sides[1].token)))
    return out


def _long_blocks(docs: DataFrame, sides: Pairs, size: int, fan: int) -> DataFrame:
    """Block rows of the texts that span several byte ranges, one document each."""
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    range_type = f"doc_id {id_type}, row long, no int, lo long, hi long, start long, part string"
    range_schema, schema, digest_schema, block_schema = map(
        _arrow, (range_type, PIECE, "row long, sha string", _block_schema(id_type)))

    def split(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                doc_id, text, row = (c[i].as_py() for c in batch.columns)
                for no, (lo, hi, start, part) in enumerate(chunks(text, size)):
                    yield _rows([{"doc_id": doc_id, "row": row, "no": no, "lo": lo, "hi": hi,
                                  "start": start, "part": part}], range_schema)

    ranges = saved(docs.withColumn("row", F.monotonically_increasing_id())
                   .mapInArrow(split, range_type), "align-ranges")

    def fragments(batches):
        encoder = Encoder(sides())
        for batch in batches:
            for r in range(batch.num_rows):
                yield _rows(_fragment(*(c[r].as_py() for c in batch.columns), encoder), schema)

    tables = [saved(ranges.select("row", "no", "lo", "hi", "start", "part")
                    .repartition("row", "no").mapInArrow(tidy(fragments), PIECE), "align-fragments")]

    def reduced(table: pa.Table) -> pa.Table:
        width = len(sides()[1].token)
        rows = sorted(table.select(["row", "no", "cut", "pa", "pb", "sa", "sb"]).to_pylist(),
                      key=lambda r: r["no"])
        row, out, whole = rows[0]["row"], [], EMPTY
        for r in rows:
            whole, joint = compose(whole, Fragment(r["cut"], r["pa"], r["pb"], r["sa"], r["sb"]))
            if joint:
                out.append(_joint_row(row, *joint, width))
        out.append({"row": row, "no": rows[0]["no"] // fan, "sub": 0, "kind": 0, "ok": True,
                    **whole._asdict()})
        return pa.Table.from_batches([_rows(out, schema)])

    most = ranges.agg(F.max("no")).first()[0] or 0
    while most > 0:
        level = tables[-1].filter("kind = 0 and ok").select("row", "no", "cut", "pa", "pb", "sa",
                                                            "sb")
        tables.append(saved(level.groupBy("row", F.floor(F.col("no") / fan).alias("up"))
                            .applyInArrow(reduced, PIECE), "align-fragments"))
        most //= fan

    def root(batches):  # the text starts with a cut: the prefix is a group
        width = len(sides()[1].token)
        for batch in batches:
            for r in batch.to_pylist():
                yield _rows([_joint_row(r["row"], r["cut"], r["pa"], r["pb"], width)], schema)

    bad = tables[0].filter("not ok").select("row").distinct()
    last = tables[-1].filter("kind = 0 and ok and cut >= 0").join(bad, "row", "left_anti")
    groups = reduce(DataFrame.unionByName, [t.filter("kind = 1") for t in tables])
    groups = saved(groups.join(bad, "row", "left_anti").select(*tables[0].columns).unionByName(
        last.select("row", "cut", "pa", "pb").mapInArrow(root, PIECE)), "align-groups")

    def hashed(batches):
        """Digest of every document's groups, in order; rows arrive sorted."""
        now, state = None, None
        for batch in batches:
            rows, texts = batch.column(0).to_pylist(), batch.column(1)
            for i, row in enumerate(rows):
                if row != now:
                    if now is not None:
                        yield _rows([{"row": now, "sha": state.hexdigest()}], digest_schema)
                    now, state = row, hashlib.sha256()
                else:
                    state.update(b";")
                state.update(texts[i].as_py())
        if now is not None:
            yield _rows([{"row": now, "sha": state.hexdigest()}], digest_schema)

    digests = (groups.select("row", "text", "no", "sub").repartition("row")
               .sortWithinPartitions("row", "no", "sub").select("row", "text")
               .mapInArrow(hashed, "row long, sha string"))
    sums = groups.groupBy("row").agg(*[F.sum(c).alias(c) for c in
                                       ("n_a", "n_b", "n_groups", "n_links")])
    pairs = (groups.select(F.col("row").alias("of_row"), F.explode(F.arrays_zip("keys", "times")).alias("p"))
             .groupBy("of_row", F.col("p.keys").alias("key"))
             .agg(F.sum("p.times").alias("times")))
    figures = (ranges.filter("no = 0").select("row", "doc_id").join(sums, "row", "left")
               .join(digests, "row", "left"))

    def packed(key, figure: pa.Table, held: pa.Table) -> pa.Table:
        f = figure.to_pylist()[0]
        parts = None
        if f["sha"] is not None:
            parts = {k: [f[k]] for k in ("n_a", "n_b", "n_groups", "n_links", "sha")}
            keys = held.column("key").to_numpy()
            parts |= {"keys": keys, "doc": np.zeros(len(keys), np.int64),
                      "times": held.column("times").to_numpy()}
        row = _block_row(-1 - f["row"], [f["doc_id"]], np.array([parts is not None]), parts)
        return pa.Table.from_batches([_rows([row], block_schema)])

    return figures.groupBy("row").cogroup(pairs.groupBy("of_row")).applyInArrow(
        packed, _block_schema(id_type))


def align(docs: DataFrame, sides: Pairs, chunk: int = CHUNK, block: int = BLOCK,
          fan: int = FAN) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for
    every row of ``docs`` (columns ``doc_id``, ``text``). ``sides()`` gives the two
    tokenizers in a task. ``n_best``: links whose pair count is the highest of their
    A id; ``count_sum``: pair counts summed over the links."""
    docs = docs.select("doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = _block_schema(id_type)
    out = (f"doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, "
           "count_sum long, groups_sha256 string")
    block_schema, out_schema = _arrow(schema), _arrow(out)
    large = F.coalesce(F.octet_length("text"), F.lit(0)) >= chunk

    def blocks(batches):
        from pyspark import TaskContext
        encoder, part = Encoder(sides()), TaskContext.get().partitionId()
        for n, (ids, texts) in enumerate(_texts_of(batches, block)):
            yield _rows([_short_block((part << 32) + n, ids, texts, encoder)], block_schema)

    held = saved(docs.filter(~large).mapInArrow(tidy(blocks), schema), "align-blocks").unionByName(
        saved(_long_blocks(docs.filter(large), sides, chunk, fan), "align-long"))
    wanted = held.select("block", F.explode(F.arrays_zip("keys", "held")).alias("p")).select(
        "block", F.col("p.keys").alias("key"), F.col("p.held").alias("held"))
    counts = wanted.groupBy("key").agg(F.sum("held").alias("docs"))
    width = len(sides()[1].token)
    # all pairs of an A id: at most as many as B has tokens
    of_a = Window.partitionBy(F.floor(F.col("key") / F.lit(width)))
    counts = counts.withColumn("best", F.col("docs") == F.max("docs").over(of_a))
    looked_up = wanted.select(F.col("block").alias("of_block"), "key").join(counts, "key")

    def counted(key, left: pa.Table, right: pa.Table) -> pa.Table:
        r = {c: left.column(c)[0] for c in left.column_names}
        order = np.argsort(right.column("key").to_numpy())  # the block's own order of pairs
        docs_of = right.column("docs").to_numpy()[order]
        best = right.column("best").to_numpy()[order].astype(np.int64)
        place = np.frombuffer(zlib.decompress(r["place"].as_py()), np.int32)
        times = np.frombuffer(zlib.decompress(r["times"].as_py()), np.int64)
        n = r["n_pairs"].values.to_numpy()
        total = np.concatenate([[0], np.cumsum(times * docs_of[place])])
        chosen = np.concatenate([[0], np.cumsum(times * best[place])])
        to = np.cumsum(n)
        columns = [r["ids"].values, *(r[c].values for c in ("n_a", "n_b", "n_groups", "n_links")),
                   pa.array(chosen[to] - chosen[to - n]), pa.array(total[to] - total[to - n]),
                   r["sha"].values]
        return pa.table([c.cast(f.type) for c, f in zip(columns, out_schema)], schema=out_schema)

    return (held.drop("keys", "held").groupBy("block")
            .cogroup(looked_up.groupBy("of_block")).applyInArrow(counted, out))
