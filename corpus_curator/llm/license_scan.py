"""License notices in whole texts: exact phrases, and fuzzy notices found by
pigeonhole seeds and verified with bounded-error regular expressions.

A notice of ``k`` allowed edits is split into ``k + 1`` pieces; a text within
``k`` edits holds at least one piece unchanged, so exact searches for the
pieces locate every candidate, and the ``regex`` library's fuzzy matching of
the whole notice confirms it, counts the edits and gives the span.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import slices, text_bytes

#: Base phrases and their labels.
BASE_PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]

#: Short notices searched with errors (label, words). Words in brackets
#: tell licenses and versions apart: they stand whole and take no edit, but that two
#: neighbouring letters (not digits) may have changed places, which counts as two.
NOTICES = [
    ("agpl", "[gnu] [affero] general public license"),
    ("apache-1", "[apache] license version [1] [0]"),
    ("apache-1-1", "[apache] license version [1] [1]"),
    ("apache-2", "[apache] license version [2]"),
    ("artistic-2", "[artistic] license [2] [0]"),
    ("boost-1", "[boost] software license version [1] [0]"),
    ("bsd-2", "[bsd] [2] clause license"),
    ("bsd-3", "[bsd] [3] clause license"),
    ("cc-by", "creative commons [attribution] [license]"),
    ("cc-by", "creative commons [attribution] [3] [0] unported"),
    ("cc-by", "creative commons [attribution] [4] [0] international"),
    ("cc-by-nc", "creative commons [attribution] [noncommercial]"),
    ("cc-by-nc-nd", "creative commons [attribution] [noncommercial] [noderivatives]"),
    ("cc-by-nc-sa", "creative commons [attribution] [noncommercial] [sharealike]"),
    ("cc-by-nd", "creative commons [attribution] [noderivatives]"),
    ("cc-by-sa", "creative commons [attribution] [sharealike]"),
    ("cc0", "creative commons [cc0] [1] [0] universal"),
    ("epl-1", "[eclipse] public license version [1] [0]"),
    ("epl-2", "[eclipse] public license version [2] [0]"),
    ("gpl-1", "[gnu] general public license version [1]"),
    ("gpl-2", "[gnu] general public license version [2]"),
    ("gpl-3", "[gnu] general public license version [3]"),
    ("isc", "under the [isc] license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("lgpl", "[gnu] [lesser] general public license"),
    ("lgpl", "[gnu] [library] general public license"),
    ("mit", "under the [mit] license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mpl-1-1", "[mozilla] public license version [1] [1]"),
    ("mpl-2", "[mozilla] public license version [2] [0]"),
    ("unlicense", "released into the [public] [domain]"),
    ("zlib", "under the [zlib] license"),
]

#: One edit for this many characters of a notice.
CHARS_PER_EDIT = 10

#: A-Z to a-z; everything below 0x80 that is no letter or digit to a blank.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80
    else 0x20 for b in range(256))

MATCH = ("array<struct<label:string,first_word:bigint,n_words:bigint,errors:int,"
         "matched:string>>")
SCHEMA = (f"doc_id bigint, n_words bigint, n_base bigint, base array<struct<label:string,"
          f"first_word:bigint>>, fuzzy {MATCH}")


def pieces(phrase: bytes, edits: int) -> list[tuple[int, bytes]]:
    """(offset, piece) of ``edits + 1`` pieces that together are the phrase."""
    cuts = [round(i * len(phrase) / (edits + 1)) for i in range(edits + 2)]
    return [(a, phrase[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


def _places(hay: bytes, needle: bytes):
    at = hay.find(needle)
    while at >= 0:
        yield at
        at = hay.find(needle, at + 1)


def pattern(notice: str, edits: int) -> bytes:
    """Bounded-error pattern of a notice: every run of plain words takes up to ``edits``
    errors, bracketed words and the blanks beside them none but a swap of letters."""
    out, plain = [], []

    def flush():
        if plain:
            out.append(rb"(?:%s){e<=%d}" % (b" ".join(plain), edits))
            plain.clear()

    for word in notice.encode().split():
        if word.startswith(b"["):
            flush()
            out.append(rb"(?:%s)" % b"|".join(_swapped(word.strip(b"[]"))))
        else:
            plain.append(word)
    flush()
    return rb"(?b)(?<![^ ])" + b" ".join(out) + rb"(?![^ ])"


def _swapped(word: bytes) -> list[bytes]:
    """The word, and, unless it is a number, it with two neighbouring letters swapped."""
    if word.isdigit():
        return [word]
    return list(dict.fromkeys([word] + [word[:i] + word[i + 1:i + 2] + word[i:i + 1] + word[i + 2:]
                                        for i in range(len(word) - 1)]))


def scanner(base=BASE_PHRASES, notices=NOTICES, chars_per_edit: int = CHARS_PER_EDIT):
    """scan(text bytes) -> (number of words, base places, fuzzy matches)."""
    import regex

    exact = [(label, b" " + p.encode() + b" ") for label, p in base]
    fuzzy = []
    for label, notice in notices:
        p = notice.replace("[", "").replace("]", "").encode()
        k = len(p) // chars_per_edit
        fixed = [w[1:-1].encode() for w in notice.split() if w.startswith("[")]
        fuzzy.append((label, k, len(p), pieces(p, k), regex.compile(pattern(notice, k)), fixed))

    def scan(text: bytes):
        words = text.translate(_WORD_BYTES).split()
        hay = b" " + b" ".join(words) + b" "
        blanks = None

        def word_at(at: int) -> int:
            """Number of blanks before a place, counted once for the text."""
            nonlocal blanks
            if blanks is None:
                blanks = np.flatnonzero(np.frombuffer(hay, np.uint8) == 0x20)
            return int(np.searchsorted(blanks, at))

        places = [(label, word_at(at)) for label, needle in exact for at in _places(hay, needle)]
        matches: dict[tuple[str, int], tuple] = {}
        for label, k, size, parts, found, fixed in fuzzy:
            done = -1
            starts = sorted({at - offset for offset, part in parts for at in _places(hay, part)})
            for start in starts:
                lo, hi = max(start - 2 * k - 1, 0), start + size + 2 * k + 1
                if start <= done:
                    continue
                m = found.search(hay, lo, min(hi, len(hay)))
                if m is None:
                    continue
                errors = sum(m.fuzzy_counts) + 2 * len(set(fixed) - set(m.group().split()))
                if errors > k:
                    continue
                done = m.start() + k
                a, b = m.span()
                inner = hay[a:b].strip(b" ")
                first = word_at(hay.index(inner, a)) - 1
                key, value = (label, first), (inner.count(b" ") + 1, errors, inner)
                if key not in matches or value[1] < matches[key][1]:
                    matches[key] = value
        # of notices that overlap (versions, shorter names) the one that explains most
        # of the text counts: its length less four for each edit
        taken: list[tuple] = []
        for (label, first), (n, e, inner) in sorted(
                matches.items(), key=lambda x: (4 * x[1][1] - len(x[1][2]), x[0])):
            at = bisect_left(taken, (first,))
            if (at == len(taken) or taken[at][0] >= first + n) and (
                    at == 0 or taken[at - 1][0] + taken[at - 1][2] <= first):
                taken.insert(at, (first, label, n, e, inner))
        return len(words), sorted(places), sorted((b, a, *rest) for a, b, *rest in taken)

    return scan


def find_notices(docs: DataFrame, base=BASE_PHRASES, notices=NOTICES,
                 chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_base``, ``base`` (every place
    of a base phrase) and ``fuzzy`` (label, first word, words, edits, matched text).

    Null text counts as empty: no words, no places. Repeated rows each give a
    row, a null doc_id stays null, other columns are ignored, an empty table
    gives an empty result. Every text is scanned whole.
    """
    struct = pa.struct([("label", pa.string()), ("first_word", pa.int64()),
                        ("n_words", pa.int64()), ("errors", pa.int32()), ("matched", pa.string())])
    place = pa.struct([("label", pa.string()), ("first_word", pa.int64())])

    def run(batches):
        scan = scanner(base, notices, chars_per_edit)
        for ids, texts in slices(batches):
            rows = [scan(t) for t in texts]
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()),
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([len(r[1]) for r in rows], pa.int64()),
                pa.array([[{"label": a, "first_word": b} for a, b in r[1]] for r in rows],
                         pa.list_(place)),
                pa.array([[{"label": m[0], "first_word": m[1], "n_words": m[2], "errors": m[3],
                            "matched": m[4].decode("utf-8", "replace")} for m in r[2]]
                          for r in rows], pa.list_(struct)),
            ], names=["doc_id", "n_words", "n_base", "base", "fuzzy"])

    return docs.select("doc_id", text_bytes()).mapInArrow(run, SCHEMA)


def digest(found: DataFrame) -> DataFrame:
    """The digest columns of the query: places, labels and a score (1 for an
    exact phrase, else one less the share of edits of the best fuzzy match)."""
    starts = F.transform("base", lambda x: x["first_word"])
    base = F.array_sort(F.array_distinct(F.transform("base", lambda x: x["label"])))
    both = F.array_sort(F.array_distinct(F.concat(
        F.transform("base", lambda x: x["label"]), F.transform("fuzzy", lambda x: x["label"]))))
    near = F.array_max(F.transform("fuzzy", lambda x: F.lit(1.0) - x["errors"]
                                   / F.greatest(F.length(x["matched"]), F.lit(1))))
    return found.select(
        "doc_id", "n_words", "n_base",
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(both, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(
            F.greatest(F.lit(0.0), F.coalesce(near, F.lit(0.0)))).alias("score"),
        "fuzzy")
