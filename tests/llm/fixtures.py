"""Small tables and brute-force forms shared by the tests of the operators."""

import hashlib
import random
import re
from collections import Counter

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCS)


def words(n, seed, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def odd_rows():
    """Null text, empty text, blanks, one word, a repeated row, a null id, a long text."""
    long_text = " ".join(words(30_000, 5, 5000))
    return [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "same row here now ok yes"),
            (5, "same row here now ok yes"), (None, "no id at all in this row"), (6, long_text)]


def clash(df):
    """Extra columns whose names an operator might use itself."""
    from pyspark.sql import functions as F
    for name in ("row", "node", "score", "kept", "length", "hits", "block", "shard", "rank"):
        df = df.withColumn(name, F.lit("x"))
    return df


def components(rows, percent=85):
    sets = []
    for doc_id, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        sets.append(set(zip(*[w[i:] for i in range(5)])) if len(w) >= 5
                    else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return [(doc_id, len(sets[i]), least[find(i)], least[find(i)] == doc_id)
            for i, (doc_id, _) in enumerate(rows)]


def repeats(rows, length=200):
    """(doc_id, bytes, removed, spans, sha of what is kept), and what is kept."""
    seen = Counter()
    data = [(d, (t or "").encode()) for d, t in rows]
    for _, b in data:
        seen.update(b[i:i + length] for i in range(len(b) - length + 1))
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))),
                    hashlib.sha256(kept).hexdigest(), kept))
    return out
