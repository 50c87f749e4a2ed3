import math
from collections import Counter

import pytest
from fixtures import clash, docs, odd_rows, words

from corpus_curator.llm import lm_score


def brute(rows, order=3, alpha=0.4):
    tokens = [(d, (t or "").encode().lower().split()) for d, t in rows]
    seen = Counter()
    for _, w in tokens:
        for n in range(1, order + 1):
            seen.update(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
    total = sum(len(w) for _, w in tokens)
    out = []
    for d, w in tokens:
        log = 0.0
        for i in range(len(w)):
            top = min(order, i + 1)
            for n in range(top, 0, -1):
                gram = tuple(w[i - n + 1:i + 1])
                k = seen[gram] - 1
                if n == 1:
                    log += (top - 1) * math.log(alpha) + math.log(max(k, .5) / max(total - 1, 1))
                elif k > 0:
                    log += (top - n) * math.log(alpha) + math.log(k / (seen[gram[:-1]] - 1))
                    break
        out.append((d, len(w), round(log, 4)))
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 4])
@pytest.mark.parametrize("size", [1 << 22, 2000])
def test_equals_brute_force(spark, order, size):
    rows = [(i, " ".join(words(20 + 3 * i, i, 30 if i % 2 else 900))) for i in range(40)]
    rows += odd_rows() + [(90, "Same Same same"), (91, "the the the the")]
    got = lm_score.score(clash(docs(spark, rows)), order=order, block_bytes=size,
                         bucket_bytes=size).collect()
    assert sorted(str((r.doc_id, r.n_words, round(r.log_score, 4) + 0.0)) for r in got) == sorted(
        str((d, n, s + 0.0)) for d, n, s in brute(rows, order))


def test_empty_table(spark):
    assert lm_score.score(docs(spark, [])).collect() == []


def test_columns_round_trip():
    import numpy as np
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 44, 5000, dtype=np.uint64))
    assert (lm_score._column(*lm_score._widths(a)) == a).all()
    for top in (2, 300, 1 << 20, 1 << 40):
        n = rng.integers(1, top, 999)
        assert (lm_score._read_numbers(lm_score._numbers(n)) == n).all()
