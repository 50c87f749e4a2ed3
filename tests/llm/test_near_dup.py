import random

import numpy as np
import pytest
from fixtures import clash, components, docs, odd_rows, words

from corpus_curator.llm import graph, near_dup


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def near_copies():
    rng = random.Random(1)
    rows, at = [], 0
    for base in range(6):
        text = words(120 + 60 * base, 100 + base)
        for copy in range(12):
            w = list(text)
            for _ in range(copy % 7):
                w[rng.randrange(len(w))] = f"edit{rng.random()}"
            rows.append((at := at + 1, " ".join(w)))
    rows += [(1000 + i, " ".join(words(3, i))) for i in range(5)]
    rows += [(2000, "a b c d e f g"), (2001, "A b c d e f g"), (2002, "a b c d e f h"),
             (2003, "a b c"), (2004, "a  b\tc"), (2005, ""), (2006, None), (2007, "")]
    return rows


@pytest.mark.parametrize("band_block,exact_block", [(1024, 256), (3, 4)])
def test_links_equal_brute_force(spark, band_block, exact_block):
    rows = near_copies()
    got = near_dup.link(docs(spark, rows), band_block=band_block, exact_block=exact_block)
    assert rows_of(got) == sorted(components(rows), key=str)


def test_odd_rows(spark):
    rows = odd_rows()
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept)
           for r in near_dup.link(clash(docs(spark, rows))).collect()}
    assert got[(1, 0)] == (1, True) and got[(2, 0)] == (2, True) and got[(3, 0)] == (3, True)
    assert got[(4, 1)] == (4, True) and got[(5, 2)] == (5, True)
    assert got[(None, 3)] == (None, True)
    assert got[(6, 29996)][0] == 6


def test_empty_table(spark):
    assert near_dup.link(docs(spark, [])).collect() == []


def test_registers_estimate_similarity():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    for keep in (0.95, 0.85, 0.5):
        other = base.copy()
        n = int(len(base) * 2 * (1 - keep) / (1 + keep) / 2)
        other[:n] = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        true = len(np.intersect1d(base, other)) / len(np.union1d(base, other))
        got, _ = near_dup.estimate(near_dup.registers(base), near_dup.registers(other)[None],
                                   len(base), np.array([len(other)]))
        assert abs(got[0] - true) < 0.12
    assert not near_dup.registers(np.empty(0, np.uint64)).any()


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = dict(graph.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 160))
