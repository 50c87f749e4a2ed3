import random

import pytest
from fixtures import clash, docs, odd_rows, repeats, words

from corpus_curator.llm import suffix_dedup


def planted():
    rng = random.Random(2)
    passage = " ".join(words(60, 9))
    rows = []
    for i in range(12):
        w = words(80, 20 + i)
        text = " ".join(w[:rng.randrange(80)]) + passage[:rng.randrange(150, len(passage))]
        rows.append((i, text + " ".join(words(30, 50 + i))))
    rows += [(50, "ab" * 400), (51, "x" * 250), (52, "äöü" * 130 + passage), (53, passage * 3),
             (54, rows[3][1]), (55, rows[3][1]), (56, "y" * 199), (57, "z" * 200), (58, "é" * 100)]
    return rows


def check(got, want):
    assert sorted(tuple(r) for r in got) == sorted(w[:5] for w in want)


@pytest.mark.parametrize("hot", [20_000, 1])
def test_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_CONTEXTS", hot)
    rows = planted()
    check(suffix_dedup.remove_repeats(docs(spark, rows)).collect(), repeats(rows))


def test_text_and_carried_columns(spark):
    rows = planted()
    got = suffix_dedup.remove_repeats(docs(spark, rows), carry=("source", "n_chars"),
                                      with_text=True)
    assert got.columns == ["doc_id", "source", "n_chars", "n_bytes", "n_removed", "n_spans",
                           "kept_sha256", "kept"]
    want = {w[0]: w[5] for w in repeats(rows)}
    for r in got.collect():
        assert bytes(r.kept) == want[r.doc_id] and r.source == "src"


def test_odd_rows(spark):
    rows = odd_rows() + [(8, "t" * 300), (8, "t" * 300), (None, "q" * 150)]
    got = suffix_dedup.remove_repeats(clash(docs(spark, rows))).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(
        str(w[:5]) for w in repeats(rows))


def test_empty_table(spark):
    assert suffix_dedup.remove_repeats(docs(spark, [])).collect() == []


def test_no_repeats(spark):
    rows = [(i, " ".join(words(100, i, 100_000))) for i in range(5)]
    assert all(r.n_removed == 0 for r in suffix_dedup.remove_repeats(docs(spark, rows)).collect())
