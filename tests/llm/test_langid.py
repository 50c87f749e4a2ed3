import itertools
import random

import numpy as np
from fixtures import clash, docs, odd_rows
from pyspark.sql import functions as F

from corpus_curator.llm import langid

STEMS = {"en": "the and with house from water that".split(),
         "de": "und der mit haus von wasser nicht schön".split(),
         "fr": "le avec maison eau être que très".split()}


def text(lang, n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(STEMS[lang]) + rng.choice(["", "", ".", ","]) for _ in range(n))


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(2)
    k, n = 3, 7
    e, trans, start = rng.random((n, k)) + .1, rng.random((k, k)) + .1, rng.random(k) + .1
    begins = np.array([True, False, False, True, False, False, False])
    want = np.zeros((n, k))
    for labels in itertools.product(range(k), repeat=n):
        p = 1.0
        for t, y in enumerate(labels):
            p *= e[t, y] * (start[y] if begins[t] else trans[labels[t - 1], y])
        for t, y in enumerate(labels):
            want[t, y] += p
    want /= want.sum(1, keepdims=True)
    for block in (2, 3, 256):
        got, both = langid.forward_backward(e, trans, start, begins, block=block, pairs=True)
        assert np.allclose(got, want)
        assert np.isclose(both.sum(), (~begins).sum())


def test_held_out_accuracy_and_switches(spark):
    rows = [(i, text(lang, 30, i), lang) for i, lang in
            enumerate(itertools.islice(itertools.cycle(STEMS), 240))]
    table = docs(spark, rows)
    field = langid.learn(table)
    got = langid.predict(table, field).join(table.select("doc_id", "lang"), "doc_id")
    assert got.filter(F.col("lang") == F.col("lang_pred")).count() == 240
    mixed = docs(spark, [(1, text("en", 40, 1) + " " + text("fr", 12, 2), "en")])
    r = langid.predict(mixed, field).first()
    assert r.lang_pred == "en" and r.switches >= 1 and 0.6 < r.score < 0.95


def test_labels_of_held_out_rows_teach_nothing(spark):
    rows = [(i, text("en", 20, i), "en") for i in range(60)]
    table = docs(spark, rows)
    wrong = table.withColumn("lang", F.when(
        F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, "zz").otherwise("en"))
    assert langid.learn(wrong).labels == ["en"]


def test_sample_is_the_same_however_rows_are_partitioned(spark):
    rows = [(i, text(lang, 30, i), lang) for i, lang in
            enumerate(itertools.islice(itertools.cycle(STEMS), 240))]
    rows += [(7, text("en", 5, 1000 + i), "en") for i in range(300)]  # an id that repeats
    table = docs(spark, rows)
    a, b = (langid.learn(table.repartition(n), per_language=20) for n in (1, 7))
    assert np.array_equal(a.weights, b.weights) and a.lexicon == b.lexicon


def test_every_language_gets_its_share_of_words(monkeypatch):
    monkeypatch.setattr(langid, "MAX_WORDS", 600)
    rows = [(text("en", 400, i), "en") for i in range(40)] + [(text("de", 100, 99), "de")]
    field = langid.fit(rows)
    memo = langid.Emissions(field)
    (ids,), table = memo.rows([text("de", 40, 5)])
    assert table[ids].sum(0).argmax() == field.labels.index("de")


def test_odd_rows(spark):
    rows = odd_rows() + [(9, "123 456 !!"), (10, "x")]
    got = {str((r.doc_id, r.n_words)): (r.lang_pred, r.score) for r in langid.identify(
        clash(docs(spark, rows))).collect()}
    for key in ("(1, 0)", "(2, 0)", "(3, 0)", "(9, 0)"):
        assert got[key] == ("und", 0.0)
    assert got["(4, 1)"][0] == "en" and got["(10, 1)"][0] == "en"
    assert got["(6, 30000)"][0] == "en"
    assert langid.identify(docs(spark, [])).collect() == []
    unlabelled = docs(spark, rows).withColumn("lang", F.lit(None).cast("string"))
    assert langid.identify(unlabelled).filter("lang_pred <> 'und'").count() == 0
