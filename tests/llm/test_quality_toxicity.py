"""Quality and toxicity: held-out accuracy and odd rows."""

import random

import numpy as np
from fixtures import clash, docs, odd_rows, words
from pyspark.sql import functions as F

from corpus_curator.llm import quality, toxicity

LABELS = "doc_id bigint, quality int, toxic int"


def accuracy(scored, labels, column, modulus, rest):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == rest
    rows = scored.join(labels, "doc_id").filter(held).select("score", column).collect()
    assert len(rows) > 20
    return np.mean([(r[0] >= 0.5) == (r[1] == 1) for r in rows])


def test_quality_held_out(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(240):
        good = i % 3 != 0
        w = words(rng.randrange(20, 200), i, 3000)
        text = " ".join(w) + "." if good else rng.choice(
            [" ".join(x.upper() + "!!" for x in w), " ".join(w[:2] * 60), " | ".join(w) + " ###"])
        rows.append((i, text))
        labels.append((i, int(good), 0))
    table, known = docs(spark, rows), spark.createDataFrame(labels, LABELS)
    scored = quality.score_quality(table, known)
    assert scored.count() == 240
    assert accuracy(scored, known, "quality", 3, 1) >= 0.95


def test_isotonic_is_monotone():
    x = np.arange(8.0)
    centres, levels = quality.isotonic(x, np.array([.1, .3, .2, .2, .6, .5, .9, .8]), np.ones(8))
    assert (np.diff(levels) > 0).all() and (np.diff(centres) > 0).all()
    assert np.isclose(levels[0], .1) and np.isclose(levels[1], .7 / 3)


def test_fourier_features_approximate_the_kernel():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((40, quality.N_STATS))
    z = quality.fourier(x, np.zeros(quality.N_STATS), np.ones(quality.N_STATS))
    z = z[:, quality.N_STATS:-1]
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    assert np.abs(z @ z.T - np.exp(-d / (2 * quality.N_STATS))).mean() < 0.06


def toxic_rows():
    rng = random.Random(2)
    bad = ["grobnik", "zlotek", "murkel", "drassig"]
    rows, labels = [], []
    for i in range(400):
        w = words(rng.randrange(10, 80), i, 500)
        w = ["".join(rng.choice(["an", "er", "in", "ti", "on"]) for _ in range(3)) + "e"
             if rng.random() < .5 else x for x in w]
        toxic = i % 5 == 2
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(bad) + rng.choice(["", "", "en", "s"]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_held_out_and_obfuscated(spark):
    rows, labels = toxic_rows()
    hidden = ["gr0bn1k", "z l o t e k", "muuuurkel", "dr@$$ig", "g.r.o.b.n.i.k", "zl0t3k!"]
    extra = [(1000 + i, f"enanine tionere {h} ananere") for i, h in enumerate(hidden)]
    clean = [(2000 + i, f"enanine tionere {h} ananere") for i, h in enumerate(
        ["t0k3n", "a b c d", "wwww", "x@y.example", "12:30", "enan-ine"])]
    table = docs(spark, rows + extra + clean)
    known = spark.createDataFrame(labels, LABELS)
    scored = toxicity.score_toxicity(table, known)
    assert accuracy(scored, known, "toxic", 5, 0) >= 0.97
    got = {r.doc_id: r.score for r in scored.filter("doc_id >= 1000").collect()}
    assert all(got[d] >= 0.5 for d, _ in extra) and all(got[d] < 0.5 for d, _ in clean)


def test_decoding_prefers_what_the_model_knows():
    counts = np.zeros((toxicity.V,) * 3)
    for word in ("moron", "idiot", "stupid"):
        c = [0, 0, *(toxicity._code(x) for x in word), 0, 0]
        for t in zip(c, c[1:], c[2:]):
            counts[t] += 50
    cost = toxicity.language_model(counts)
    for raw, want in (("m0r0n", "moron"), ("1d10t", "idiot"), ("s t u p i d", "stupid"),
                      ("stuuupid", "stupid"), ("i.d.i.o.t", "idiot"), ("moron", "moron")):
        assert toxicity.decode(raw, cost)[0] == want


def reader_of(*known):
    counts = np.zeros((toxicity.V,) * 3)
    for word in known:
        c = [0, 0, *(toxicity._code(x) for x in word), 0, 0]
        for t in zip(c, c[1:], c[2:]):
            counts[t] += 50
    return toxicity.Reader(toxicity.language_model(counts))


def sees(reader, text, word):
    return toxicity._bucket("w" + word) in reader.features(text)


def test_every_form_of_noise_is_decoded():
    reader = reader_of("idiot", "clown", "ass", "this")
    for raw, word in (("cloown", "clown"), ("iidiot", "idiot"), ("iddiiot", "idiot"),
                      ("!diot", "idiot"), ("(lown", "clown"), ("i/d/i/o/t", "idiot"),
                      ("i,d,i,o,t", "idiot"), ("i'd'i'o't", "idiot"), ("i_d_i_o_t", "idiot"),
                      ("a s s", "ass"), ("@$$", "ass"), ("cl0wn!", "clown"), ("idio*", "idiot")):
        assert sees(reader, f"this {raw} this", word), raw
    for clean in ("455", "$455", "4 5 5", "as", "as?"):
        assert not sees(reader, f"this {clean} this", "ass"), clean
    assert not sees(reader_of("who", "whore", "are", "re"), "who're", "whore")


def test_masked_runs_and_spaced_phrases_are_decoded():
    reader = reader_of("moron", "idiot", "you", "clown")
    for raw, words_ in (("m**on", ["moron"]), ("id***", ["idiot"]), ("i***t", ["idiot"]),
                        ("y o u c l o w n", ["you", "clown"]),
                        ("y o u  c l o w n", ["you", "clown"]),
                        ("you/c/l/o/w/n", ["you", "clown"])):
        assert all(sees(reader, raw, w) for w in words_), raw
    assert len(toxicity.decode("a" + "*" * 60 + "b", reader.cost)) > 0
    assert toxicity.decode("clo.wn" * 20_000, reader.cost)


def test_odd_rows(spark):
    rows = odd_rows()
    empty = spark.createDataFrame([], LABELS)
    some = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (6, None, None), (None, 1, 1), (4, 0, 1),
                                  (5, 1, 0), (2, 0, 0), (77, 1, 1)], LABELS)
    for known in (empty, some):
        for scored in (quality.score_quality(clash(docs(spark, rows)), known),
                       toxicity.score_toxicity(clash(docs(spark, rows)), known)):
            got = scored.collect()
            assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality.score_quality(docs(spark, rows), empty).collect()} == {0.5}
    assert quality.score_quality(docs(spark, []), some).collect() == []
    assert toxicity.score_toxicity(docs(spark, []), some).collect() == []


def _enumerated(word, cost):
    """Cost and restored form of every way through the lattice."""
    from corpus_curator.llm import toxicity
    ways = [(0.0, 0, 0, "")]
    for options in toxicity.lattice(word):
        after = []
        if isinstance(options, str):
            options = [(options, 0.0)]
        if isinstance(options, int):
            steps = [[("", toxicity.NO_MASK)] + [(x, toxicity.MASK) for x in toxicity.LETTERS]
                     ] * options
        else:
            steps = [options]
        for choices in steps:
            after = []
            for spent, a, b, text in ways:
                for given, price in choices:
                    x, y, total = a, b, spent + price
                    for z in (0, 0) if given == " " else [toxicity._code(c) for c in given]:
                        total += float(cost[x, y, z])
                        x, y = y, z
                    after.append((total, x, y, text + given))
            ways = after
    ends = [(spent + float(cost[a, b, 0]), text.strip()) for spent, a, b, text in ways]
    return min(e for e in ends if e[1])


def test_viterbi_finds_the_cheapest_of_all_ways():
    from corpus_curator.llm import toxicity
    rng = np.random.default_rng(8)
    cost = rng.random((toxicity.V,) * 3).astype(np.float32) * 6
    for word in ("letter", "aabbcc", "zzz", "h3ll0", "b*d", "i**t", "a.b.c", "@@b", "s  p a", "don't",
                 "y'o'u", "b*g*d", "ééa", "a1lo|", "x**"):
        want = _enumerated(word, cost)
        got = toxicity.decode(word, cost)[0]
        assert got == want[1], word


def test_long_masked_runs():
    import time

    from corpus_curator.llm import toxicity
    rng = np.random.default_rng(8)
    cost = rng.random((toxicity.V,) * 3).astype(np.float32) * 6
    for n in (20, 400):
        spent = np.full((toxicity.V,) * 2, np.inf)
        spent[1, 1] = 0.0
        for _ in range(n):
            total = spent[:, :, None] + cost[:, :, 1:27]
            given = total.min(0) + toxicity.MASK
            spent = spent + toxicity.NO_MASK
            spent[:, 1:27] = np.minimum(given, spent[:, 1:27])
        start = np.full((toxicity.V,) * 2, np.inf)
        start[1, 1] = 0.0
        steps = toxicity.Steps(start, n, cost)
        assert np.allclose(steps.spent[np.isfinite(spent)], spent[np.isfinite(spent)])
    begun = time.process_time()
    reader = toxicity.Reader(cost)
    assert toxicity.decode("a" + "*" * 1_000_000, cost)
    assert toxicity.decode("a" + "*" * 1_000_000 + "b", cost)
    assert reader.features("a" + "#" * 100_000 + "b" + "*" * 100_000)
    assert time.process_time() - begun < 60


def test_one_memo_entry_for_a_word_however_written():
    reader = reader_of("idiot", "clown")
    plain = reader.features("iidiot cl0wn")
    assert reader.features('"Iidiot", [IIDIOT] iidiot. Cl0wn; cl0wn... {cl0wn}') == plain
    assert set(reader.tokens) == {"iidiot", "cl0wn"}


def test_words_are_decoded_only_if_a_way_has_evidence(monkeypatch):
    decoded = []
    letters = toxicity._decode_letters
    monkeypatch.setattr(toxicity, "_decode_letters",
                        lambda word, *a: decoded.append(word) or letters(word, *a))
    every = reader_of("idiot", "clown", "letter", "bookkeeper")
    known = {toxicity._bucket("widiot"): 0, toxicity._bucket("pclow"): 1}
    reader = toxicity.Reader(every.cost, known)
    for text in ("letter iddiot. bookkeeper aabbccddee", "Cloown, bookkeeper!", "'iidiot' ***",
                 "i.d.i.o.t. bookkeeper", "idiot clown letter", "iidiot%%% letter"):
        want = {known[f] for f in every.features(text) if f in known}
        decoded.clear()
        assert reader.features(text) == want, text
        assert not {"letter", "bookkeeper"} & set(decoded)
    assert reader.features("iiddiioott") == {0} and decoded[-1] == "iiddiioott"


def test_readings_are_the_ways_through_the_lattice():
    for word in ("letter", "aab", "abb", "zzz", "éérr", "plain", "жжа", "a"):
        ways = [""]
        for options in toxicity.lattice(word):
            given = [options] if isinstance(options, str) else [x for x, _ in options]
            ways = [w + x for w in ways for x in given]
        assert sorted(toxicity.readings(word)) == sorted(ways)
    assert toxicity.readings("aabbccdd") is None
    assert toxicity.decode("ab" * 500_000, reader_of("idiot").cost) == ["ab" * 500_000]
