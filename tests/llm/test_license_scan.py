import random
import re

from fixtures import clash, docs, odd_rows

from corpus_curator.llm import license_scan as L


def brute(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = []
    for label, phrase in L.BASE_PHRASES:
        p = phrase.split()
        places += [(i, label) for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
    starts = [i for i, _ in places]
    return (len(w), len(places), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({x for _, x in places})))


def test_base_columns_equal_brute_force(spark):
    rng = random.Random(4)
    parts = ["under the MIT license", "Apache License, Version 2.0", "CC BY-NC 4.0", "cc by",
             "Ünder thé", "mit license", "the", "under", "license\n", "x\x00y", "日本", "cc.by.nc"]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randrange(30))))
            for i in range(60)] + [(100, None), (101, ""), (101, ""), (None, "cc by nc")]
    got = L.digest(L.find_notices(clash(docs(spark, rows)))).collect()
    assert sorted(str((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels))
                  for r in got) == sorted(str((d, *brute(t))) for d, t in rows)
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1 and (r.score == 1) >= (r.n_base > 0)


def test_fuzzy_notices():
    scan = L.scanner()
    for text, label in [(b"released under the MTI license", "mit"),
                        (b"Apache Licence Version 2", "apache-2"),
                        (b"the GNU Genral Public License, version 3", "gpl-3"),
                        (b"GNU General Public License version 2", "gpl-2")]:
        assert [m[0] for m in scan(text)[2]] == [label]
    assert scan(b"nothing of the kind is said in this line")[2] == []
    n, _, found = scan(b"one two Mozilla Public Licens Version 2.0 end")
    assert n == 9 and found[0][:3] == ("mpl-2", 2, 6)


def test_pieces_cover_the_phrase():
    for k in range(5):
        parts = L.pieces(b"gnu general public license", k)
        assert len(parts) == k + 1 and b"".join(p for _, p in parts) == b"gnu general public license"


def test_odd_rows(spark):
    got = L.digest(L.find_notices(docs(spark, odd_rows()))).collect()
    assert len(got) == 8 and all(r.n_base == 0 for r in got)
    assert L.find_notices(docs(spark, [])).collect() == []


def _labels(text):
    return {m[0] for m in L.scanner()(text.encode())[2]}


def test_other_licenses_and_versions_are_told_apart():
    wrong = {"apache license version 1 1": "apache-2", "under the mpl license": "mit",
             "gnu general public license version 1": "gpl-3", "bsd 2 clause license": "bsd-3",
             "mozilla public license version 1 1": "mpl-2",
             "gnu lesser general public license version 3": "gpl-3",
             "creative commons attribution noncommercial": "cc-by"}
    for text, label in wrong.items():
        assert label not in _labels("it is " + text + " here"), text
    right = {"apache licence version 2": "apache-2", "apache license version 1 1": "apache-1-1",
             "gnu general pubic license version 1": "gpl-1", "the bsd 2 clause licence": "bsd-2",
             "gnu affero general public license": "agpl", "undr the isc license": "isc",
             "creative comons attribution sharealike 4 0": "cc-by-sa",
             "creative commons attribution noncommercial sharealike": "cc-by-nc-sa"}
    for text, label in right.items():
        assert _labels("it is " + text + " here") == {label}, text


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_fuzzy_matches_against_plain_edit_distance():
    """One notice without fixed words: every text of few edits is found, none beyond."""
    import random
    rng = random.Random(9)
    phrase = "permission to copy and share"
    scan = L.scanner([], [("x", phrase)])
    k = len(phrase) // L.CHARS_PER_EDIT
    for _ in range(300):
        text = list(phrase)
        for _ in range(rng.randrange(0, k + 3)):
            at = rng.randrange(len(text))
            text[at:at + rng.randrange(2)] = rng.choice(["", "q", "z"])
        text = " ".join("".join(text).split())
        found = scan(f"aa bb {text} cc dd".encode())[2]
        if _edits(phrase, text) <= k:
            assert found and min(m[3] for m in found) <= _edits(phrase, text)
        for _, first, n, errors, inner in found:
            assert errors <= k and _edits(phrase, inner.decode()) <= errors
            assert f"aa bb {text} cc dd".split()[first:first + n] == inner.decode().split()


def test_many_notices_take_linear_time():
    import time
    scan = L.scanner()
    begun = time.process_time()
    n, base, found = scan(b"filler words under the mit license and so on " * 20_000)
    assert (len(base), len(found), n) == (20_000, 20_000, 180_000)
    assert time.process_time() - begun < 30
