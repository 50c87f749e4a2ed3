import hashlib
from collections import Counter, defaultdict
from functools import reduce

import pytest
from corpus_curator.llm import align

TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog. Don't panic, it's 2024!"),
    (2, "Straße über Köln, où êtes-vous? 你好世界 \U0001f600 end"),
    (3, ""), (4, None), (5, "   leading and  double  blanks \n\n tabs\t\tx "),
    (6, "<|endoftext|> <s> <0x41> </s>"), (7, "a literal ▁ sign"),
    (8, "internationalisation " * 40), (9, "zzzzqqqqxxxx" * 30), (9, "the lazy dog"),
    (None, "the quick brown fox"), (12, "　 odd blanks 　 here"),
    (13, "word " * 3 + "漢字" * 200 + " tail of it"), (14, "x"), (15, " "),
    (16, "a\0b\r\nc"),
]


def sides():
    import public_tokenizers as P
    return align.public_sides(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))


def plain_groups(text):
    """Groups by walking both token lists, as the definition says."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer
    a_tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    if not text:
        return []
    want = (" " + text).encode()
    enc = a_tok.encode(" " + text, add_special_tokens=False)
    letters = align._byte_letters()
    a = [(i, bytes(letters[c] for c in a_tok.id_to_token(i))) for i in enc.ids]
    b = []
    for i in b_tok.encode(text):
        p = b_tok.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if b_tok.is_byte(i)
                  else p.replace("▁", " ").encode()))
    if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
        return []
    groups, ga, gb, at_a, at_b, j = [], [], [], 0, 0, 0
    for i, x in a:
        ga.append(i)
        at_a += len(x)
        while at_b < at_a:
            gb.append(b[j][0])
            at_b += len(b[j][1])
            j += 1
        if at_a == at_b:
            groups.append((ga, gb))
            ga, gb = [], []
    assert not ga and not gb
    return groups


def brute(rows):
    found = [(i, plain_groups(t)) for i, t in rows]
    links = [Counter((a, b) for ga, gb in g for a in ga for b in gb) for _, g in found]
    count = Counter(p for c in links for p in c)
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for (i, g), c in zip(found, links):
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        out.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g),
                    sum(c.values()), sum(n for p, n in c.items() if count[p] == best[p[0]]),
                    sum(n * count[p] for p, n in c.items()),
                    hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk", [16, 100, 1 << 18])
def test_align_equals_the_definition(spark, chunk):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3)
    df = df.selectExpr("*", "'x' AS n_a", "1 AS block", "2 AS row")  # clashing names are ignored
    got = align.align(df, sides(), chunk=chunk, block=200, fan=3)
    assert sorted(map(tuple, got.collect()), key=str) == brute(TEXTS)


def test_align_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert align.align(df, sides()).count() == 0


def test_composition_is_associative():
    def fold(parts):
        joints = []

        def step(x, y):
            z, joint = align.compose(x, y)
            joints.extend([joint] if joint else [])
            return z
        return reduce(step, parts, align.EMPTY), joints

    f = [align.Fragment(0, b"a", b"b", b"c", b"d"), align.Fragment(-1, b"e", b"f"),
         align.Fragment(2, b"g", b"h", b"i", b"j"), align.Fragment(-1, b"k", b""),
         align.Fragment(4, b"l", b"m", b"", b"")]
    whole, joints = fold(f)
    for at in range(1, len(f)):
        left, j1 = fold(f[:at])
        right, j2 = fold(f[at:])
        both, joint = align.compose(left, right)
        assert both == whole
        assert sorted(j1 + j2 + ([joint] if joint else [])) == sorted(joints)


def test_ranges_cover_the_text_and_start_at_safe_places():
    text = "one two  threeé vier 一二 fünf " + "y" * 50 + " six seven"
    data = b" " + text.encode()
    for size in (1, 3, 7, 20, 500):
        at = 0
        for lo, hi, start, part in align.chunks(text, size):
            assert lo == at and start <= lo and data[start:].startswith(part.encode())
            assert part.startswith(" ") and start + len(part.encode()) >= hi
            at = hi
        assert at == len(data)
