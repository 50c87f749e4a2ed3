import random
import zlib

import numpy as np
import pytest
from fixtures import clash, docs, odd_rows, words

from corpus_curator.llm import packing


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_encoder_equals_tokenizer(path):
    from tokenizers import Tokenizer
    plain, encode = Tokenizer.from_file(path), packing.Encoder(path, limit=50)
    rng = random.Random(3)
    alphabet = "abcXYZ'  \n\t.,!<|>İΣéñü0123٣́\xad 日€$"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(50))) for _ in range(800)]
    for t in [*texts, "<|endoftext|> a<|startoftext|>b", "don't'S we'll", "①²½ ǅ ﬁ ẞ", "a" * 500]:
        want = np.asarray(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        assert encode(t) == want


@pytest.mark.parametrize("groups,per_shard", [(8, 100), (packing.GROUPS, packing.PER_SHARD)])
def test_pieces_and_places(spark, path, groups, per_shard):
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(path)
    rng = random.Random(8)
    rows = [(i, " ".join(words(rng.randrange(1, 120), i))) for i in range(150)] + odd_rows()[:7]
    rows += [(700, " ".join(words(900, 1)))]
    got = packing.pack(clash(docs(spark, rows)), path, sequence=256, groups=groups,
                       per_shard=per_shard).collect()
    want = []
    for doc_id, text in rows:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 256)):
            one = np.asarray(ids[at:at + 256], "<u4")
            want.append((doc_id, k, at, len(one), zlib.crc32(one.tobytes())))
    assert sorted(map(str, (tuple(r)[:5] for r in got))) == sorted(map(str, want))
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    bound = -(-sum(w[3] for w in want) // 256)
    assert len(sequences) <= bound * (1 + 1 / groups) + 4  # rounding up costs one group


def test_one_length_fills_sequences(spark, path):
    rows = [(i, "a b c d e f g") for i in range(64)]  # eight tokens each
    got = packing.pack(docs(spark, rows), path, sequence=32).collect()
    assert len({r.sequence_id for r in got}) == 16


def test_empty_table(spark, path):
    assert packing.pack(docs(spark, []), path).collect() == []


def test_configurations_near_the_bound():
    rng = np.random.default_rng(1)
    sizes = np.sort(rng.choice(np.arange(520, 4000), 30, replace=False))[::-1].astype(float)
    demand = rng.integers(50, 400, 30).astype(float)
    used = sum(n for _, n in packing.configurations(sizes, demand, 4096))
    made = sum(p * n for p, n in packing.configurations(sizes, demand, 4096))
    assert (made <= demand).all() and (demand - made).max() <= 31 * 8
    assert used <= 1.2 * (sizes @ demand) / 4096 + 30
