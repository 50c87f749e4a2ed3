import math
from collections import Counter

import pytest
from fixtures import components, docs, repeats, words

from corpus_curator.llm import near_dup

pytest.importorskip("public_tokenizers")


def test_stages_equal_brute_force(spark, tmp_path):
    import corpus_pipeline as pipeline

    item = " ".join(words(20, 77, 9000))
    passage = " ".join(words(70, 88, 9000))
    rows = [(i, " ".join(words(150, i, 5000)), "en") for i in range(30)]
    rows += [(30 + i, rows[i][1] + " tail", "en") for i in range(5)]          # near copies
    rows += [(50, " ".join([*words(60, 1, 9000), item]), "en"),                # leaked item
             (51, words(5, 2)[0] + " " + passage, "en"), (52, passage + " y", "en"),
             (60, "123 456", "en"), (61, "", "en"), (62, None, "en")]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(
        str(tmp_path / "benchmark.parquet"))

    kept = [(d, t) for d, t, _ in rows if t and any(c.isalpha() for c in t)]
    kept = [(d, t) for (d, t), c in zip(kept, components(kept)) if c[3]]
    kept = [(w[0], w[5].decode()) for w in repeats(kept)]
    kept = [(d, t) for d, t in kept if item not in t]

    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = now.columns
    for name, stage in pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == names, name
        now.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
    assert sorted((r.doc_id, r.text, r.n_chars) for r in now.collect()) == sorted(
        (d, t, len(t)) for d, t in kept)
    packed = pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(d for d, _ in kept)


def test_rows_that_share_an_id_or_have_none(spark, tmp_path):
    import corpus_pipeline as pipeline

    text = {i: " ".join(words(80, 300 + i, 9000)) for i in range(8)}
    item = " ".join(words(20, 399, 9000))
    leaked = " ".join([*words(60, 398, 9000), item])
    rows = [(1, text[1]), (1, text[1]), (None, text[1]),      # repeated, and without an id
            (2, text[2]), (3, text[2] + " tail"), (3, text[3]),  # a copy shares its id
            (None, text[4]), (None, text[4] + " tail"),
            (5, text[5]), (6, leaked), (6, text[6]), (None, leaked + " other words")]
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(
        str(tmp_path / "benchmark.parquet"))
    now = docs(spark, rows)
    for name, stage in pipeline.STAGES[1:4]:
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
    got = sorted(((r.doc_id or 0, r.text) for r in now.collect()))
    left = [t for d, t in got if d == 0]
    assert len(left) == 1 and left[0].startswith(text[4])
    assert got[1:] == [(1, text[1]), (2, text[2]), (3, text[3]), (5, text[5]), (6, text[6])]


def test_decontamination_of_rows_that_share_an_id_or_have_none(spark):
    from corpus_curator.llm import decontam

    item = " ".join(words(20, 399, 9000))
    rows = [(1, "a b c d e f"), (1, "x " + item), (None, item + " y"), (None, "g h i j k l")]
    known = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    left = decontam.decontaminate(docs(spark, rows), known, by_row=True).collect()
    assert sorted((r.doc_id or 0, r.text) for r in left) == [(0, rows[3][1]), (1, rows[0][1])]


def test_near_stage_threshold_is_eighty_percent(spark):
    import corpus_pipeline as pipeline

    rows, gone = [], []
    for n, percent in ((90, 79), (100, 81), (106, 82), (120, 84)):
        base = words(n, n, 9000)
        edited = [*base]
        edited[20], edited[60] = "other", "changed"
        pair = [(10 * n, " ".join(base)), (10 * n + 1, " ".join(edited))]
        rows += pair
        a, b = (set(zip(*[w[i:] for i in range(5)])) for w in (base, edited))
        assert 100 * len(a & b) // len(a | b) == percent
        assert [c[3] for c in components(pair, 80)] == [True, percent < 80]
        gone += [10 * n + 1] if percent >= 80 else []
    stay = [r.doc_id for r in pipeline.near_duplicates(spark, docs(spark, rows), "").collect()]
    assert sorted(stay) == sorted({d for d, _ in rows} - set(gone))
    for percent in (80, 85):
        places = near_dup.layout(percent)
        assert sorted(p for band in places for p in band) == list(range(near_dup.REGISTERS))
        assert math.prod(1 - (percent / 100) ** len(band) for band in places) <= near_dup.MISS
    assert len(near_dup.layout(85)) == 42


def test_stages_with_clashing_columns_and_without_rows(spark, tmp_path):
    import corpus_pipeline as pipeline
    from pyspark.sql import functions as F

    rows = [(i, " ".join(words(90, 500 + i, 9000))) for i in range(12)]
    rows.append((20, rows[3][1]))
    spark.createDataFrame([(1, " ".join(words(20, 77, 9000)))], "item_id bigint, text string"
                          ).write.parquet(str(tmp_path / "benchmark.parquet"))
    names = ("score", "lang_pred", "switches", "n_words", "kept", "n_bytes", "n_removed", "n_spans",
             "kept_sha256", "row_number", "row", "hit", "stage_kept", "STAGE__x", "component_id")
    for n, given in enumerate((rows, [])):
        now = docs(spark, given)
        for name in names:
            now = now.withColumn(name, F.lit("0"))
        columns = now.columns
        for k, (_, stage) in enumerate(pipeline.STAGES):
            path = str(tmp_path / f"{n}-{k}")
            now = stage(spark, now, str(tmp_path))
            assert k == 4 or now.columns == columns
            now.write.parquet(path)
            now = spark.read.parquet(path)
        assert sorted(r.doc_id for r in now.collect()) == [i for i, _ in given[:12]]
