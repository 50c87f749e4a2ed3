import os
import tempfile

import pytest

from corpus_curator.constants import MD_SAMPLE_MARKER
from corpus_curator.sources import readers as RD
from corpus_curator.sources import writers as W


def _tmp(name):
    return os.path.join(tempfile.mkdtemp(prefix="cc-src-"), name)


def test_md_blocks(spark):
    path = _tmp("s.md")
    with open(path, "w") as fh:
        fh.write(f"{MD_SAMPLE_MARKER} one\n  line a  \n\nline b\n{MD_SAMPLE_MARKER}\n\n"
                 f"{MD_SAMPLE_MARKER} three\nonly\n")
    got = [(r["label"], r["text"]) for r in RD.read_raw(spark, path).orderBy("block").collect()]
    assert got == [("one", "line a\n\nline b"), ("three", "only")]


def test_raw_jsonl_precedence_and_corrupt_lines(spark):
    path = _tmp("r.jsonl")
    with open(path, "w") as fh:
        fh.write('{"instance_id": 4, "original_content": "{\\"raw_content\\": \\"R\\", '
                 '\\"clean_text\\": \\"C\\"}"}\n')
        fh.write('{"content": "X", "summary": "S"}\n')
        fh.write('{"summary": "S"}\n')
        fh.write('not json\n')
    rows = RD.read_raw(spark, path).collect()
    assert [r["text"] for r in rows[:3]] == ["C", "X", "S"]
    assert rows[3]["_corrupt_record"] == "not json"


def test_unknown_extension(spark):
    with pytest.raises(ValueError):
        RD.read_raw(spark, "/x/y.csv")


def test_pairs_roundtrip(spark):
    pairs = spark.createDataFrame([(0, 3, 4, False), (1, 4, 5, False), (2, 5, 3, True)],
                                  "pair_id long, id_1 long, id_2 long, added boolean")
    path = _tmp("pairs")
    W.write_pairs(pairs, path, n=3, compare=2)
    assert sorted(map(tuple, RD.read_pairs(spark, path).collect())) == sorted(
        map(tuple, pairs.collect()))
    meta = RD.read_pairs_meta(spark, path).first()
    assert (meta["n"], meta["n_pairs"], meta["compare"]) == (3, 3, 2)


def test_broken_lines_are_kept(spark):
    path = _tmp("j")
    os.makedirs(path)
    with open(os.path.join(path, "part.json"), "w") as fh:
        fh.write('{"task": "t", "pair_id": 1, "pair_ids": [1, 2], "win": "1", "why": "w"}\n\n')
        fh.write('{"task": "t", "pair_id": 2, "pa\n')
    got = {r["status"]: (r["pair_id"], r["_corrupt_record"])
           for r in RD.read_judgements(spark, path).collect()}
    assert got == {"ok": (1, None), "corrupt": (None, '{"task": "t", "pair_id": 2, "pa')}
    rows = RD.read_records(spark, path, "task string, pair_id long", dataset="d")
    assert sorted((r["status"], r["dataset"], r["pair_id"]) for r in rows.collect()) == [
        ("corrupt", "d", None), ("ok", "d", 1)]
    plain = RD.read_records(spark, path, "task string, pair_id long", rejects=False)
    assert plain.columns == ["task", "pair_id"] and plain.count() == 2


def test_taxonomy_roundtrip(spark):
    edges = spark.createDataFrame([("a", "b", "c"), ("a", "b", "d"), ("e", "f", "g")],
                                  "first string, second string, third string")
    path = _tmp("tax")
    W.write_taxonomy(edges, path)
    assert sorted(tuple(r) for r in RD.read_taxonomy(spark, path).collect()) == sorted(
        tuple(r) for r in edges.collect())


def test_templates(spark):
    from corpus_curator.functions.prompts import TEMPLATE_DIR, default_templates
    t = RD.load_templates(spark, TEMPLATE_DIR)
    assert t == default_templates() and "educational_value" in t


def test_mixed_number_and_string_scores(spark):
    from corpus_curator.operators.scores import clean_scores
    path = _tmp("rated")
    os.makedirs(path)
    with open(os.path.join(path, "part.json"), "w") as fh:
        fh.write('{"uuid": "a", "educational_value": 7, "obscurity": "8.5"}\n')
        fh.write('{"uuid": "b", "educational_value": "x", "obscurity": 3}\n')
        fh.write('{"uuid": "c", "educational_value": "101", "obscurity": 3}\n')
    df = RD.read_records(spark, path, RD.rated_schema(fields=["educational_value", "scarcity"]))
    out = clean_scores(df, ["educational_value", "scarcity"]).collect()
    assert [(r["uuid"], r["educational_value"], r["scarcity"]) for r in out] == [("a", 7.0, 8.5)]


def test_cluster_settings_scale_with_input(spark):
    from corpus_curator.session import cluster_settings
    small = cluster_settings(1 << 30, 64)
    big = cluster_settings(100 << 40, 8000)
    assert int(small["spark.sql.shuffle.partitions"]) == 128
    assert int(big["spark.sql.shuffle.partitions"]) == 200_000  # capped


def test_markdown_is_split_inside_files(spark, tmp_path):
    """One large file and small ones, whole and in many splits: the same blocks."""
    from corpus_curator.constants import MD_SAMPLE_MARKER as M
    body = "".join(f"{M} {i}\n  line one of {i} \nline two\n\n" for i in range(3000))
    files = {"a.md": body, "b.md": "before all\n" + body[:400], "c.md": f"{M}\n{M} 7\nx",
             "d.md": "", "e.md": "only text", "f.md": f"{M} last"}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    seen = []
    for size in ("128m", "2000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            rows = RD.read_md_samples(spark, str(tmp_path))
            seen.append(sorted((r.file.rsplit("/", 1)[1], r.block, r.label, r.text)
                               for r in rows.collect()))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
    assert seen[0] == seen[1]
    a = [r for r in seen[0] if r[0] == "a.md"]
    assert a[0] == ("a.md", 1, "0", "line one of 0\nline two") and len(a) == 3000
    assert [r[1] for r in a] == list(range(1, 3001))
    rest = {r[0]: [x[1:] for x in seen[0] if x[0] == r[0]] for r in seen[0] if r[0] > "b.md"}
    assert rest == {"c.md": [(2, "7", "x")], "e.md": [(0, None, "only text")]}
    assert [r for r in seen[0] if r[0] == "b.md"][0][1:] == (0, None, "before all")
