import os
import tempfile

from corpus_curator.functions.annotators import summary_rule
from corpus_curator.streaming.annotate_stream import annotate_stream, read_annotated
from corpus_curator.streaming.resume import remaining_stream

SCHEMA = "instance_id long, prompt string"


def test_only_new_files_are_annotated(spark):
    base = tempfile.mkdtemp(prefix="cc-stream-")
    src, out, ck = (os.path.join(base, d) for d in ("in", "out", "ck"))
    os.makedirs(src)

    def add(i):
        with open(os.path.join(src, f"f{i}.json"), "w") as fh:
            fh.write(f'{{"instance_id": {i}, "prompt": "p{i}"}}\n')

    counts = []
    for step in range(3):
        if step < 2:
            add(step)
        annotate_stream(spark, src, out, ck, summary_rule, SCHEMA)
        counts.append(read_annotated(spark, out, SCHEMA + ", reply string").count())
    assert counts == [1, 2, 2]


def test_an_id_in_two_files_passes_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / d) for d in ("in", "out", "ck"))
    schema = "pair_id long, prompt string"
    seen = []
    for rows in ([(1, "a"), (2, "b"), (2, "b"), (None, "x"), (None, "y")],
                 [(2, "b"), (3, "c"), (None, "x")], [(1, "a")], []):
        if rows:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(src)
        remaining_stream(spark, src, out, ck, schema)  # every run is a restart
        got = read_annotated(spark, out, schema).collect()
        seen.append(sorted((str(r["pair_id"]), r["prompt"]) for r in got))
    first = [("1", "a"), ("2", "b"), ("None", "x"), ("None", "y")]
    assert seen[0] == first and seen[1] == seen[2] == seen[3] == sorted([*first, ("3", "c")])


def test_annotation_by_key(spark, tmp_path):
    src, out, ck = (str(tmp_path / d) for d in ("in", "out", "ck"))
    for i in (1, 2):
        spark.createDataFrame([(1, "p1"), (i, f"p{i}")], SCHEMA).write.mode("append").json(src)
        annotate_stream(spark, src, out, ck, summary_rule, SCHEMA, key="instance_id")
    got = read_annotated(spark, out, SCHEMA + ", reply string").collect()
    assert sorted(r["instance_id"] for r in got) == [1, 2]
