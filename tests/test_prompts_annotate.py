import json

from pyspark.sql import functions as F

from corpus_curator.constants import FAILED
from corpus_curator.functions import prompts as PR
from corpus_curator.operators.annotate import annotate


def test_split_template_escapes():
    assert PR.split_template("a {{x}} {y} {}") == [("lit", "a {x} "), ("slot", "y"), ("lit", " "),
                                                   ("slot", "")]


def test_render_does_not_reexpand(spark):
    df = spark.createDataFrame([("has {text_2} inside", "B")], "text_1 string, text_2 string")
    out = PR.render_pair_prompt(df, "1:{text_1}|2:{text_2}").first()["prompt"]
    assert out == "1:has {text_2} inside|2:B"


def test_edit_prompt_appends_without_slot(spark):
    df = spark.createDataFrame([("zh", "T"), ("en", "T")], "lang string, text string")
    got = PR.render_edit_prompt(df, {"edit_en": "E[{}]", "edit_zh": "Z:"}).collect()
    assert [r["prompt"] for r in got] == ["Z:T", "E[T]"]


def test_subtree_json_sorted(spark):
    tax = spark.createDataFrame([("Law", "b", "y"), ("Law", "a", "z"), ("Law", "a", "x")],
                                "first string, second string, third string")
    row = PR.subtree_json(tax).first()
    assert row["first"] == "law"
    assert json.loads(row["tag_tree"]) == {"a": {"x": "", "z": ""}, "b": {"y": ""}}
    assert row["tag_tree"].index('"a"') < row["tag_tree"].index('"b"')


def test_size_classes(spark):
    df = spark.createDataFrame([("word " * 10,), ("w " * 5000,), ("w " * 20000,), ("中文字",)],
                               "prompt string")
    got = [(r["n_tokens"], r["size_class"]) for r in PR.classify_prompt_size(df).collect()]
    assert got == [(10, "small"), (5000, "large"), (20000, "fail"), (3, "small")]


def test_annotate_failures_and_modes(spark):
    df = spark.createDataFrame([(str(i),) for i in range(30)] + [(None,)], "prompt string")

    def fn(p):
        if p == "3":
            raise RuntimeError("service down")
        return "r" + p

    got = {r["prompt"]: r["reply"] for r in annotate(df, fn, batch_size=7, threads=3).collect()}
    assert got["3"] == FAILED and got["4"] == "r4" and got[None] is None
    vec = annotate(df.filter(F.col("prompt").isNotNull()), lambda s: s.str.upper() + "!",
                   vectorized=True)
    assert vec.filter(F.col("reply") == F.concat("prompt", F.lit("!"))).count() == 30


def test_pandas_token_counter(spark):
    df = spark.createDataFrame([("a b c",), ("x" * 5,)], "prompt string")
    counter = PR.pandas_token_counter(lambda p: len(p.split()))
    got = [r["n_tokens"] for r in PR.classify_prompt_size(df, counter=counter).collect()]
    assert got == [3, 1]


def test_second_third_job_routes_unknown_first_tag(spark):
    from corpus_curator.functions.annotators import second_third_rule
    from corpus_curator.operators.annotate import tag_second_third
    tax = spark.createDataFrame([("Law", f"Law s{i}", f"Law s{i} t{j}") for i in range(5)
                                 for j in range(4)], "first string, second string, third string")
    recs = spark.createDataFrame([(1, "a summary", "law", "x"), (2, "b summary", "cooking", "y")],
                                 "instance_id long, summary string, first_level_tag string, "
                                 "first_level_explanation string")
    got = {r["instance_id"]: r for r in tag_second_third(recs, tax, second_third_rule).collect()}
    assert got[2]["status"] == "bad_first_level"
    assert got[1]["status"] in ("ok", "failed")
    if got[1]["status"] == "ok":
        assert got[1]["third_level_tag"].startswith(got[1]["second_level_tag"])


def test_vectorized_wrong_length_falls_back(spark):
    import pandas as pd
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "prompt string")

    def fn(s):
        if isinstance(s, pd.Series):
            return pd.Series(["only one"])
        return "r" + s

    got = sorted(r["reply"] for r in annotate(df, fn, vectorized=True, partitions=1).collect())
    assert got == ["ra", "rb", "rc"]


def test_batch_error_is_kept(spark):
    df = spark.createDataFrame([("a",), (None,)], "prompt string")

    def fn(s):
        raise RuntimeError("down")

    got = {r["prompt"]: (r["reply"], r["error"]) for r in annotate(
        df, fn, vectorized=True, error_col="error").collect()}
    assert got == {"a": (FAILED, "RuntimeError: down; batch: RuntimeError: down"),
                   None: (None, None)}


def test_other_columns_pass_untouched_and_prompts_stay_behind(spark):
    big = 2 ** 53 + 1
    df = spark.createDataFrame([("a", big), ("b", None), (None, 3)], "prompt string, key long")
    kept = annotate(df, str.upper, partitions=1)
    assert {(r["key"], r["prompt"], r["reply"]) for r in kept.collect()} == {
        (big, "a", "A"), (None, "b", "B"), (3, None, None)}
    bare = annotate(df, str.upper, keep_prompt=False)
    assert bare.columns == ["key", "reply"]
    assert {tuple(r) for r in bare.collect()} == {(big, "A"), (None, "B"), (3, None)}


def test_parts_of_a_batch_are_whole_groups_of_few_bytes():
    import pyarrow as pa
    from corpus_curator.operators.annotate import PART_BYTES, _whole_groups
    batch = pa.RecordBatch.from_pydict({"prompt": ["x" * 4000] * 10_000})
    step = _whole_groups(batch, 25)
    assert step % 25 == 0 and 0 < step * 4000 <= PART_BYTES
    assert _whole_groups(pa.RecordBatch.from_pydict({"prompt": ["x" * PART_BYTES] * 2}), 25) == 25
    assert _whole_groups(batch.slice(0, 0), 25) >= 25


def test_tasks_share_the_texts_of_a_pair(spark):
    from corpus_curator.functions.annotators import rate_rule
    from corpus_curator.operators.annotate import rate_pairs
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    pairs = spark.createDataFrame([(i, i, (i * 7 + 1) % 20) for i in range(20)],
                                  "pair_id long, id_1 long, id_2 long")
    tasks = ["educational_value", "expertise"]
    both = rate_pairs(docs, pairs, tasks, rate_rule)
    apart = [rate_pairs(docs, pairs, t, rate_rule) for t in tasks]
    assert sorted(map(str, both.collect())) == sorted(
        str(r) for x in apart for r in x.collect())
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 2
