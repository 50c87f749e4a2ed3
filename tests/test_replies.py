from corpus_curator.functions import replies as RP


def _one(spark, reply):
    return spark.createDataFrame([(reply,)], "reply string")


def test_choice_edge_table(spark):
    cases = [("Choice: 1\nWhy: because", "ok", "1", "because"),
             ("Choice: 12", "ok", "1", ""),
             ("Choice: 1 Choice: 2", "no_choice", None, None),
             ("<<FAILED>>", "failed", None, None),
             ("  Choice: 2\nWhy: a b\nWhy: z", "ok", "2", "a b")]
    for reply, status, win, why in cases:
        r = RP.parse_choice(_one(spark, reply)).first()
        assert (r["status"], r["win"], r["why"]) == (status, win, why), reply


def test_first_level_edge_table(spark):
    cases = [("{'tag':'Law','explanation':'x'}", "ok"),
             ('{"tag":"Law",}', "no_json"),
             ('{"tag":null,"explanation":"x"}', "bad_first_level"),
             ('{"tag":"Law","explanation":"x"} trailing', "no_json"),
             ('{"a":1} x }', "no_json"),  # text after the first value
             ('{"tag":"law","explanation":"x"}', "bad_first_level"),
             ("nope", "no_json"),
             ("```json\n{\"tag\": \"Law\", \"explanation\": \"x\"}\n```", "ok"),
             ('{"tag":"Law"}', "missing_key")]
    for reply, status in cases:
        r = RP.validate_first_level(_one(spark, reply)).first()
        assert r["status"] == status, (reply, r["status"])
    ok = RP.validate_first_level(_one(spark, '{"tag":"Law","explanation":"x"}')).first()
    assert ok["first_level_tag"] == "law"


def test_fence_only_when_exact(spark):
    df = spark.createDataFrame([(" ```json\n{}\n```",), ("```json\n{\"a\": 1}\n```",)], "r string")
    got = [r[0] for r in df.select(RP.remove_fence("r")).collect()]
    assert got == [" ```json\n{}\n```", '{"a": 1}']


def test_flat_tags(spark):
    reply = ('[{"tag": "Law > courts > appeals", "explanation": "x"}, '
             '{"tag": "Law > misc", "explanation": "y"}, {"tag": "Cooking > a > b", "explanation": "z"}]')
    r = RP.validate_flat_tags(_one(spark, reply)).first()
    assert r["status"] == "ok" and [t["tag"] for t in r["tags"]] == ["Law > courts > appeals"]
    bad = RP.validate_flat_tags(_one(spark, '[{"tag": "Law > a > b"}]')).first()
    assert bad["status"] == "missing_key"


def test_second_third_path_check(spark):
    tax = spark.createDataFrame([("law", "courts", "appeals")], "first string, second string, third string")
    df = spark.createDataFrame([
        ("Law", '{"second_level_tag": "courts", "third_level_tag": "appeals", "explanation": "x"}'),
        ("Law", '{"second_level_tag": "courts", "third_level_tag": "other", "explanation": "x"}')],
        "first_level_tag string, reply string")
    got = [r["status"] for r in RP.validate_second_third(df, tax).orderBy("reply").collect()]
    assert sorted(got) == ["bad_path", "ok"]


def test_null_reply_is_failed(spark):
    df = spark.createDataFrame([(None,)], "reply string")
    assert RP.parse_choice(df).first()["status"] == "failed"
    assert RP.validate_first_level(df).first()["status"] == "failed"
    assert RP.validate_flat_tags(df).first()["status"] == "failed"


def test_literal_mode_matches_python_literal_rules(spark):
    # reference outcomes of the record edge table, reproduced with literal_eval
    cases = [("{'tag':'Law','explanation':'x'}", "ok"),
             ('{"tag":"Law",}', "missing_key"),              # parses, then a key is missing
             ("{'tag':None,'explanation':'x'}", "bad_first_level"),
             ('{"tag":"Law","explanation":"x"} trailing', "no_json"),
             ('{"tag":"law","explanation":"x"}', "bad_first_level"),
             ("nope", "no_json"),
             ("__import__('os').system('true')", "no_json")]  # never executed
    for reply, status in cases:
        r = RP.validate_first_level(_one(spark, reply), literal=True).first()
        assert r["status"] == status, (reply, r["status"])
    flat = RP.validate_flat_tags(_one(spark, "[{'tag': 'Law > a > b', 'explanation': 'x'}]"),
                                 literal=True).first()
    assert flat["status"] == "ok"


def test_split_status(spark):
    df = spark.createDataFrame([("Choice: 1",), ("nothing",)], "reply string")
    ok, rejected = RP.split_status(RP.parse_choice(df))
    assert ok.count() == 1 and [r["status"] for r in rejected.collect()] == ["no_choice"]
