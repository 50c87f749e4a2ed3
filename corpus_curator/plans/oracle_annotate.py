"""Oracle SQL for prompts, annotators and annotation pipelines: the same
templates rendered by string concatenation and the same md5 reply rules."""

from __future__ import annotations

from ..constants import FAILED
from ..functions.prompts import default_templates, split_template
from . import oracle as O
from ..functions.rand import sql_uniform as U
from .oracle import NAMES_PROPER, cte, lit, with_

T = default_templates()
TASK = "educational_value"
NL = "chr(10)"
ZH = f"{U('doc_id', 'zh')} < 0.1"


def s_lit(text: str) -> str:
    """A SQL literal with newlines written as chr(10)."""
    return f" || {NL} || ".join(lit(p) for p in text.split("\n"))


def render(template: str, slots: dict, append: str | None = None) -> str:
    pieces, has = [], False
    for kind, val in split_template(template):
        if kind == "lit":
            pieces.append(s_lit(val))
        else:
            has = True
            pieces.append(f"({slots[val]})")
    if not has and append is not None:
        pieces.append(f"({append})")
    return "(" + " || ".join(pieces) + ")"


def hexint(h: str, start: int, n: int) -> str:
    return f"CAST(('0x' || substr({h}, {start}, {n})) AS INTEGER)"


def rate_reply(h: str) -> str:
    why = f"'Why: rule ' || substr({h}, 3, 4)"
    return (f"CASE WHEN substr({h}, 1, 1) = '0' THEN '{FAILED}' WHEN substr({h}, 2, 1) IN "
            f"('0','1','2','3','4','5','6','7') THEN 'Choice: 1' || {NL} || {why} "
            f"ELSE 'Choice: 2' || {NL} || {why} END")


def summary_reply(h: str) -> str:
    return (f"CASE WHEN substr({h}, 1, 1) = '0' THEN '{FAILED}' WHEN substr({h}, 1, 1) = '1' THEN "
            + lit('{"note": "none"}') + " ELSE " + lit('{"summary": "digest ')
            + f" || substr({h}, 1, 8) || " + lit('"}') + " END")


def _name(h: str) -> str:
    return f"{NAMES_PROPER}[{hexint(h, 2, 2)} % 21 + 1]"


def first_reply(h: str) -> str:
    return (f"CASE WHEN substr({h}, 1, 1) = '0' THEN '{FAILED}' WHEN substr({h}, 1, 1) = '1' THEN "
            + lit('{"tag": "Cooking", "explanation": "rule"}') + " ELSE " + lit('{"tag": "')
            + f" || {_name(h)} || " + lit('", "explanation": "rule"}') + " END")


def second_reply(h: str, f: str) -> str:
    second = f"({O.cap(f)} || ' s' || CAST({hexint(h, 2, 1)} % 5 AS VARCHAR))"
    third = f"({second} || ' t' || CAST({hexint(h, 3, 1)} % 4 AS VARCHAR))"
    return (f"CASE WHEN substr({h}, 1, 1) = '0' THEN '{FAILED}' ELSE "
            + lit('{"second_level_tag": "') + f" || {second} || " + lit('", "third_level_tag": "')
            + f" || {third} || " + lit('", "explanation": "rule"}') + " END")


def flat_reply(h: str) -> str:
    name = _name(h)
    f = f"lower({name})"
    a = f"CAST({hexint(h, 4, 1)} % 5 AS VARCHAR)"
    b = f"CAST({hexint(h, 5, 1)} % 4 AS VARCHAR)"
    path = (f"{name} || ' > ' || {f} || ' s' || {a} || ' > ' || {f} || ' s' || {a} || ' t' || {b}")
    return (f"CASE WHEN substr({h}, 1, 1) = '0' THEN '{FAILED}' ELSE "
            + lit('[{"tag": "') + f" || {path} || " + lit('", "explanation": "rule"}, {"tag": "')
            + f" || {name} || " + lit(' > misc", "explanation": "rule"}]') + " END")


def edit_reply(h: str) -> str:
    return f"CASE WHEN substr({h}, 1, 1) = '0' THEN NULL ELSE '[edited ' || substr({h}, 1, 12) || ']' END"


# prompts
cte("ptexts", "SELECT p.pair_id, p.id_1, p.id_2, a.text AS text_1, b.text AS text_2 FROM pairs p "
    "JOIN documents a ON a.doc_id = p.id_1 JOIN documents b ON b.doc_id = p.id_2", ["pairs"])
cte("pprompt", "SELECT pair_id, id_1, id_2, " + render(T[TASK], {"text_1": "text_1", "text_2": "text_2"})
    + " AS prompt FROM ptexts", ["ptexts"])
cte("subtree2", "SELECT first, second, '{' || string_agg('\"' || third || '\":\"\"', ',' ORDER BY "
    "third) || '}' AS m FROM (SELECT DISTINCT lower(first) AS first, second, third FROM taxonomy) "
    "GROUP BY first, second", ["taxonomy"])
cte("subtree", "SELECT first, '{' || string_agg('\"' || second || '\":' || m, ',' ORDER BY second) "
    "|| '}' AS tag_tree FROM subtree2 GROUP BY first", ["subtree2"])


def subtree_prompt(text: str, first: str) -> str:
    return render(T["tag_second_third_level"], {"instance": text,
                                                  "first_level_tag": first, "tag_tree": "s.tag_tree"})


# annotation chain
cte("summ", "SELECT instance_id, reply, body, " + O._obj_status(("summary",)) + " AS status, "
    "CASE WHEN keys IS NOT NULL THEN body->>'summary' END AS summary FROM (SELECT *, "
    + O._keys("body") + " AS keys FROM (SELECT *, " + O._body("reply") + " AS body FROM "
    "(SELECT instance_id, " + summary_reply("h") + " AS reply FROM (SELECT doc_id AS instance_id, "
    "md5(" + render(T["summary"], {"instance": "text"}) + ") AS h "
    "FROM documents))))")
cte("summ_ok", "SELECT instance_id, summary FROM summ WHERE status = 'ok'", ["summ"])
cte("first", "SELECT instance_id, summary, CASE WHEN st = 'ok' AND NOT coalesce(list_contains("
    f"{NAMES_PROPER}, tag), false) THEN 'bad_first_level' ELSE st END AS status, tag, expl FROM "
    "(SELECT instance_id, summary, " + O._obj_status(("tag", "explanation")) + " AS st, "
    "CASE WHEN keys IS NOT NULL THEN body->>'tag' END AS tag, CASE WHEN keys IS NOT NULL THEN "
    "body->>'explanation' END AS expl FROM (SELECT *, " + O._keys("body") + " AS keys FROM "
    "(SELECT *, " + O._body("reply") + " AS body FROM (SELECT instance_id, summary, "
    + first_reply("h") + " AS reply FROM (SELECT instance_id, summary, md5("
    + render(T["tag_first_level"], {"instance": "summary"}) + ") AS h "
    "FROM summ_ok)))))", ["summ_ok"])
cte("first_ok", "SELECT instance_id, summary, lower(tag) AS first_level_tag, expl AS "
    "first_level_explanation FROM first WHERE status = 'ok'", ["first"])
cte("second", "SELECT instance_id, summary, CASE WHEN st = 'ok' THEN lower(first_level_tag) ELSE "
    "first_level_tag END AS first_level_tag, CASE WHEN st = 'ok' THEN lower(sl) END AS "
    "second_level_tag, CASE WHEN st = 'ok' THEN lower(tl) END AS third_level_tag, st AS status "
    "FROM (SELECT r.*, CASE WHEN r.st0 = 'ok' AND x.first IS NULL THEN 'bad_path' ELSE r.st0 END "
    "AS st FROM (SELECT *, CASE WHEN has_tree THEN " + O._obj_status(
        ("second_level_tag", "third_level_tag", "explanation")) + " ELSE 'bad_first_level' END "
    "AS st0, CASE WHEN keys IS NOT NULL THEN body->>'second_level_tag' END AS sl, "
    "CASE WHEN keys IS NOT NULL THEN body->>'third_level_tag' END AS tl FROM (SELECT *, "
    + O._keys("body") + " AS keys FROM (SELECT *, " + O._body("reply") + " AS body FROM "
    "(SELECT instance_id, summary, first_level_tag, has_tree, " + second_reply("h", "first_level_tag")
    + " AS reply FROM (SELECT f.instance_id, f.summary, f.first_level_tag, s.first IS NOT NULL AS "
    "has_tree, md5(" + subtree_prompt("f.summary", "f.first_level_tag") + ") AS h FROM first_ok f "
    "LEFT JOIN subtree s ON s.first = lower(f.first_level_tag)))))) r LEFT JOIN (SELECT DISTINCT "
    "lower(first) AS first, second, third FROM taxonomy) x ON x.first = lower(r.first_level_tag) "
    "AND x.second = r.sl AND x.third = r.tl)", ["first_ok", "subtree", "taxonomy"])

SQL: dict[str, str] = {}
SQL["q_render_pair_prompt"] = with_(["pprompt"], "SELECT pair_id, md5(prompt) AS prompt_md5, "
                                    "length(prompt) AS prompt_len FROM pprompt")
SQL["q_render_prompt"] = ("SELECT doc_id, md5(" + render(T["summary"], {
    "instance": "text"}) + ") AS prompt_md5 FROM documents")
SQL["q_render_subtree_prompt"] = with_(
    ["tagged", "subtree"], "SELECT t.doc_id, CASE WHEN s.first IS NULL THEN 'bad_first_level' ELSE "
    "'ok' END AS status, CASE WHEN s.first IS NOT NULL THEN md5(" + subtree_prompt(
        "d.text", "t.first_level_tag") + ") END AS prompt_md5 FROM tagged t JOIN documents d ON "
    "d.doc_id = t.doc_id LEFT JOIN subtree s ON s.first = lower(t.first_level_tag)")
SQL["q_render_edit_prompt"] = (
    "SELECT doc_id, md5(CASE WHEN " + ZH + " THEN " + render(T["edit_zh"], {"": "text"}, "text")
    + " ELSE " + render(T["edit_en"], {"": "text"}, "text") + " END) AS prompt_md5 FROM documents")
SQL["q_classify_prompt_size"] = with_(
    ["pprompt"], "SELECT pair_id, n_tokens, CASE WHEN n_tokens < 3800 THEN 'small' WHEN n_tokens < "
    "16000 THEN 'large' ELSE 'fail' END AS size_class FROM (SELECT pair_id, "
    "len(regexp_extract_all(prompt, " + lit(r"[\x{4e00}-\x{9fff}]|[\p{L}\p{N}]+") + ")) AS n_tokens "
    "FROM pprompt)")
def rate_rows(prompts: str) -> str:
    return (
    "SELECT pair_id, id_1, id_2, reply, status, CASE WHEN status = 'ok' THEN choices[1] END "
    "AS win, CASE WHEN status = 'ok' THEN regexp_extract(r, 'Why: ([^\\n]*)', 1) END AS why FROM "
    f"(SELECT *, CASE WHEN reply IS NULL OR reply = '{FAILED}' THEN 'failed' WHEN len(choices) <> 1 THEN 'no_choice' "
    "ELSE 'ok' END AS status FROM (SELECT *, regexp_extract_all(r, 'Choice: ([12])', 1) AS choices "
    "FROM (SELECT *, regexp_replace(reply, '^\\s+|\\s+$', '', 'g') AS r FROM (SELECT pair_id, id_1, "
    "id_2, " + rate_reply("md5(prompt)") + f" AS reply FROM {prompts}))))")


cte("arate", rate_rows("pprompt"), ["pprompt"])
SQL["q_annotate_rate"] = with_(["arate"], f"SELECT '{TASK}' AS task, pair_id, status, win, why "
                               "FROM arate")
SQL["q_annotate_summary"] = with_(["summ"], "SELECT instance_id, status, CASE WHEN status = 'ok' "
                                  "THEN summary END AS summary FROM summ")
SQL["q_annotate_first_level"] = with_(["first"], "SELECT instance_id, status, CASE WHEN status = "
                                      "'ok' THEN lower(tag) END AS first_level_tag FROM first")
SQL["q_annotate_second_third"] = with_(["second"], "SELECT instance_id, status, first_level_tag, "
                                       "second_level_tag, third_level_tag FROM second")
_items = ("CASE WHEN body IS NOT NULL AND json_valid(body) AND json_type(body) = 'ARRAY' THEN "
          "CAST(json_extract(body, '$[*]') AS JSON[]) END")
_kept = ("list_filter(items, lambda x: len(string_split(x->>'tag', '>')) = 3 AND coalesce("
         "list_contains(" + NAMES_PROPER + ", regexp_replace(string_split(x->>'tag', '>')[1], '^\\s+|\\s+$', '', 'g')), false))")
SQL["q_annotate_flat"] = (
    "SELECT instance_id, status, CASE WHEN status = 'ok' THEN len(kept) END AS n_tags, "
    "CASE WHEN status = 'ok' THEN array_to_string(list_transform(kept, lambda x: x->>'tag'), '|') "
    f"END AS tags_joined FROM (SELECT instance_id, kept, CASE WHEN reply IS NULL OR reply = '{FAILED}' THEN 'failed' "
    "WHEN items IS NULL THEN 'no_json' WHEN NOT list_bool_and(list_transform(items, lambda x: "
    "json_exists(x, '$.tag') AND json_exists(x, '$.explanation'))) THEN 'missing_key' WHEN "
    "len(kept) = 0 THEN 'not_three_levels' ELSE 'ok' END AS status FROM (SELECT instance_id, reply, "
    "items, " + _kept + " AS kept FROM (SELECT instance_id, reply, " + _items + " AS items FROM "
    "(SELECT instance_id, reply, " + O._body("reply") + " AS body FROM (SELECT doc_id AS instance_id, "
    + flat_reply("md5(" + render(T["tag"], {"instance": "text"}) + ")")
    + " AS reply FROM documents)))))")
SQL["q_annotate_edit"] = (
    "SELECT doc_id, " + edit_reply("h") + " AS edited_text FROM (SELECT doc_id, md5(CASE WHEN "
    + ZH + " THEN " + render(T["edit_zh"], {"": "text"}, "text") + " ELSE "
    + render(T["edit_en"], {"": "text"}, "text") + " END) AS h FROM documents)")

# rating pipeline: the same chain over two criteria
cte("pprompt_2", "SELECT pair_id, id_1, id_2, " + render(
    T["expertise"], {"text_1": "text_1", "text_2": "text_2"}) + " AS prompt FROM ptexts", ["ptexts"])
cte("arate_2", rate_rows("pprompt_2"), ["pprompt_2"])
cte("rmatches", "SELECT task, CASE WHEN win = '1' THEN id_1 ELSE id_2 END AS winner, CASE WHEN "
    f"win = '1' THEN id_2 ELSE id_1 END AS loser FROM (SELECT '{TASK}' AS task, id_1, id_2, win FROM "
    "arate WHERE status = 'ok' UNION ALL SELECT 'expertise', id_1, id_2, win FROM arate_2 WHERE "
    "status = 'ok')", ["arate", "arate_2"])
SQL["q_rate_scores"] = with_(
    ["rmatches"], "SELECT task, id, CAST(sum(w) AS BIGINT) AS wins, CAST(sum(1 - w) AS BIGINT) AS "
    "losses, CAST(0.0 AS DOUBLE) AS residual FROM (SELECT task, winner AS id, 1 AS w FROM rmatches "
    "UNION ALL SELECT task, loser, 0 FROM rmatches) GROUP BY task, id")
SQL["q_tag_documents"] = with_(["second"], "SELECT instance_id, first_level_tag, second_level_tag, "
                              "third_level_tag, true AS in_tree FROM second WHERE status = 'ok'")

