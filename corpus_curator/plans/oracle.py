"""Oracle SQL (DuckDB) for the registered queries.

Each query is written independently as plain SQL over the driver's views
(``documents``, ``benchmark``, ...). The derived record shapes are the same md5
rules as ``sources.derived``, written once more as SQL, so the two engines are
compared on identical inputs. Windows over the whole table are fine here: the
oracle runs on one machine at a small scale factor.
"""

from __future__ import annotations

from ..constants import FIRST_LEVEL_TAGS, RATING_WEIGHTS, SCORE_FIELDS
from ..functions.rand import sql_uniform as U
from ..operators.scores import NUMBER_RE

SEED = 7


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def list_lit(items) -> str:
    return "[" + ", ".join(lit(x) for x in items) + "]"


NAMES_LOWER = list_lit([n.lower() for n in FIRST_LEVEL_TAGS])
NAMES_PROPER = list_lit(FIRST_LEVEL_TAGS)
BOOST = ["law", "education s1", "sports s0 t2", "military s2 t1"]


def uuid_sql(key: str) -> str:
    h = f"md5(CAST({key} AS VARCHAR))"
    return (f"(substr({h},1,8) || '-' || substr({h},9,4) || '-' || substr({h},13,4) || '-' "
            f"|| substr({h},17,4) || '-' || substr({h},21,12))")


def _dirty(f: str) -> str:
    u, v = U("doc_id", f), U("doc_id", f"{f}:v")
    return (f"CASE WHEN {u} < 0.01 THEN 'n/a' WHEN {u} < 0.02 THEN '-3' WHEN {u} < 0.03 THEN '104' "
            f"WHEN {u} < 0.035 THEN NULL WHEN {u} < 0.04 THEN 'nan' "
            f"ELSE CAST(CAST(floor(101 * {v}) AS INTEGER) AS VARCHAR) END")


def _valid(f: str) -> str:
    c = q(f)
    x = f"CASE WHEN regexp_matches({c}, {lit(NUMBER_RE)}) THEN TRY_CAST(trim({c}) AS DOUBLE) END"
    return f"CASE WHEN {x} BETWEEN 0 AND 100 THEN {x} END"


FIELDS_Q = ", ".join(q(f) for f in SCORE_FIELDS)

CTES: dict[str, tuple[str, list[str]]] = {}


def cte(name: str, sql: str, deps=()):
    CTES[name] = (sql, list(deps))


cte("corpus", f"SELECT *, {uuid_sql('doc_id')} AS uuid FROM documents")
cte("rated", f"SELECT {uuid_sql('doc_id')} AS uuid, source AS dataset, doc_id, "
    + ", ".join(f"{_dirty(f)} AS {q(f)}" for f in SCORE_FIELDS) + " FROM documents")
cte("clean", "SELECT * FROM (SELECT uuid, dataset, doc_id, "
    + ", ".join(f"{_valid(f)} AS {q(f)}" for f in SCORE_FIELDS) + " FROM rated) WHERE "
    + " AND ".join(f"{q(f)} IS NOT NULL" for f in SCORE_FIELDS), ["rated"])
cte("stats", "SELECT " + ", ".join(
    f"avg({q(f)}) AS {q(f + '_mean')}, stddev_samp({q(f)}) AS {q(f + '_std')}"
    for f in SCORE_FIELDS) + " FROM clean", ["clean"])
cte("zs", "SELECT uuid, dataset, " + ", ".join(
    f"exp(({q(f)} - {q(f + '_mean')}) / {q(f + '_std')}) AS {q(f)}" for f in SCORE_FIELDS)
    + " FROM clean, stats WHERE " + " AND ".join(
        f"({q(f)} - {q(f + '_mean')}) / {q(f + '_std')} IS NOT NULL" for f in SCORE_FIELDS),
    ["clean", "stats"])
cte("rweight", "SELECT uuid, dataset, " + " + ".join(
    f"{q(f)} * {w!r}" for f, w in RATING_WEIGHTS.items()) + " AS weight FROM zs", ["zs"])

cte("tagged_raw", f"SELECT doc_id, source, {U('doc_id', 'tree')} AS ut, "
    f"{NAMES_LOWER}[CAST(floor(21 * {U('doc_id', 't1')} * {U('doc_id', 't1')}) AS INTEGER) + 1] AS f, "
    f"CAST(CAST(floor(5 * {U('doc_id', 't2')} * {U('doc_id', 't2')}) AS INTEGER) AS VARCHAR) AS sx, "
    f"CAST(CAST(floor(4 * {U('doc_id', 't3')}) AS INTEGER) AS VARCHAR) AS tx FROM documents")
cte("tagged", f"SELECT {uuid_sql('doc_id')} AS uuid, source AS dataset, doc_id, "
    "f AS first_level_tag, f || ' s' || sx AS second_level_tag, "
    "f || ' s' || sx || ' t' || tx AS third_level_tag, "
    "CASE WHEN ut < 0.02 THEN NULL ELSE ut >= 0.1 END AS in_tree FROM tagged_raw", ["tagged_raw"])
def cap(c: str) -> str:
    return f"(upper(substr({c}, 1, 1)) || substr({c}, 2))"


cte("taxonomy", f"SELECT DISTINCT {cap('first_level_tag')} AS first, {cap('second_level_tag')} AS "
    f"second, {cap('third_level_tag')} AS third FROM tagged WHERE {U('third_level_tag')} >= 0.1",
    ["tagged"])
cte("tin", "SELECT * FROM tagged WHERE in_tree", ["tagged"])
cte("lv3", "SELECT first_level_tag, second_level_tag, third_level_tag, count(*) AS count_c "
    "FROM tin WHERE first_level_tag IS NOT NULL AND second_level_tag IS NOT NULL "
    "AND third_level_tag IS NOT NULL GROUP BY ALL", ["tin"])
cte("lv2", "SELECT first_level_tag, second_level_tag, CAST(sum(count_c) AS BIGINT) AS count_b, "
    "sum(pow(count_c, 0.5)) AS sum_weight_c FROM lv3 GROUP BY ALL", ["lv3"])
cte("lv1", "SELECT first_level_tag, CAST(sum(count_b) AS BIGINT) AS count_a, sum(pow(count_b, 0.5)) AS sum_weight_b "
    "FROM lv2 GROUP BY ALL", ["lv2"])
cte("lva", "SELECT sum(pow(count_a, 0.5)) AS sum_weight_a FROM lv1", ["lv1"])
cte("lvl", "SELECT lv3.first_level_tag, lv3.second_level_tag, lv3.third_level_tag, "
    "count_c, count_b, count_a, sum_weight_c, sum_weight_b, sum_weight_a FROM lv3 "
    "JOIN lv2 USING (first_level_tag, second_level_tag) JOIN lv1 USING (first_level_tag), lva",
    ["lv3", "lv2", "lv1", "lva"])
cte("tprob", "SELECT t.*, pow(count_a, 0.5) * (pow(count_b, 0.5) / sum_weight_b) * "
    "(pow(count_c, 0.5) / sum_weight_c) / count_c AS probability, sum_weight_a "
    "FROM tin t JOIN lvl USING (first_level_tag, second_level_tag, third_level_tag)",
    ["tin", "lvl"])
cte("tboost", "SELECT *, probability * CASE WHEN first_level_tag IN (SELECT unnest("
    + list_lit(BOOST) + ")) THEN 2.0 WHEN second_level_tag IN (SELECT unnest(" + list_lit(BOOST)
    + ")) THEN 3.0 WHEN third_level_tag IN (SELECT unnest(" + list_lit(BOOST)
    + ")) THEN 4.0 ELSE 1.0 END AS weight FROM tprob", ["tprob"])
cte("rkeys", f"SELECT uuid, -ln({U('uuid', SEED)}) / weight AS sk FROM rweight WHERE weight > 0",
    ["rweight"])
cte("rsample", "SELECT uuid FROM (SELECT uuid, row_number() OVER (ORDER BY sk, uuid) AS rn "
    "FROM rkeys) WHERE rn <= (SELECT count(*) // 2 FROM rkeys)", ["rkeys"])
cte("tkeys", f"SELECT uuid, dataset, -ln({U('uuid', SEED)}) / weight AS sk FROM tboost "
    "WHERE weight > 0", ["tboost"])
cte("tquota", "SELECT dataset, count(*) // 2 AS need FROM tkeys GROUP BY dataset", ["tkeys"])
cte("tsample", "SELECT uuid, dataset FROM (SELECT k.uuid, k.dataset, need, row_number() OVER "
    "(PARTITION BY k.dataset ORDER BY sk, uuid) AS rn FROM tkeys k JOIN tquota USING (dataset)) "
    "WHERE rn <= need", ["tkeys", "tquota"])


def with_(names, body: str) -> str:
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for d in CTES[n][1]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][0]})" for n in order) + "\n" + body


def r6(expr: str, name: str) -> str:
    return f"(round({expr}, 6) + 0.0) AS {q(name)}"


SQL: dict[str, str] = {}

SQL["q_clean_scores"] = with_(["clean"], f"SELECT uuid, dataset, {FIELDS_Q} FROM clean")
SQL["q_score_stats"] = with_(["stats"], "SELECT " + ", ".join(
    r6(q(f + s), f + s) for f in SCORE_FIELDS for s in ("_mean", "_std")) + " FROM stats")
SQL["q_exp_zscores"] = with_(["zs"], "SELECT uuid, " + ", ".join(
    r6(q(f), f) for f in SCORE_FIELDS) + " FROM zs")
SQL["q_rating_weight"] = with_(["rweight"], f"SELECT uuid, {r6('weight', 'weight')} FROM rweight")

SQL["q_tag_counts_l1"] = with_(["tagged"], "SELECT first_level_tag, count(*) AS count "
                               "FROM tagged GROUP BY ALL")
SQL["q_tag_counts_l2"] = with_(["tagged"], "SELECT first_level_tag, second_level_tag, "
                               "count(*) AS count FROM tagged GROUP BY ALL")
SQL["q_tag_counts_l3"] = with_(["tagged"], "SELECT first_level_tag, second_level_tag, "
                               "third_level_tag, count(*) AS count FROM tagged GROUP BY ALL")
SQL["q_tag_level_table"] = with_(["lvl"], "SELECT first_level_tag, second_level_tag, "
                                 "third_level_tag, count_c, count_b, count_a, "
                                 + r6("sum_weight_c", "sum_weight_c") + ", "
                                 + r6("sum_weight_b", "sum_weight_b") + ", "
                                 + r6("sum_weight_a", "sum_weight_a") + " FROM lvl")
SQL["q_tag_probability"] = with_(["tprob"], "SELECT uuid, first_level_tag, second_level_tag, "
                                 "third_level_tag, " + r6("probability", "probability")
                                 + " FROM tprob")
SQL["q_tag_probability_normalized"] = with_(
    ["tprob"], "SELECT uuid, first_level_tag, second_level_tag, third_level_tag, "
    + r6("probability / sum_weight_a", "probability") + " FROM tprob")
SQL["q_filter_in_tree"] = with_(["tin"], "SELECT uuid, first_level_tag, second_level_tag, "
                                "third_level_tag FROM tin")
SQL["q_mark_in_tree"] = with_(
    ["tagged", "taxonomy"], "SELECT t.uuid, x.first IS NOT NULL AS path_in_tree FROM tagged t LEFT "
    "JOIN (SELECT DISTINCT lower(first) AS first, lower(second) AS second, lower(third) AS third "
    "FROM taxonomy) x ON x.first = lower(t.first_level_tag) AND x.second = lower("
    "t.second_level_tag) AND x.third = lower(t.third_level_tag)")
SQL["q_boost_weight"] = with_(["tboost"], f"SELECT uuid, {r6('weight', 'weight')} FROM tboost")

SQL["q_weighted_sample"] = with_(["rsample"], "SELECT uuid FROM rsample")
SQL["q_weighted_sample_by"] = with_(
    ["tprob"],
    f"SELECT uuid, dataset FROM (SELECT uuid, dataset, need, row_number() OVER (PARTITION BY "
    f"dataset ORDER BY sk, uuid) AS rn FROM (SELECT uuid, dataset, -ln({U('uuid', SEED)}) / "
    "probability AS sk FROM tprob WHERE probability > 0) k JOIN (SELECT dataset, count(*) // 2 "
    "AS need FROM tprob WHERE probability > 0 GROUP BY dataset) USING (dataset)) WHERE rn <= need")
SQL["q_weighted_sample_lineitem"] = (
    f"SELECT lkey FROM (SELECT lkey, row_number() OVER (ORDER BY -ln({U('lkey', SEED)}) / weight, "
    "lkey) AS rn FROM (SELECT concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS lkey, "
    "l_extendedprice AS weight FROM lineitem)) WHERE rn <= (SELECT count(*) // 2 FROM lineitem)")
SQL["q_slice_input_mixed"] = (
    "SELECT doc_id, instance_id, position FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 "
    f"AS position, CASE WHEN {U('doc_id', 'iid')} < 0.5 THEN doc_id + 3 END AS instance_id FROM "
    "documents) WHERE coalesce(instance_id, position) >= 100 ORDER BY coalesce(instance_id, "
    "position), doc_id LIMIT 500")
SQL["q_pair_budget"] = ("SELECT n AS n_ids, CAST(ceil(n * 6 / 2) AS BIGINT) AS needed, 2 * 2 * n >= "
                        "n * 6 AS enough FROM (SELECT count(*) AS n FROM documents)")
SQL["q_weighted_sample_repeats"] = (
    "SELECT l_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER "
    f"BY -ln({U('l_orderkey', SEED)}) / CAST(l_quantity AS DOUBLE), l_orderkey, l_linenumber) AS rn, "
    "count(*) OVER () AS c FROM lineitem) WHERE rn <= c // 2")
SQL["q_sample_k"] = (
    f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY -ln({U('doc_id', SEED)}), "
    "doc_id) AS rn FROM documents) WHERE rn <= (SELECT count(*) // 2 FROM documents)")
SQL["q_shuffle_rows"] = (f"SELECT doc_id, row_number() OVER (ORDER BY {U('doc_id', SEED)}, doc_id) "
                         "AS position FROM documents")
SQL["q_head_k"] = "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 100"
SQL["q_slice_input"] = ("SELECT doc_id, n_chars FROM documents WHERE doc_id >= 100 "
                        "ORDER BY doc_id LIMIT 500")
SQL["q_assign_batches"] = ("SELECT doc_id, ordinal, ordinal // 20 AS batch_id FROM (SELECT doc_id, "
                           "row_number() OVER (ORDER BY doc_id) - 1 AS ordinal FROM documents)")
SQL["q_global_rank"] = ("SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) "
                        "AS rank FROM documents")
SQL["q_global_rank_distributed"] = SQL["q_global_rank"]
SQL["q_global_rank_by"] = ("SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source "
                           "ORDER BY n_chars DESC, doc_id) AS rank FROM documents")
SQL["q_assign_uuid"] = with_(["corpus"], "SELECT doc_id, uuid FROM corpus")
SQL["q_retrieve_by_uuid"] = with_(["rsample", "corpus"],
                                  "SELECT s.uuid, c.doc_id, c.source, c.text FROM rsample s "
                                  "LEFT JOIN corpus c ON s.uuid = c.uuid")
SQL["q_rating_sample"] = with_(["rsample", "corpus"],
                                        "SELECT s.uuid, c.doc_id, c.source, c.lang, c.text "
                                        "FROM rsample s LEFT JOIN corpus c ON s.uuid = c.uuid")
SQL["q_tag_sample"] = with_(["tsample", "corpus"],
                                     "SELECT s.uuid, c.doc_id, c.source, c.lang, c.text "
                                     "FROM tsample s LEFT JOIN corpus c ON s.uuid = c.uuid")
SQL["q_rating_sample_records"] = with_(
    ["rsample", "rweight", "corpus"],
    "SELECT s.uuid, c.doc_id, w.dataset, c.lang, c.text, (round(w.weight, 6) + 0.0) AS weight FROM rsample s "
    "JOIN rweight w ON w.uuid = s.uuid JOIN corpus c ON c.uuid = s.uuid")
SQL["q_tag_sample_records"] = with_(
    ["tsample", "tboost", "corpus"],
    "SELECT s.uuid, c.doc_id, s.dataset, c.lang, c.text, (round(b.weight, 6) + 0.0) AS probability "
    "FROM tsample s JOIN tboost b ON b.uuid = s.uuid JOIN corpus c ON c.uuid = s.uuid")
SQL["q_union_datasets"] = ("SELECT doc_id AS id, text, source AS dataset FROM documents UNION ALL "
                           "SELECT item_id AS id, text, 'benchmark' AS dataset FROM benchmark")
SQL["q_total_quota"] = ("SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS n_datasets FROM "
                        "(SELECT source, count(*) // 2 AS n FROM documents GROUP BY source)")


# ---------------------------------------------------------------- pairs
from ..constants import FAILED, PAIR_COMPARE, PAIR_SEED  # noqa: E402
from ..functions.replies import STRICT_SHAPE, _FENCE_BODY  # noqa: E402

S = PAIR_SEED
PPD = 3  # pairs per document

cte("ids", "SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx FROM "
    "(SELECT DISTINCT doc_id AS id FROM documents WHERE doc_id IS NOT NULL)")
cte("nn", "SELECT count(*) AS n FROM ids", ["ids"])
cte("base0", "SELECT pair_id, a, (a + 1 + CAST(floor(uj * (n - 1)) AS BIGINT)) % n AS b, uo FROM "
    f"(SELECT pair_id, n, CAST(floor({U('pair_id', f'{S}:i')} * n) AS BIGINT) AS a, "
    f"{U('pair_id', f'{S}:j')} AS uj, {U('pair_id', f'{S}:o')} AS uo FROM "
    f"(SELECT unnest(range({PPD} * n)) AS pair_id, n FROM nn))", ["nn"])
cte("base", "SELECT pair_id, i1.id AS id_1, i2.id AS id_2 FROM base0 "
    "JOIN ids i1 ON i1.idx = CASE WHEN uo < 0.5 THEN b ELSE a END "
    "JOIN ids i2 ON i2.idx = CASE WHEN uo < 0.5 THEN a ELSE b END", ["base0", "ids"])
cte("deg0", "SELECT id, count(*) AS degree FROM (SELECT id_1 AS id FROM base UNION ALL "
    "SELECT id_2 FROM base) GROUP BY id", ["base"])
cte("need", "SELECT self, si, deficit FROM (SELECT i.id AS self, i.idx AS si, "
    f"greatest({PAIR_COMPARE} - coalesce(d.degree, 0), 0) AS deficit FROM ids i "
    "LEFT JOIN deg0 d ON d.id = i.id) WHERE deficit > 0", ["ids", "deg0"])
cte("slots", "SELECT r // 2 AS slot, arg_min(si, r) AS a, arg_max(si, r) AS b, count(*) AS c FROM "
    f"(SELECT si, row_number() OVER (ORDER BY {U('draw', f'{S}:s')}, self, k) - 1 AS r FROM "
    "(SELECT self, si, k, CAST(self AS VARCHAR) || ':' || CAST(k AS VARCHAR) AS draw FROM "
    "(SELECT self, si, unnest(range(1, deficit + 1)) AS k FROM need))) GROUP BY r // 2", ["need"])
cte("redrawn", "SELECT slot, j, a, "
    f"(a + 1 + CAST(floor({U('draw', f'{S}:p')} * (n - 1)) AS BIGINT)) % n AS b, "
    f"{U('draw', f'{S}:o')} < 0.5 AS flip FROM (SELECT *, "
    "CAST(slot AS VARCHAR) || ':' || CAST(j AS VARCHAR) AS draw FROM (SELECT slot, a, "
    "unnest(range(c)) AS j FROM slots WHERE c = 1 OR a = b)) x, nn", ["slots", "nn"])
cte("extra", "SELECT e.pair_id, i1.id AS id_1, i2.id AS id_2 FROM (SELECT "
    f"(SELECT {PPD} * n FROM nn) + row_number() OVER (ORDER BY slot, j) - 1 AS pair_id, x1, x2 "
    "FROM (SELECT slot, 0 AS j, a AS x1, b AS x2 FROM slots WHERE c = 2 AND a <> b UNION ALL "
    "SELECT slot, j, CASE WHEN flip THEN b ELSE a END, CASE WHEN flip THEN a ELSE b END "
    "FROM redrawn)) e JOIN ids i1 ON i1.idx = e.x1 JOIN ids i2 ON i2.idx = e.x2",
    ["slots", "redrawn", "ids", "nn"])
cte("pairs", "SELECT pair_id, id_1, id_2, false AS added FROM base UNION ALL "
    "SELECT pair_id, id_1, id_2, true AS added FROM extra", ["base", "extra"])
NL = "chr(10)"
cte("preplies", "SELECT p.pair_id, p.id_1, p.id_2, CASE WHEN u < 0.04 THEN '<<FAILED>>' "
    f"WHEN u < 0.08 THEN 'Choice: 1' || {NL} || 'Choice: 2' "
    f"WHEN d.n_chars % 2 = 0 THEN 'Choice: 1' || {NL} || 'Why: even length' "
    f"ELSE '  Choice: 2' || {NL} || 'Why: odd length' END AS reply FROM "
    f"(SELECT *, {U('pair_id', 'r')} AS u FROM pairs) p JOIN documents d ON d.doc_id = p.id_1",
    ["pairs"])
cte("choice", "SELECT pair_id, id_1, id_2, reply, status, "
    "CASE WHEN status = 'ok' THEN choices[1] END AS win, "
    "CASE WHEN status = 'ok' THEN regexp_extract(r, 'Why: ([^\\n]*)', 1) END AS why FROM "
    f"(SELECT *, CASE WHEN reply IS NULL OR reply = '{FAILED}' THEN 'failed' WHEN len(choices) <> 1 "
    "THEN 'no_choice' ELSE 'ok' END AS status FROM (SELECT *, "
    "regexp_extract_all(r, 'Choice: ([12])', 1) AS choices FROM (SELECT *, "
    "regexp_replace(reply, '^\\s+|\\s+$', '', 'g') AS r FROM preplies)))", ["preplies"])
cte("judg", "SELECT CASE WHEN pair_id % 2 = 0 THEN 'educational_value' ELSE 'writing_style' END "
    "AS task, pair_id, [id_1, id_2] AS pair_ids, win, why "
    "FROM choice WHERE status = 'ok'", ["choice"])
cte("matches", "SELECT task, pair_id, CASE WHEN win = '1' THEN pair_ids[1] ELSE pair_ids[2] END "
    "AS winner, CASE WHEN win = '1' THEN pair_ids[2] ELSE pair_ids[1] END AS loser FROM judg",
    ["judg"])
cte("mc", "SELECT task, winner, loser, count(*) AS n FROM matches GROUP BY ALL", ["matches"])
cte("items", "SELECT DISTINCT task, id FROM (SELECT task, winner AS id FROM matches UNION ALL "
    "SELECT task, loser AS id FROM matches)", ["matches"])
cte("rec", "SELECT task, id, CAST(sum(w) AS BIGINT) AS wins, CAST(sum(l) AS BIGINT) AS losses FROM "
    "(SELECT task, winner AS id, 1 AS w, 0 AS l FROM matches UNION ALL "
    "SELECT task, loser AS id, 0 AS w, 1 AS l FROM matches) GROUP BY task, id", ["matches"])
cte("net", "SELECT task, id, CAST(wins - losses AS DOUBLE) AS theta FROM rec", ["rec"])
cte("t0", "SELECT task, id, CAST(0.0 AS DOUBLE) AS theta FROM items", ["items"])
for _s in range(1, 6):
    _p = f"t{_s - 1}"
    _q = "m.n / (CAST(1.0 AS DOUBLE) + exp(w.theta - l.theta))"
    _j = (f"FROM mc m JOIN {_p} w ON w.task = m.task AND w.id = m.winner "
          f"JOIN {_p} l ON l.task = m.task AND l.id = m.loser")
    cte(f"g{_s}", f"SELECT task, id, sum(g) AS g FROM (SELECT m.task, m.winner AS id, {_q} AS g {_j} "
        f"UNION ALL SELECT m.task, m.loser AS id, -({_q}) AS g {_j}) GROUP BY task, id", ["mc", _p])
    cte(f"t{_s}", f"SELECT t.task, t.id, t.theta + CAST(0.05 AS DOUBLE) * coalesce(g.g, 0.0) AS theta "
        f"FROM {_p} t LEFT JOIN g{_s} g ON g.task = t.task AND g.id = t.id", [_p, f"g{_s}"])


def _uniform(src: str) -> str:
    return ("SELECT task, id, CASE WHEN n = 1 THEN CAST(99.0 AS DOUBLE) ELSE CAST(99.0 AS DOUBLE) - "
            "CAST(rn - 1 AS DOUBLE) * CAST(98.0 AS DOUBLE) / CAST(n - 1 AS DOUBLE) END AS score, "
            "theta FROM (SELECT task, id, theta, row_number() OVER (PARTITION BY task ORDER BY "
            f"theta DESC, id) AS rn, count(*) OVER (PARTITION BY task) AS n FROM {src})")


SQL["q_random_pairs"] = with_(["base"], "SELECT pair_id, id_1, id_2 FROM base")
SQL["q_balanced_pairs"] = with_(["pairs"], "SELECT pair_id, id_1, id_2, added FROM pairs")
SQL["q_pair_degrees"] = with_(["pairs"], "SELECT id, count(*) AS degree FROM (SELECT id_1 AS id "
                              "FROM pairs UNION ALL SELECT id_2 FROM pairs) GROUP BY id")
SQL["q_pair_report"] = with_(["pairs"], "SELECT count(*) AS n_pairs, CAST(count_if(added) AS BIGINT) AS n_added "
                             "FROM pairs")
SQL["q_pair_texts"] = with_(["pairs"], "SELECT p.pair_id, p.id_1, p.id_2, md5(a.text) AS md5_1, "
                            "md5(b.text) AS md5_2 FROM pairs p JOIN documents a ON a.doc_id = p.id_1 "
                            "JOIN documents b ON b.doc_id = p.id_2")
SQL["q_check_pairs"] = with_(["pairs"], "SELECT (SELECT count(*) FROM pairs) AS n_pairs, "
                             "count(*) AS n_ids, CAST(count_if(d.doc_id IS NULL) AS BIGINT) AS missing_ids FROM "
                             "(SELECT DISTINCT id FROM (SELECT id_1 AS id FROM pairs UNION ALL "
                             "SELECT id_2 FROM pairs)) u LEFT JOIN (SELECT DISTINCT doc_id FROM "
                             "documents) d ON d.doc_id = u.id")
SQL["q_remaining_stream"] = SQL["q_remaining_anti"] = with_(["pairs", "judg"], "SELECT pair_id, id_1, id_2 FROM pairs "
                                "WHERE pair_id NOT IN (SELECT pair_id FROM judg)")
SQL["q_remaining_watermark"] = with_(
    ["pairs", "judg"], "SELECT pair_id, id_1, id_2 FROM pairs WHERE pair_id > (SELECT "
    "coalesce(max(j.pair_id), -1) FROM judg j JOIN pairs p USING (pair_id) WHERE NOT p.added)")
SQL["q_parse_choice"] = with_(["choice"], "SELECT pair_id, status, win, why FROM choice")
SQL["q_matches"] = with_(["matches"], "SELECT task, pair_id, winner, loser FROM matches")
SQL["q_match_counts"] = with_(["mc"], "SELECT task, winner, loser, n FROM mc")
SQL["q_all_items"] = with_(["items"], "SELECT task, id FROM items")
SQL["q_item_record"] = with_(["rec"], "SELECT task, id, wins, losses FROM rec")
SQL["q_index_items"] = with_(["items"], "SELECT task, id, row_number() OVER (ORDER BY task, id) - 1 "
                             "AS idx FROM items")
SQL["q_bt_gradient"] = with_(["t5"], "SELECT task, id, (round(theta, 6) + 0.0) AS theta FROM t5")
SQL["q_bt_gradient_grouped"] = SQL["q_bt_gradient"]
cte("planted", "SELECT 'planted' AS task, winner, loser FROM (SELECT doc_id AS winner, doc_id // 5 "
    "* 5 + (doc_id % 5 + 1) % 5 AS loser FROM documents WHERE doc_id % 5 < 4 OR doc_id // 5 % 7 <> 0 "
    "UNION ALL SELECT doc_id, doc_id + 5 FROM documents WHERE doc_id % 5 = 0 AND doc_id // 5 % 3 <> 2) "
    "WHERE loser IN (SELECT doc_id FROM documents)")


def components_sql(matches: str) -> str:
    """Strongly connected components by reachability; the optimum is finite inside
    those of several items, where expected wins equal wins."""
    return with_([matches], (
        f"SELECT i.task, i.id, least(i.id, coalesce(c.m, i.id)) AS component, c.m IS NOT NULL AS "
        "finite, CASE WHEN c.m IS NOT NULL THEN CAST(0.0 AS DOUBLE) END AS residual FROM (SELECT DISTINCT "
        f"task, id FROM (SELECT task, winner AS id FROM {matches} UNION ALL SELECT task, loser FROM "
        f"{matches})) i LEFT JOIN (SELECT a.task, a.x, min(a.y) AS m FROM reach a JOIN reach b ON "
        "b.task = a.task AND b.x = a.y AND b.y = a.x WHERE a.x <> a.y GROUP BY a.task, a.x) c ON "
        "c.task = i.task AND c.x = i.id")).replace("WITH ", "WITH RECURSIVE ", 1).replace(
        "\nSELECT i.task", f",\nreach AS (SELECT DISTINCT task, winner AS x, loser AS y FROM {matches} "
        f"UNION SELECT r.task, r.x, m.loser FROM reach r JOIN {matches} m ON m.task = r.task AND "
        "m.winner = r.y)\nSELECT i.task", 1)


SQL["q_bt_mle"] = components_sql("matches")
SQL["q_bt_components"] = components_sql("planted")
SQL["q_bt_loss"] = with_(["t5", "mc"], "SELECT m.task, round(sum(m.n * ln(1 + exp(l.theta - w.theta))), "
                         "6) AS loss FROM mc m JOIN t5 w ON w.task = m.task AND w.id = m.winner "
                         "JOIN t5 l ON l.task = m.task AND l.id = m.loser GROUP BY m.task")
SQL["q_uniform_scores"] = with_(["net"], "SELECT task, id, (round(score, 6) + 0.0) AS score FROM ("
                                + _uniform("net") + ")")
SQL["q_order_scores"] = with_(["net"], "SELECT task, id, theta, row_number() OVER (PARTITION BY task "
                              "ORDER BY theta DESC, id) AS rank FROM net")
SQL["q_finalize_scores"] = with_(["net"], "SELECT task, id, (round(theta, 6) + 0.0) AS score_bt, "
                                 "(round(score, 6) + 0.0) AS score_uniform FROM (" + _uniform("net") + ")")


# ---------------------------------------------------------------- replies
def _body(reply: str) -> str:
    """Fence removal + strict shape check, as SQL."""
    unf = (f"CASE WHEN starts_with({reply}, '```json') AND ends_with({reply}, '```') "
           f"THEN regexp_extract({reply}, {lit(_FENCE_BODY)}, 1) ELSE {reply} END")
    return (f"CASE WHEN regexp_matches({unf}, {lit(STRICT_SHAPE)}) AND json_valid({unf}) "
            f"THEN {unf} END")


def _keys(body: str) -> str:
    return (f"CASE WHEN {body} IS NOT NULL AND json_valid({body}) AND json_type({body}) = 'OBJECT' "
            f"THEN json_keys({body}) END")


def _has(keys: str, *names) -> str:
    return " AND ".join(f"coalesce(list_contains({keys}, {lit(n)}), false)" for n in names)


def _obj_status(required, extra: str = "") -> str:
    return (f"CASE WHEN reply IS NULL OR reply = '{FAILED}' THEN 'failed' WHEN body IS NULL OR keys IS NULL "
            f"THEN 'no_json' WHEN NOT ({_has('keys', *required)}) THEN 'missing_key' {extra} "
            "ELSE 'ok' END")


def _name_at(u: str, names: str) -> str:
    return f"{names}[CAST(floor(21 * {u} * {u}) AS INTEGER) + 1]"


def _j(*parts) -> str:
    return " || ".join(parts)


_tbody = _j(lit('{"tag": "'), "name", lit('", "explanation": "rule"}'))
cte("trep", "SELECT doc_id, CASE WHEN u < 0.10 THEN " + _j(lit("```json"), NL, "body", NL, lit("```"))
    + " WHEN u < 0.15 THEN " + lit('{"tag": "Cooking", "explanation": "rule"}')
    + " WHEN u < 0.20 THEN " + _j(lit('{"tag": "'), "lower(name)", lit('", "explanation": "rule"}'))
    + " WHEN u < 0.25 THEN " + _j(lit('{"tag": "'), "name", lit('"}'))
    + " WHEN u < 0.28 THEN " + _j("body", lit(" trailing"))
    + " WHEN u < 0.30 THEN " + _j("body", lit(" or "), "body")
    + f" WHEN u < 0.32 THEN '{FAILED}' ELSE body END AS reply FROM (SELECT doc_id, u, name, "
    + _tbody + " AS body FROM (SELECT doc_id, " + U("doc_id", "j") + " AS u, "
    + _name_at("u1", NAMES_PROPER) + " AS name FROM (SELECT doc_id, " + U("doc_id", "t1")
    + " AS u1 FROM documents)))")
cte("tparsed", "SELECT doc_id, reply, body, keys, " + _obj_status(("tag", "explanation"))
    + " AS status FROM (SELECT doc_id, reply, body, " + _keys("body") + " AS keys FROM "
    "(SELECT doc_id, reply, " + _body("reply") + " AS body FROM trep))", ["trep"])
cte("tfirst", "SELECT doc_id, status, CASE WHEN status = 'ok' THEN lower(tag) END AS first_level_tag, "
    "CASE WHEN status = 'ok' THEN expl END AS first_level_explanation FROM (SELECT doc_id, "
    f"CASE WHEN status = 'ok' AND NOT coalesce(list_contains({NAMES_PROPER}, tag), false) "
    "THEN 'bad_first_level' ELSE status END AS status, tag, expl FROM (SELECT doc_id, status, "
    "CASE WHEN keys IS NOT NULL THEN body->>'tag' END AS tag, "
    "CASE WHEN keys IS NOT NULL THEN body->>'explanation' END AS expl FROM tparsed))", ["tparsed"])

SQL["q_parse_reply"] = with_(["tparsed"], "SELECT doc_id, status, CASE WHEN status = 'ok' THEN "
                             "body->>'tag' END AS tag FROM tparsed")
SQL["q_validate_first_level"] = with_(["tfirst"], "SELECT doc_id, status, first_level_tag, "
                                      "first_level_explanation FROM tfirst")
SQL["q_validate_first_level_literal"] = SQL["q_validate_first_level"]
SQL["q_reject_reasons"] = with_(["tfirst"], "SELECT status, count(*) AS n FROM tfirst GROUP BY status")

cte("srep", "SELECT doc_id, CASE WHEN u < 0.05 THEN '<<FAILED>>' WHEN u < 0.10 THEN "
    + lit('{"note": "none"}') + " WHEN u < 0.15 THEN 'Summary: plain text' ELSE "
    + _j(lit('{"summary": "A text of '), "CAST(n_chars AS VARCHAR)", lit(" characters in "), "lang",
         lit('."}')) + " END AS reply FROM (SELECT *, " + U("doc_id", "sm") + " AS u FROM documents)")
SQL["q_validate_summary"] = with_(
    ["srep"], "SELECT doc_id, status, CASE WHEN status = 'ok' THEN body->>'summary' END AS summary "
    "FROM (SELECT doc_id, body, " + _obj_status(("summary",)) + " AS status FROM (SELECT doc_id, "
    "reply, body, " + _keys("body") + " AS keys FROM (SELECT doc_id, reply, " + _body("reply")
    + " AS body FROM srep)))")

_second = cap("(" + _j("f", lit(" s"), "sx") + ")")
_third = cap("(" + _j("f", lit(" s"), "sx", lit(" t"), "tx") + ")")
cte("strep", "SELECT doc_id, f AS first_level_tag, CASE WHEN u < 0.05 THEN '<<FAILED>>' "
    "WHEN u < 0.10 THEN " + _j(lit('{"second_level_tag": "'), _second, lit('", "explanation": "rule"}'))
    + " WHEN u < 0.15 THEN " + lit('{"second_level_tag": "cooking s1", "third_level_tag": '
                                   '"cooking s1 t0", "explanation": "rule"}')
    + " ELSE " + _j(lit('{"second_level_tag": "'), _second, lit('", "third_level_tag": "'), _third,
                    lit('", "explanation": "rule"}'))
    + " END AS reply FROM (SELECT doc_id, uv AS u, " + _name_at("u1", NAMES_LOWER) + " AS f, "
    "CAST(CAST(floor(5 * u2) AS INTEGER) AS VARCHAR) AS sx, CAST(CAST(floor(4 * u3) AS INTEGER) "
    "AS VARCHAR) AS tx FROM (SELECT doc_id, " + U("doc_id", "t1") + " AS u1, " + U("doc_id", "s2")
    + " AS u2, " + U("doc_id", "s3") + " AS u3, " + U("doc_id", "st") + " AS uv FROM documents))")
SQL["q_validate_second_third"] = with_(
    ["strep", "taxonomy"],
    "SELECT doc_id, status, CASE WHEN status = 'ok' THEN lower(first_level_tag) ELSE first_level_tag "
    "END AS first_level_tag, CASE WHEN status = 'ok' THEN lower(s) END AS second_level_tag, "
    "CASE WHEN status = 'ok' THEN lower(t) END AS third_level_tag FROM (SELECT doc_id, "
    "first_level_tag, s, t, CASE WHEN st = 'ok' AND x.first IS NULL THEN 'bad_path' ELSE st END "
    "AS status FROM (SELECT doc_id, first_level_tag, " + _obj_status(
        ("second_level_tag", "third_level_tag", "explanation")) + " AS st, "
    "CASE WHEN keys IS NOT NULL THEN body->>'second_level_tag' END AS s, "
    "CASE WHEN keys IS NOT NULL THEN body->>'third_level_tag' END AS t FROM (SELECT *, "
    + _keys("body") + " AS keys FROM (SELECT doc_id, first_level_tag, reply, " + _body("reply")
    + " AS body FROM strep))) r LEFT JOIN (SELECT DISTINCT lower(first) AS first, second, third "
    "FROM taxonomy) x ON x.first = lower(r.first_level_tag) AND x.second = r.s AND x.third = r.t)")

_path = _j(lit(" > "), "f", lit(" s"), "sx", lit(" > "), "f", lit(" s"), "sx", lit(" t"), "tx")
_good = _j(lit('{"tag": "'), "name", _path, lit('", "explanation": "rule"}'))
_tab = _j(lit('{"tag": "\\t'), "name", _path, lit('", "explanation": "rule"}'))
_lower = _j(lit('{"tag": "'), "f", _path, lit('", "explanation": "rule"}'))
_two = _j(lit('{"tag": "'), "name", lit(' > misc", "explanation": "rule"}'))
_two_nokey = _j(lit('{"tag": "'), "name", lit(' > misc"}'))
cte("frep", "SELECT doc_id, CASE WHEN u < 0.10 THEN " + _j(lit("["), _good, lit(", "), _two_nokey,
                                                           lit("]"))
    + " WHEN u < 0.20 THEN " + _j(lit("["), _two, lit("]")) + f" WHEN u < 0.25 THEN '{FAILED}' "
    "WHEN u < 0.30 THEN " + _j(lit("["), _lower, lit(", "), _two, lit("]"))
    + " WHEN u < 0.35 THEN " + _j(lit("["), _tab, lit("]"))
    + " ELSE " + _j(lit("["), _good, lit(", "), _two, lit("]")) + " END AS reply FROM (SELECT "
    "doc_id, uv AS u, " + _name_at("u1", NAMES_PROPER) + " AS name, " + _name_at("u1", NAMES_LOWER)
    + " AS f, CAST(CAST(floor(5 * u2) AS INTEGER) AS VARCHAR) AS sx, CAST(CAST(floor(4 * u3) AS "
    "INTEGER) AS VARCHAR) AS tx FROM (SELECT doc_id, " + U("doc_id", "t1") + " AS u1, "
    + U("doc_id", "t2") + " AS u2, " + U("doc_id", "t3") + " AS u3, " + U("doc_id", "ft")
    + " AS uv FROM documents))")
_items = ("CASE WHEN body IS NOT NULL AND json_valid(body) AND json_type(body) = 'ARRAY' THEN "
          "CAST(json_extract(body, '$[*]') AS JSON[]) END")
_kept = ("list_filter(items, lambda x: len(string_split(x->>'tag', '>')) = 3 AND coalesce(list_contains("
         + NAMES_PROPER + ", regexp_replace(string_split(x->>'tag', '>')[1], '^\\s+|\\s+$', '', 'g')), false))")
SQL["q_validate_flat_tags"] = with_(
    ["frep"],
    "SELECT doc_id, status, CASE WHEN status = 'ok' THEN len(kept) END AS n_tags, "
    "CASE WHEN status = 'ok' THEN array_to_string(list_transform(kept, lambda x: x->>'tag'), '|') END "
    f"AS tags_joined FROM (SELECT doc_id, kept, CASE WHEN reply IS NULL OR reply = '{FAILED}' THEN 'failed' "
    "WHEN items IS NULL THEN 'no_json' WHEN NOT list_bool_and(list_transform(items, lambda x: "
    "json_exists(x, '$.tag') AND json_exists(x, '$.explanation'))) THEN 'missing_key' "
    "WHEN len(kept) = 0 THEN 'not_three_levels' ELSE 'ok' END AS status FROM (SELECT doc_id, reply, "
    "items, " + _kept + " AS kept FROM (SELECT doc_id, reply, " + _items + " AS items FROM "
    "(SELECT doc_id, reply, " + _body("reply") + " AS body FROM frep))))")
