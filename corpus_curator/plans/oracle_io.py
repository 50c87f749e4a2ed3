"""Oracle SQL for sources, sinks, shaping and streaming queries: the rows the
files must hold, computed from the tables directly."""

from __future__ import annotations

from ..functions.rand import sql_uniform as U
from . import oracle_annotate as OA
from .oracle import SQL as BASE
from .oracle import with_

NL = "chr(10)"
WS = "'^\\s+|\\s+$'"

SQL: dict[str, str] = {}
SQL["q_roundtrip_records"] = (
    "SELECT doc_id, source AS dataset, md5(text) AS text_md5, 'ok' AS status, NULL::VARCHAR AS broken "
    "FROM documents UNION ALL SELECT NULL, source, NULL, 'corrupt', "
    """'{"doc_id": ' || doc_id || ', "te' FROM documents """
    f"WHERE {U('doc_id', 'broken')} < 0.03")
_raw = (f"SELECT doc_id AS key, CASE WHEN {U('doc_id', 'iid')} < 0.5 THEN doc_id END AS instance_id, "
        "md5(text) AS text_md5 FROM documents")
SQL["q_normalize_records"] = _raw
SQL["q_dataset_from_path"] = "SELECT doc_id, source AS dataset FROM documents"
SQL["q_assign_uuid_random"] = ("SELECT count(*) AS n_rows, count(*) AS n_distinct, count(*) AS n_v4 "
                               "FROM documents")
SQL["q_read_raw"] = _raw
_broken = f"{U('doc_id', 'broken')} < 0.03"
SQL["q_read_raw_txt"] = (
    f"SELECT CASE WHEN NOT {_broken} THEN doc_id END AS instance_id, CASE WHEN NOT {_broken} THEN "
    f"md5(text) END AS text_md5, CASE WHEN {_broken} THEN 'no record ' || doc_id END AS broken "
    "FROM documents")
_md_text = (f"regexp_replace(array_to_string(list_transform(string_split(text, {NL}), lambda l: "
            f"regexp_replace(l, {WS}, '', 'g')), {NL}), {WS}, '', 'g')")
SQL["q_read_md"] = (f"SELECT doc_id, md5(t) AS text_md5 FROM (SELECT doc_id, {_md_text} AS t "
                    "FROM documents) WHERE length(t) > 0")
SQL["q_assign_instance_id"] = (
    f"SELECT key, coalesce(instance_id, row_number() OVER (ORDER BY key) - 1 + 1000000) AS "
    f"instance_id FROM (SELECT doc_id AS key, CASE WHEN {U('doc_id', 'iid')} < 0.5 THEN doc_id END "
    "AS instance_id FROM documents)")
_titled = (f"SELECT doc_id, CASE WHEN u1 < 0.3 THEN NULL WHEN u1 < 0.4 THEN '' ELSE source END AS "
           "title, CASE WHEN u2 < 0.1 THEN NULL ELSE text END AS before FROM (SELECT doc_id, source, "
           f"text, {U('doc_id', 'title')} AS u1, {U('doc_id', 'before')} AS u2 FROM documents)")
_content = (f"CASE WHEN coalesce(title, '') = '' THEN coalesce(before, '') WHEN before IS NULL "
            f"THEN title ELSE title || {NL} || before END")
SQL["q_concat_keys"] = (f"SELECT doc_id, md5({_content}) AS content_md5, length({_content}) AS "
                        f"content_len FROM ({_titled})")
SQL["q_empty_content"] = (f"SELECT count(*) AS n_rows, CAST(count_if(length({_content}) = 0) AS BIGINT) AS n_empty "
                          f"FROM ({_titled})")
SQL["q_truncate_text"] = ("SELECT doc_id, length(substring(text, 1, 2500)) AS cut_len, "
                          "md5(substring(text, 1, 2500)) AS cut_md5 FROM documents")
SQL["q_read_pairs"] = with_(["pairs"], "SELECT pair_id, id_1, id_2, added, (SELECT count(*) FROM "
                            "documents) AS n, (SELECT count(*) FROM pairs) AS n_pairs, "
                            "CAST(6 AS BIGINT) AS compare FROM pairs")
_whole = f"{U('pair_id', 'broken')} >= 0.03"
SQL["q_read_judgements"] = with_(["judg"], "SELECT " + ", ".join(
    f"CASE WHEN {_whole} THEN {c} END AS {c}" for c in ("task", "pair_id", "pair_ids", "win", "why"))
    + f", CASE WHEN {_whole} THEN 'ok' ELSE 'corrupt' END AS status FROM judg")
SQL["q_read_taxonomy"] = with_(["taxonomy"], "SELECT first, second, third FROM taxonomy")
SQL["q_write_ids"] = BASE["q_weighted_sample"]
SQL["q_write_scores"] = BASE["q_uniform_scores"]
SQL["q_annotate_stream"] = OA.SQL["q_annotate_summary"]
SQL["q_retrieve_bucketed"] = BASE["q_retrieve_by_uuid"].replace(
    "SELECT s.uuid, c.doc_id, c.source, c.text FROM", "SELECT s.uuid, c.doc_id, md5(c.text) AS text_md5 FROM")
