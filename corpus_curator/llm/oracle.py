"""DuckDB SQL for the numbered queries that SQL can express over whole tables."""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Runs without white space; runs of letters, digits and characters above ASCII.
PLAIN = f"regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+')"
ALNUM = f"regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def shingles(words: str, size: str = "5") -> str:
    """Distinct runs of ``size`` words of a list, each as one string."""
    return (f"list_distinct(list_transform(range(1, len({words}) - {size} + 2), "
            f"lambda i: array_to_string({words}[i:i + {size} - 1], ' ')))")


OP3 = f"""
WITH q AS (SELECT item_id, {ALNUM} AS w FROM benchmark),
q5 AS (SELECT DISTINCT item_id, least(5, len(w)) AS k, w FROM q WHERE len(w) > 0),
items AS (SELECT DISTINCT item_id, k, {shingles('w', 'k')} AS s FROM q5),
item AS (SELECT item_id, k, len(s) AS n, unnest(s) AS sh FROM items),
d AS (SELECT doc_id, {ALNUM} AS w FROM documents),
doc AS (SELECT doc_id, k, unnest({shingles('w', 'k')}) AS sh
        FROM d, (SELECT DISTINCT k FROM q5) WHERE len(w) >= k)
SELECT doc_id, item_id, CAST(n AS BIGINT) AS n_shingles, count(*) AS matched,
       count(*) / n AS containment
FROM doc JOIN item USING (k, sh) GROUP BY doc_id, item_id, n HAVING count(*) * 100 >= n * 80
"""

OP5 = f"""
WITH d AS (SELECT doc_id, {PLAIN} AS words FROM documents),
tok AS (SELECT doc_id, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS p FROM d),
g AS (SELECT doc_id, p, w, lag(w) OVER o AS w1, lag(w, 2) OVER o AS w2 FROM tok
      WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
total AS (SELECT count(*) AS n FROM g),
c1 AS (SELECT w, count(*) AS c FROM g GROUP BY w),
c2 AS (SELECT w1, w, count(*) AS c FROM g WHERE p > 1 GROUP BY w1, w),
c3 AS (SELECT w2, w1, w, count(*) AS c FROM g WHERE p > 2 GROUP BY w2, w1, w),
scored AS (
  SELECT g.doc_id, CASE
      WHEN c3.c > 1 THEN ln((c3.c - 1) / (x2.c - 1))
      WHEN c2.c > 1 THEN (least(p, 3) - 2) * ln(0.4::DOUBLE) + ln((c2.c - 1) / (x1.c - 1))
      ELSE (least(p, 3) - 1) * ln(0.4::DOUBLE)
           + ln(greatest(c1.c - 1, 0.5::DOUBLE) / greatest(n - 1, 1)) END AS s
  FROM g JOIN total ON true JOIN c1 ON c1.w = g.w
  LEFT JOIN c2 ON c2.w1 = g.w1 AND c2.w = g.w
  LEFT JOIN c3 ON c3.w2 = g.w2 AND c3.w1 = g.w1 AND c3.w = g.w
  LEFT JOIN c1 x1 ON x1.w = g.w1 LEFT JOIN c2 x2 ON x2.w1 = g.w2 AND x2.w = g.w1)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words,
       round(coalesce((SELECT sum(s) FROM scored WHERE scored.doc_id = d.doc_id), 0), 4) + 0.0
       AS log_score
FROM d
"""

OP10 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {PLAIN} AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) >= 5 THEN {shingles('w')}
     WHEN len(w) > 0 THEN [len(w) || ' ' || array_to_string(w, ' ')] ELSE [] END AS s FROM d),
e AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS sh FROM s),
link AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b USING (sh) WHERE a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT x, y FROM link UNION
          SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x),
least_of AS (SELECT x, min(y) AS m FROM reach GROUP BY x)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS
       component_id, doc_id <= coalesce(m, doc_id) AS kept
FROM s LEFT JOIN least_of ON x = doc_id
"""

OP13 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
r AS (SELECT *, strlen(h) >= 1000 AND row_number() OVER (
          PARTITION BY h ORDER BY page_id DESC NULLS LAST) > 1 AS again,
      max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN top END AS refers_to
FROM r
"""

SQL = {"op13_warc": OP13, "op3_decontamination": OP3, "op5_lm_score": OP5, "op10_near_dup": OP10}
