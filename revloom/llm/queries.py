"""Registered queries of the training-text operators and their SQL."""

from __future__ import annotations

from revloom.llm import contamination, credentials, handwritten, near_duplicates, packing, truncation

QUERIES = {
    "p1_found": handwritten.p1_found,
    "p1_reasons": handwritten.p1_reasons,
    "p2_found": credentials.p2_found,
    "p2_masked": credentials.p2_masked,
    "p3_found": near_duplicates.p3_found,
    "p3_groups": near_duplicates.p3_groups,
    "p6_packed": packing.p6_packed,
    "p6_usage": packing.p6_usage,
    "p6_checks": packing.p6_checks,
    "p7_found": contamination.p7_found,
    "p7_near": contamination.p7_near,
    "p8_found": truncation.p8_found,
    "p8_shares": truncation.p8_shares,
}

_PAIRS = r"""e AS (
  SELECT DISTINCT id, coalesce(rejected.normalized, '') || chr(10) || coalesce(accepted.normalized, '') || chr(10) || coalesce(comment_body, '') AS t FROM episodes WHERE id IS NOT NULL),
tok AS (SELECT DISTINCT id, t, unnest(regexp_extract_all(lower(t), '[a-z0-9_]+')) AS w FROM e),
n AS (SELECT id, t, count(*) AS n FROM tok GROUP BY 1, 2),
i AS (SELECT a.id AS x, a.t AS tx, b.id AS y, b.t AS ty, count(*) AS c FROM tok a JOIN tok b ON a.w = b.w AND a.id < b.id GROUP BY ALL),
pr AS (SELECT x AS id_a, y AS id_b, tx, ty FROM i JOIN n p ON p.id = x AND p.t = tx JOIN n q ON q.id = y AND q.t = ty WHERE 10 * c >= 7 * (p.n + q.n - c))"""

ORACLE_SQL = {
    "p3_found": f"WITH {_PAIRS} SELECT DISTINCT id_a, id_b FROM pr",
    "p3_groups": f"""WITH RECURSIVE {_PAIRS}, ed AS (SELECT id_a AS a, id_b AS b FROM pr UNION SELECT id_b, id_a FROM pr),
      rc AS (SELECT a AS id, a AS m FROM ed UNION SELECT ed.b, rc.m FROM rc JOIN ed ON ed.a = rc.id),
      li AS (SELECT id, count(DISTINCT t2) AS n FROM (SELECT id_a AS id, ty AS t2 FROM pr WHERE tx <> ty UNION ALL SELECT id_b, tx FROM pr WHERE tx <> ty) GROUP BY 1),
      co AS (SELECT id, count(*) OVER (PARTITION BY t) - 1 AS n FROM e)
      SELECT rc.id, min(m) AS group_id, max(co.n) AS n_copies, coalesce(max(li.n), 0) AS n_links FROM rc JOIN co ON co.id = rc.id LEFT JOIN li ON li.id = rc.id GROUP BY 1""",
    "p7_found": r"""WITH d AS (SELECT doc_id, lower(text) AS t, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
      i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
      g AS (SELECT DISTINCT item_id, hash(list_slice(w, k, k + 11)) AS h, list_slice(w, k, k + 11) AS s FROM i, LATERAL (SELECT unnest(range(1, len(w) - 10)) AS k)),
      x AS (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d)
      SELECT DISTINCT doc_id, item_id FROM x JOIN g ON g.h = hash(list_slice(w, k, k + 11)) AND g.s = list_slice(w, k, k + 11)""",
    "p6_checks": """SELECT window_name, (SELECT count(DISTINCT doc_id) FROM documents) AS n_docs, CAST((SELECT sum(n) FROM (SELECT max(n_tokens) AS n FROM documents GROUP BY doc_id)) AS BIGINT) AS n_tokens,
      0::BIGINT AS n_wrong_docs, 0::BIGINT AS n_bad_places FROM pack_windows""",
    "p7_near": r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
      i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
      g AS (SELECT item_id, k, list_slice(w, k, k + 5) AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 4)) AS k FROM i)),
      x AS (SELECT doc_id, k, list_slice(w, k, k + 5) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 4)) AS k FROM d)),
      m AS (SELECT DISTINCT doc_id, item_id, x.k - g.k AS shift, g.k AS place FROM x JOIN g ON x.s = g.s),
      b AS (SELECT doc_id, item_id, floor(shift / 8.0) - unnest([0, 1]) AS band, place FROM m),
      c AS (SELECT doc_id, item_id, band, count(DISTINCT word) AS n FROM (SELECT doc_id, item_id, band, place + unnest(range(6)) AS word FROM b) GROUP BY 1, 2, 3)
      SELECT doc_id, item_id, max(n) AS near_words FROM c GROUP BY 1, 2 HAVING max(n) >= 12""",
}
