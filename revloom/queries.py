"""Registered queries of the core and their SQL."""

from __future__ import annotations

from revloom import catalog, oracles, oracles_link
from revloom.operators import dedup, references

QUERIES = catalog.QUERIES | {
    "p4_found": dedup.surplus_messages,
    "p4_copies": dedup.copies_by_month,
    "p5_found": references.orphan_references,
    "p5_by_month": references.orphans_by_month,
    "p5_current": references.orphans_now,
}

_P4_SURPLUS = r"""
pairs AS (
  SELECT CAST(id AS VARCHAR) AS dec_id, min(trim(node_id)) AS node FROM pull_review_comments WHERE id IS NOT NULL AND node_id IS NOT NULL GROUP BY 1),
kept AS (
  SELECT delivery_id, received_at, CASE WHEN regexp_full_match(k, '[0-9]+') THEN coalesce((SELECT node FROM pairs WHERE dec_id = ltrim(k, '0')), ltrim(k, '0')) ELSE k END AS k
  FROM (SELECT delivery_id, received_at, regexp_replace(id, '^\s+|\s+$', '', 'g') AS k FROM review_comments) WHERE k <> ''),
surplus AS (
  SELECT DISTINCT 'pull_review_comments' AS src_table, delivery_id FROM (
    SELECT delivery_id, rank() OVER (PARTITION BY id ORDER BY TRY_CAST(updated_at AS TIMESTAMPTZ) DESC NULLS LAST, delivery_id) AS r FROM pull_review_comments WHERE id IS NOT NULL) WHERE r > 1
  UNION ALL
  SELECT DISTINCT 'review_comments', delivery_id FROM (SELECT delivery_id, rank() OVER (PARTITION BY k ORDER BY delivery_id) AS r FROM kept) WHERE r > 1)
"""

_P5_BROKEN = r"""
pairs AS (
  SELECT CAST(id AS VARCHAR) AS dec_id, min(trim(node_id)) AS node FROM pull_review_comments WHERE id IS NOT NULL AND node_id IS NOT NULL GROUP BY 1),
tc AS (
  SELECT coalesce(p.node, k) AS k, received_at AS a, deleted_at AS d
  FROM (SELECT regexp_replace(id, '^\s+|\s+$', '', 'g') AS k, received_at, deleted_at FROM review_comments) LEFT JOIN pairs p ON p.dec_id = k),
rc AS (
  SELECT id, linked_at AS at_ts, coalesce(p.node, k) AS k
  FROM (SELECT id, linked_at, regexp_replace(comment_id, '^\s+|\s+$', '', 'g') AS k FROM episodes) LEFT JOIN pairs p ON p.dec_id = k WHERE k <> ''),
broken AS (
  SELECT DISTINCT 'episodes' AS src_table, id AS src_key, 'comment_id' AS ref_field, at_ts FROM rc
  WHERE NOT EXISTS (SELECT 1 FROM tc WHERE tc.k = rc.k AND tc.a <= rc.at_ts AND (tc.d IS NULL OR tc.d > rc.at_ts))
  UNION ALL
  SELECT DISTINCT 'episodes', id, 'pr_number', linked_at FROM episodes e WHERE pr_number IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM pull_requests t WHERE t.repo = e.repo AND t.pr_number = e.pr_number AND t.received_at <= e.linked_at AND (t.deleted_at IS NULL OR t.deleted_at > e.linked_at))
  UNION ALL
  SELECT DISTINCT 'blob_index', CAST(entry_id AS VARCHAR), 'sha', indexed_at FROM blob_index b WHERE trim(b.sha) <> ''
  AND NOT EXISTS (SELECT 1 FROM contents t WHERE lower(trim(t.sha)) = lower(trim(b.sha)) AND t.fetched_at <= b.indexed_at AND (t.deleted_at IS NULL OR t.deleted_at > b.indexed_at)))
"""

ORACLE_SQL = oracles.SQL | oracles_link.SQL | {
    "p4_found": f"WITH {_P4_SURPLUS} SELECT * FROM surplus",
    "p4_copies": f"""WITH {_P4_SURPLUS},
      a AS (SELECT 'pull_review_comments' AS src_table, delivery_id, coalesce(strftime(received_at, '%Y-%m'), 'none') AS "month" FROM pull_review_comments
            UNION ALL SELECT 'review_comments', delivery_id, coalesce(strftime(received_at, '%Y-%m'), 'none') FROM review_comments)
      SELECT a.src_table, "month", count(*) AS n_rows, CAST(sum(CASE WHEN s.delivery_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_kept, CAST(sum(CASE WHEN s.delivery_id IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS n_surplus
      FROM a LEFT JOIN surplus s ON a.src_table = s.src_table AND a.delivery_id = s.delivery_id GROUP BY 1, 2""",
    "p5_found": f"WITH {_P5_BROKEN} SELECT DISTINCT src_table, src_key, ref_field FROM broken",
    "p5_by_month": f"WITH {_P5_BROKEN} SELECT src_table, ref_field, strftime(at_ts, '%Y-%m') AS \"month\", count(*) AS n_broken FROM broken GROUP BY 1, 2, 3",
    "p5_current": r"""WITH pairs AS (SELECT CAST(id AS VARCHAR) AS dec_id, min(trim(node_id)) AS node FROM pull_review_comments WHERE id IS NOT NULL AND node_id IS NOT NULL GROUP BY 1),
      tc AS (SELECT coalesce(p.node, k) AS k FROM (SELECT regexp_replace(id, '^\s+|\s+$', '', 'g') AS k, received_at, deleted_at FROM review_comments) LEFT JOIN pairs p ON p.dec_id = k WHERE received_at IS NOT NULL AND deleted_at IS NULL),
      rc AS (SELECT coalesce(p.node, k) AS k FROM (SELECT regexp_replace(comment_id, '^\s+|\s+$', '', 'g') AS k FROM episodes) LEFT JOIN pairs p ON p.dec_id = k WHERE k <> ''),
      r AS (SELECT 'comment_id' AS ref_field, k AS key FROM rc UNION ALL SELECT 'pr_number', repo || chr(0) || pr_number FROM episodes WHERE pr_number IS NOT NULL UNION ALL SELECT 'sha', lower(trim(sha)) FROM blob_index WHERE trim(sha) <> ''),
      t AS (SELECT 'comment_id' AS ref_field, k AS key FROM tc UNION ALL SELECT 'pr_number', repo || chr(0) || pr_number FROM pull_requests WHERE received_at IS NOT NULL AND deleted_at IS NULL
        UNION ALL SELECT 'sha', lower(trim(sha)) FROM contents WHERE fetched_at IS NOT NULL AND deleted_at IS NULL)
      SELECT ref_field, key, count(*) AS refs FROM r WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.ref_field = r.ref_field AND t.key = r.key) GROUP BY 1, 2""",
}
