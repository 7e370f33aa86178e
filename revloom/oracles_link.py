"""SQL equivalents of the link stage: line changes, spans, and the rules that name the accepted code."""

from __future__ import annotations

from revloom.functions.text import COMMENT_STOP_WORDS, LANGUAGES
from revloom.oracles import acting, among, q, redact, span_form, sub, trim


def file_lines(c: str) -> str:
    """Lines without an empty one at the end."""
    parts = f"string_split({c}, chr(10))"
    return f"CASE WHEN {c} = '' THEN CAST([] AS VARCHAR[]) WHEN ends_with({c}, chr(10)) THEN list_slice({parts}, 1, len({parts}) - 1) ELSE {parts} END"


def joined(c: str) -> str:
    return f"array_to_string({c}, chr(10))"


def hunks(pairs: str) -> str:
    """``hk`` (pid, i0, i1, j0, j1): the changes of the longest common subsequence of ``pairs`` (pid, a, b: lists of lines).

    ``dp`` holds, from the last line up, how much the rests have in common; ``walk`` goes through it from the start.
    """
    return f"""
dp AS (
  SELECT pid, len(a) AS i, list_transform(range(0, len(b) + 1), lambda x : 0::BIGINT) AS v FROM {pairs}
  UNION ALL
  SELECT pid, i, list_transform(range(1, len(c) + 1), lambda j : list_max(list_slice(c, j, len(c)))) FROM (
    SELECT p.pid, d.i - 1 AS i, list_transform(range(1, len(d.v) + 1), lambda j : CASE WHEN j < len(d.v) AND p.a[d.i] = p.b[j] THEN d.v[j + 1] + 1 ELSE d.v[j] END) AS c
    FROM dp d JOIN {pairs} p ON p.pid = d.pid WHERE d.i > 0)),
walk AS (
  SELECT pid, 0::BIGINT AS i, 0::BIGINT AS j, 0::BIGINT AS k, '' AS op FROM {pairs}
  UNION ALL
  SELECT pid, CASE WHEN op = 'i' THEN i ELSE i + 1 END, CASE WHEN op = 'd' THEN j ELSE j + 1 END, CASE WHEN op = 'm' THEN k + 1 ELSE k END, op FROM (
    SELECT w.pid, w.i, w.j, w.k, CASE WHEN w.i < len(p.a) AND w.j < len(p.b) AND p.a[w.i + 1] = p.b[w.j + 1] THEN 'm'
      WHEN w.j >= len(p.b) OR (w.i < len(p.a) AND y.v[w.j + 1] >= x.v[w.j + 2]) THEN 'd' ELSE 'i' END AS op
    FROM walk w JOIN {pairs} p ON p.pid = w.pid JOIN dp x ON x.pid = w.pid AND x.i = w.i LEFT JOIN dp y ON y.pid = w.pid AND y.i = w.i + 1
    WHERE w.i < len(p.a) OR w.j < len(p.b))),
hk AS (SELECT pid, CAST(max(i) - sum(CASE WHEN op = 'd' THEN 1 ELSE 0 END) AS INTEGER) AS i0, CAST(max(i) AS INTEGER) AS i1, CAST(max(j) - sum(CASE WHEN op = 'i' THEN 1 ELSE 0 END) AS INTEGER) AS j0, CAST(max(j) AS INTEGER) AS j1
  FROM walk WHERE op IN ('d', 'i') GROUP BY pid, k)"""


_EP = "ep AS (SELECT DISTINCT ON (id) * FROM episodes WHERE id IS NOT NULL)"

_MESSAGES = r"""
idp AS (SELECT CAST(id AS VARCHAR) AS dec_id, min(trim(node_id)) AS node FROM pull_review_comments WHERE id IS NOT NULL AND node_id IS NOT NULL GROUP BY 1),
ms AS (SELECT * EXCLUDE (id), mk AS id FROM (SELECT r.*, coalesce(p.node, r.k0) AS mk FROM (SELECT *, regexp_replace(id, '^\s+|\s+$', '', 'g') AS k0 FROM review_comments WHERE deleted_at IS NULL) r LEFT JOIN idp p ON p.dec_id = r.k0 WHERE r.k0 <> '')
  QUALIFY row_number() OVER (PARTITION BY mk ORDER BY delivery_id) = 1)"""

_NEAR = "CASE WHEN i0 = i1 THEN i0 BETWEEN low - 1 AND high ELSE i0 + 1 <= high AND low <= i1 END"


def link() -> str:
    """``linked``: one row per comment that gets as far as its rejected code, and ``early``: the reasons of those that do not."""
    form = lambda c: f"list_transform({c}, lambda z : {span_form('z')})"
    starts = lambda hay, want: f"list_filter(range(1, len({hay}) - len({want}) + 2), lambda i : list_slice({hay}, i, i + len({want}) - 1) = {want})"
    return rf"""{_MESSAGES}, {acting("ms", "author")},
pr AS (SELECT repo, pr_number, merge_commit_sha FROM pull_requests QUALIFY row_number() OVER (PARTITION BY repo, pr_number ORDER BY id DESC NULLS LAST, merged_at DESC NULLS LAST, merge_commit_sha DESC NULLS LAST) = 1),
early AS (SELECT ms.*, pr.merge_commit_sha AS merge_sha, coalesce(act.discard_reason, CASE WHEN pr.repo IS NULL THEN 'missing_pull_request' END) AS gone
  FROM ms JOIN act USING (delivery_id) LEFT JOIN pr ON pr.repo = ms.repo AND pr.pr_number = ms.pr_number),
hits AS (SELECT repo, commit_ref, path, sha FROM (SELECT repo, {trim('commit_ref')} AS commit_ref, {trim('path')} AS path, lower({trim('sha')}) AS sha, entry_id FROM blob_index)
  WHERE commit_ref <> '' AND path <> '' AND sha <> '' QUALIFY row_number() OVER (PARTITION BY repo, commit_ref, path ORDER BY entry_id) = 1),
dec AS (SELECT sha, path, CASE WHEN encoding = 'base64' THEN decode(from_base64(regexp_replace(content, '\s+', '', 'g'))) WHEN encoding = 'utf-8' THEN content END AS t FROM contents WHERE entry_type = 'file' AND content IS NOT NULL),
bs AS (SELECT sha, arg_min({redact('t')}, path) AS t FROM dec WHERE t IS NOT NULL GROUP BY sha),
bt AS (SELECT DISTINCT c.repo, c.sha, bs.t FROM contents c JOIN bs ON bs.sha = c.sha),
ob AS (SELECT repo, min(sha) AS sha, min(t) AS t FROM bt GROUP BY repo HAVING count(DISTINCT sha) = 1),
placed AS (SELECT e.*, coalesce(b1.t, ob.t) AS tip_text, CASE WHEN b1.t IS NULL AND ob.t IS NOT NULL THEN ob.sha ELSE h1.sha END AS tip_sha, b2.t AS comment_text, h2.sha AS comment_sha FROM early e
  LEFT JOIN hits h1 ON h1.repo = e.repo AND h1.commit_ref = e.merge_sha AND h1.path = e.path LEFT JOIN bt b1 ON b1.repo = e.repo AND b1.sha = h1.sha
  LEFT JOIN hits h2 ON h2.repo = e.repo AND h2.commit_ref = e.commit_id AND h2.path = e.path LEFT JOIN bt b2 ON b2.repo = e.repo AND b2.sha = h2.sha
  LEFT JOIN ob ON ob.repo = e.repo WHERE e.gone IS NULL),
g0 AS (SELECT *, string_split(replace(diff_hunk, chr(13) || chr(10), chr(10)), chr(10)) AS hl, coalesce(upper({trim("side")}) IN ('LEFT', 'L'), false) AS on_left, coalesce(line, original_line) AS at_line,
  coalesce(nullif(comment_text, ''), tip_text) AS blob, CASE WHEN comment_text <> '' THEN comment_sha ELSE tip_sha END AS blob_sha FROM placed),
g1 AS (SELECT *, list_filter(range(1, coalesce(len(hl), 0) + 1), lambda i : regexp_matches(hl[i], '^@@\s+-\d+(,\d+)?\s+\+\d+(,\d+)?\s@@'))[1] AS hd, {file_lines("blob")} AS blob_lines, {file_lines("tip_text")} AS tip_lines FROM g0),
g2 AS (SELECT *, try_cast(regexp_extract(hl[hd], '^@@\s+-(\d+)', 1) AS INTEGER) AS old_from, try_cast(regexp_extract(hl[hd], '^@@\s+-\d+(?:,\d+)?\s+\+(\d+)', 1) AS INTEGER) AS new_from,
  CASE WHEN hd IS NOT NULL THEN list_slice(hl, hd + 1, coalesce(list_filter(range(hd + 1, len(hl) + 1), lambda i : starts_with(hl[i], '@@'))[1] - 1, len(hl))) END AS raw FROM g1),
g3 AS (SELECT *, list_transform(list_filter(raw, lambda x : x = '' OR substr(x, 1, 1) IN ('+', '-', ' ')), lambda x : CASE WHEN x = '' THEN ' ' ELSE x END) AS bl FROM g2),
g4 AS (SELECT *, list_filter(bl, lambda x : substr(x, 1, 1) <> '-') AS ns, list_filter(bl, lambda x : substr(x, 1, 1) <> '+') AS os FROM g3),
g5 AS (SELECT *, coalesce(blob <> '' AND {trim("blob_sha")} <> '' AND NOT on_left AND at_line BETWEEN 1 AND len(blob_lines), false) AS from_blob,
  CASE WHEN {trim("diff_hunk")} <> '' AND new_from >= 1 AND len(ns) > 0 THEN
    CASE WHEN NOT on_left AND at_line BETWEEN new_from AND new_from + len(ns) - 1 THEN [(at_line - new_from + 1)::BIGINT]
      WHEN len(list_filter(ns, lambda x : substr(x, 1, 1) = '+')) > 0 THEN list_filter(range(1, len(ns) + 1), lambda i : substr(ns[i], 1, 1) = '+') ELSE range(1, len(ns) + 1) END END AS chosen FROM g4),
g6 AS (SELECT *, CASE WHEN from_blob THEN 'line_blob' WHEN chosen IS NOT NULL THEN 'diff_hunk' END AS rej_from,
  CASE WHEN from_blob THEN at_line ELSE new_from + chosen[1] - 1 END::INTEGER AS rs, CASE WHEN from_blob THEN at_line ELSE new_from + chosen[len(chosen)] - 1 END::INTEGER AS re,
  CASE WHEN from_blob THEN blob_lines[at_line] ELSE {joined("list_transform(chosen, lambda i : substr(ns[i], 2))")} END AS rt,
  list_transform(ns, lambda x : substr(x, 2)) AS news, list_transform(os, lambda x : substr(x, 2)) AS olds FROM g5),
g7 AS (SELECT *, CASE WHEN comment_text <> '' THEN comment_text WHEN tip_text <> '' THEN
    CASE WHEN {trim("diff_hunk")} <> '' AND old_from >= 1 AND new_from >= 1 AND len(bl) > 0 AND (len(news) = 0 OR list_slice(tip_lines, new_from, new_from + len(news) - 1) = news)
      THEN {joined("list_concat(list_slice(tip_lines, 1, new_from - 1), olds, list_slice(tip_lines, new_from + len(news), len(tip_lines)))")} || chr(10) ELSE tip_text END END AS before_text FROM g6),
told AS (SELECT *, md5(before_text) || md5(tip_text) AS pid, greatest(1, rs - 3) AS low, re + 3 AS high, before_text IS NULL OR tip_text IS NULL OR coalesce({trim("tip_sha")}, '') = '' AS lacking FROM g7 WHERE rej_from IS NOT NULL),
pq AS (SELECT DISTINCT ON (pid) pid, {file_lines("before_text")} AS a, {file_lines("tip_text")} AS b FROM told WHERE NOT lacking AND before_text <> tip_text),
{hunks("pq")},
sg AS (SELECT delivery_id, pid, low, high, {file_lines("s")} AS want FROM (SELECT *, regexp_replace(regexp_extract(body, '(?is)```suggestion[^\n]*\r?\n(.*?)```', 1), '\r?\n$', '') AS s FROM told WHERE regexp_matches(body, '(?is)```suggestion[^\n]*\r?\n(.*?)```'))),
s1 AS (SELECT sg.*, pq.b, {starts("pq.b", "want")} AS hit FROM sg JOIN pq USING (pid) WHERE len(want) > 0),
s2 AS (SELECT delivery_id, pid, low, high, want, b, hit FROM s1 WHERE len(hit) > 0
  UNION ALL SELECT delivery_id, pid, low, high, want, b, {starts("nb", "nw")} FROM (SELECT *, {form("b")} AS nb, {form("want")} AS nw FROM s1 WHERE len(hit) = 0)),
s3 AS (SELECT *, coalesce(list_filter(hit, lambda i : i <= high AND low <= i + len(want) - 1)[1], hit[1]) AS at_hit FROM s2 WHERE len(hit) > 0),
ch AS (SELECT t.delivery_id, t.rs, t.re, t.rt, hk.*, {_NEAR} AS near, {joined("list_slice(pq.a, i0 + 1, i1)")} AS was, {joined("list_slice(pq.b, j0 + 1, j1)")} AS now,
  lower({joined("list_concat(list_slice(pq.b, j0 + 1, j1), list_slice(pq.a, i0 + 1, i1))")}) AS code FROM told t JOIN pq USING (pid) JOIN hk USING (pid)),
ex AS (SELECT * FROM ch WHERE near AND i1 > i0 AND j1 > j0 AND i0 + 1 = rs AND i1 = re AND was = rt AND was <> now QUALIFY row_number() OVER (PARTITION BY delivery_id ORDER BY i0, j0) = 1),
le AS (SELECT * FROM ch QUALIFY row_number() OVER (PARTITION BY delivery_id ORDER BY near DESC, i1 - i0 + j1 - j0, i0, j0) = 1),
wd AS (SELECT delivery_id, list_filter(regexp_extract_all({sub("lower(body)", "(?s)```.*?```", " ")}, '[a-z][a-z0-9_]{{2,}}'), lambda w : w NOT IN {among(COMMENT_STOP_WORDS)}) AS words FROM told),
linked AS (SELECT t.*, CASE WHEN t.lacking THEN 'missing_accepted_inputs' WHEN le.pid IS NULL THEN 'no_change' WHEN s3.pid IS NOT NULL THEN 'suggestion_block_applied' WHEN ex.pid IS NOT NULL THEN 'exact_span_replacement'
    WHEN le.near AND (len(coalesce(wd.words, [])) = 0 OR len(list_filter(wd.words, lambda w : contains(le.code, w))) > 0) THEN 'overlap_lexical' ELSE 'same_file_only' END AS why,
  CASE WHEN s3.pid IS NOT NULL THEN s3.at_hit WHEN ex.pid IS NOT NULL THEN ex.j0 + 1 WHEN le.j1 > le.j0 THEN le.j0 + 1 END AS acc_from,
  CASE WHEN s3.pid IS NOT NULL THEN s3.at_hit + len(s3.want) - 1 WHEN ex.pid IS NOT NULL THEN ex.j1 WHEN le.j1 > le.j0 THEN le.j1 END AS acc_to, pq.b AS new_lines
  FROM told t LEFT JOIN pq USING (pid) LEFT JOIN s3 ON s3.delivery_id = t.delivery_id LEFT JOIN ex ON ex.delivery_id = t.delivery_id LEFT JOIN le ON le.delivery_id = t.delivery_id LEFT JOIN wd ON wd.delivery_id = t.delivery_id)"""


_LANGUAGE = f"""CASE lower(regexp_extract(regexp_extract(path, '[^/\\\\]*$'), '^.+\\.([^.]*)$', 1)) {' '.join(f"WHEN {q(k)} THEN {q(v)}" for k, v in LANGUAGES.items())} END"""

SQL = {
    "edit_hunks": f"""WITH RECURSIVE {_EP}, pq AS (SELECT id AS pid, {file_lines("rejected.text")} AS a, {file_lines("accepted.text")} AS b FROM ep WHERE accepted.text IS NOT NULL AND rejected.text IS NOT NULL), {hunks("pq")}
      SELECT pid AS id, (i0 + 1)::INTEGER AS before_start, i1 AS before_end, (j0 + 1)::INTEGER AS after_start, j1 AS after_end FROM hk""",
    "link_episodes": f"""WITH RECURSIVE {link()}
      SELECT 'ep_' || substr(sha256({trim('repo')} || chr(0) || {trim('id')}), 1, 16) AS id, repo, id AS comment_id, pr_number, {_LANGUAGE} AS file_language, CASE WHEN {trim("author")} <> '' THEN author END AS reviewer,
        CASE WHEN why IN ('missing_accepted_inputs', 'no_change') THEN 'none' WHEN why IN ('suggestion_block_applied', 'exact_span_replacement') THEN 'high' WHEN why = 'overlap_lexical' THEN 'medium' ELSE 'low' END AS link_confidence,
        'rejected_from_' || rej_from || '+' || why AS link_reason, rs AS rejected_start_line, re AS rejected_end_line, acc_from::INTEGER AS accepted_start_line, acc_to::INTEGER AS accepted_end_line, md5({redact("rt")}) AS rejected_text,
        md5({redact(joined("list_slice(new_lines, acc_from, acc_to)"))}) AS accepted_text, md5({redact(span_form("rt"))}) AS rejected_normal, md5({redact("body")}) AS body FROM linked""",
    "link_discards": f"""WITH RECURSIVE {link()}, lost AS (SELECT gone AS discard_reason FROM early WHERE gone IS NOT NULL UNION ALL SELECT 'no_rejected_span' FROM g7 WHERE rej_from IS NULL)
      SELECT discard_reason, count(*) AS n FROM lost GROUP BY 1""",
}
