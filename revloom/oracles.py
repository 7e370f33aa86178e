"""SQL equivalents of the catalog's queries, for DuckDB on the same tables.

DuckDB's patterns are RE2: word boundaries are ASCII there and there is no look-around, so short
keywords are shielded by a prefix before local names are masked.
"""

from __future__ import annotations

from revloom.functions.comments import APPROVALS, BOTS, EMPTY_NITS, PICTOGRAPHS, PRAISE, THANKS
from revloom.functions.text import COMMENT_STOP_WORDS, LANGUAGES, REDACTIONS, TITLE_STOP_WORDS


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def among(words) -> str:
    return "(" + ", ".join(map(q, words)) + ")"


def listed(words) -> str:
    return "[" + ", ".join(map(q, words)) + "]"


def sub(c: str, pattern: str, by: str) -> str:
    return f"regexp_replace({c}, {q(pattern)}, {q(by)}, 'g')"


def trim(c: str) -> str:
    return sub(c, r"^\s+|\s+$", "")


def redact(c: str) -> str:
    for pattern, by in REDACTIONS:
        c = sub(c, pattern, by.replace("$1", r"\1"))
    return c


STRINGS = r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`"
NUMBERS = r"\b\d+(?:\.\d+)?\b"


def per_line(c: str, f) -> str:
    return f"array_to_string(list_transform(string_split({c}, chr(10)), lambda l : {f('l')}), chr(10))"


def span_form(c: str) -> str:
    return per_line(c, lambda x: sub(sub(sub(trim(x), STRINGS, "S"), NUMBERS, "N"), r"\s+", ""))


def cluster_form(c: str) -> str:
    def line(x):
        x = sub(sub(trim(x), STRINGS, "S"), NUMBERS, "N")
        x = sub(sub(sub(x, r"\b(for|if|in|let|new|try|var)\b", r"QQKEEP\1"), r"\b[a-z_][a-z0-9_]{0,2}\b", "V"), r"\bQQKEEP(for|if|in|let|new|try|var)\b", r"\1")
        return trim(sub(x, r"\s+", " "))

    return trim(per_line(c, line))


def names(c: str) -> str:
    """Distinct names; without order."""
    return f"list_distinct(regexp_extract_all({c}, '[A-Za-z_][A-Za-z0-9_]*'))"


EMOJI = PICTOGRAPHS.replace(r"\x{", r"\x{")
SHORT = r"(?i):[a-z0-9_+-]+:"


def bare(c: str) -> str:
    return trim(sub(sub(sub(c, SHORT, ""), EMOJI, ""), r"[\x{FE0F}\x{200D}]", ""))


def plain(c: str) -> str:
    x = f"lower({c})"
    for p in (r"(?s)```.*?```", r"`[^`]+`", SHORT, EMOJI):
        x = sub(x, p, " ")
    return trim(sub(sub(sub(x, r"[\x{FE0F}\x{200D}]", ""), r"[^a-z0-9+\s]", " "), r"\s+", " "))


def acting(rows: str, author: str) -> str:
    """``act`` (delivery_id, discard_reason) of the comments in ``rows``."""
    return f"""
b AS (SELECT delivery_id, {trim("coalesce(body, '')")} AS b, lower({trim(author)}) AS a FROM {rows}),
c AS (SELECT *, {plain("b")} AS p, {bare("b")} AS e FROM b),
d AS (SELECT *, {trim(sub("p", r"^(?:nits|nit)\s*", ""))} AS rest, {trim(sub(sub("lower(e)", r"[^a-z0-9\s]", " "), r"\s+", " "))} AS nit FROM c),
act AS (SELECT delivery_id, CASE
  WHEN coalesce(a <> '' AND (a LIKE '%[bot]' OR a IN {among(BOTS)} OR regexp_full_match(a, '[a-z0-9_-]+-bot')), false) THEN 'bot_author'
  WHEN b = '' THEN 'too_short'
  WHEN CASE WHEN e = '' THEN regexp_matches(b, {q(EMOJI)}) OR regexp_matches(b, {q(SHORT)}) ELSE regexp_full_match(e, '[\\s\\p{{P}}\\p{{S}}]*') END THEN 'emoji_only'
  WHEN p IN {among(APPROVALS)} THEN 'lgtm' WHEN p IN {among(THANKS)} THEN 'thanks' WHEN p IN {among(PRAISE)} THEN 'praise'
  WHEN regexp_matches(p, '^nits?\\b') AND (rest = '' OR rest IN {among(EMPTY_NITS)} OR nit IN ('nit', 'nits')) THEN 'non_actionable_nit'
  WHEN NOT contains(b, '```') AND length(b) < 12 THEN 'too_short' END AS discard_reason FROM d)"""


_ACT = acting("pull_review_comments", "gh_user.login")

_TITLE = f"list_filter(regexp_split_to_array({sub('lower(%s)', r'[^a-z0-9' + chr(92) + r's_-]', ' ')}, '\\s+'), lambda w : length(w) >= 3 AND w NOT IN {among(TITLE_STOP_WORDS)})"

_SEG = "coalesce(list_filter(string_split(path, '/'), lambda s : s <> '')[1], '')"

_EP = "ep AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS pos FROM (SELECT DISTINCT ON (id) * FROM episodes WHERE id IS NOT NULL))"


def clusters(bucket: str) -> str:
    """Leader clusters of the eligible episodes: ``led`` (id, leader_id), by a walk over each bucket in order."""
    return f"""
el AS (SELECT id, repo, path, file_language, reviewer, link_confidence, comment_body, rejected, accepted, pos, {bucket} AS bucket,
  {cluster_form("coalesce(rejected.text, '')")} || chr(10) || {cluster_form("coalesce(accepted.text, '')")} AS form FROM ep WHERE accepted IS NOT NULL AND link_confidence IN ('high', 'medium')),
it AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY pos) AS k, length(form) AS len, {names("form")} AS nm FROM el),
sim AS (SELECT x.bucket, x.k AS a, y.k AS b, x.id AS id_a, y.id AS id_b,
  0.5::DOUBLE * CASE WHEN len(x.nm) = 0 AND len(y.nm) = 0 THEN 1.0 WHEN len(x.nm) = 0 OR len(y.nm) = 0 THEN 0.0 ELSE len(list_intersect(x.nm, y.nm))::DOUBLE / (len(x.nm) + len(y.nm) - len(list_intersect(x.nm, y.nm))) END
  + 0.5::DOUBLE * CASE WHEN x.len = 0 AND y.len = 0 THEN 1.0 ELSE least(x.len, y.len)::DOUBLE / greatest(x.len, y.len) END AS s
  FROM it x JOIN it y ON x.bucket = y.bucket AND x.k < y.k),
nb AS (SELECT bucket, b AS k, list(a) AS prev FROM sim WHERE s >= 0.72 GROUP BY 1, 2),
wk AS (SELECT it.bucket, it.k, coalesce(nb.prev, []) AS prev FROM it LEFT JOIN nb ON it.bucket = nb.bucket AND it.k = nb.k),
st AS (
  SELECT bucket, k, [k] AS leaders, k AS leader FROM wk WHERE k = 1
  UNION ALL
  SELECT w.bucket, w.k, CASE WHEN len(list_intersect(st.leaders, w.prev)) = 0 THEN list_append(st.leaders, w.k) ELSE st.leaders END,
    CASE WHEN len(list_intersect(st.leaders, w.prev)) = 0 THEN w.k ELSE list_min(list_intersect(st.leaders, w.prev)) END
  FROM st JOIN wk w ON w.bucket = st.bucket AND w.k = st.k + 1),
led AS (SELECT i.*, l.id AS leader_id, st.leader FROM st JOIN it i ON i.bucket = st.bucket AND i.k = st.k JOIN it l ON l.bucket = st.bucket AND l.k = st.leader)"""


_ALL = f"WITH RECURSIVE {_EP}, {clusters(f'coalesce(file_language, {q(chr(117) + chr(110) + chr(107) + chr(110) + chr(111) + chr(119) + chr(110))}) || chr(1) || {_SEG}')}"
_REPO = f"WITH RECURSIVE {_EP}, {clusters(f'repo || chr(1) || coalesce(file_language, ' + q('unknown') + f') || chr(1) || {_SEG}')}"
_RECIPE = f"""{_REPO},
rec AS (SELECT bucket, leader, max(repo) AS repo, count(*) AS support, list(id ORDER BY pos) AS ids, min(pos) AS first_pos,
  list(reviewer ORDER BY pos) FILTER (WHERE {trim("reviewer")} <> '') AS reviewers,
  list(file_language ORDER BY pos) FILTER (WHERE {trim("file_language")} <> '') AS languages,
  list(CASE link_confidence WHEN 'high' THEN 1.0::DOUBLE WHEN 'medium' THEN 0.7 WHEN 'low' THEN 0.3 ELSE 0.0 END ORDER BY pos) AS scores,
  min(string_split(path, '/')) AS lo, max(string_split(path, '/')) AS hi, arg_min(path, pos) AS path
  FROM led GROUP BY 1, 2 HAVING count(*) >= 2),
rid AS (SELECT *, 'rcp_' || substr(sha256(repo || chr(0) || array_to_string(list_sort(ids), chr(0))), 1, 16) AS recipe_id, list_sum(scores) / support AS conf,
  list_slice(lo, 1, len(list_filter(range(1, least(len(lo), len(hi))), lambda i : list_slice(lo, 1, i) = list_slice(hi, 1, i)))) AS shared FROM rec)"""


_MEDOID = f"""{_RECIPE}, sy AS (SELECT bucket, a, b, s FROM sim UNION ALL SELECT bucket, b, a, s FROM sim),
cen AS (SELECT x.bucket, x.leader, x.id, x.k, round(sum(sy.s), 9) AS mean FROM led x JOIN led y ON x.bucket = y.bucket AND x.leader = y.leader AND x.k <> y.k JOIN sy ON sy.bucket = x.bucket AND sy.a = x.k AND sy.b = y.k GROUP BY ALL),
mid AS (SELECT * FROM cen QUALIFY row_number() OVER (PARTITION BY bucket, leader ORDER BY mean DESC, k) = 1),
rt AS (SELECT rid.*, ep.rejected.text AS raw_before, {redact("ep.rejected.text")} AS before, {redact("ep.accepted.text")} AS after FROM rid JOIN mid ON mid.bucket = rid.bucket AND mid.leader = rid.leader JOIN ep ON ep.id = mid.id)"""


def ordered_distinct(c: str) -> str:
    return f"array_to_string(list_filter(list_transform(range(1, len({c}) + 1), lambda i : CASE WHEN list_position({c}, {c}[i]) = i THEN {c}[i] END), lambda v : v IS NOT NULL), ',')"


_PREFIX = f"CASE WHEN len(shared) > 0 THEN array_to_string(shared, '/') || '/' ELSE {_SEG} END"

def _scores(same: str) -> str:
    """``sc``: the scores of the recipes and the pieces of code that fit."""
    return f"""{_MEDOID},
      sg AS (SELECT recipe_id, list_concat(list_filter(list_transform(string_split(raw_before, chr(10)), lambda x : {trim("x")}), lambda x : length(x) >= 4 AND regexp_matches(x, '[A-Za-z0-9]')),
        list_filter(regexp_extract_all(raw_before, '[A-Za-z_][A-Za-z0-9_.]*'), lambda x : length(x) >= 4 AND NOT regexp_full_match(x, '_+'))) AS w FROM rt),
      sx AS (SELECT recipe_id, s, min(i) AS i FROM (SELECT recipe_id, unnest(w) AS s, generate_subscripts(w, 1) AS i FROM sg) GROUP BY 1, 2),
      sl AS (SELECT recipe_id, list(lower(s)) AS sig FROM (SELECT * FROM sx QUALIFY row_number() OVER (PARTITION BY recipe_id ORDER BY i) <= 12) GROUP BY 1),
      la AS (SELECT recipe_id, max(ep.merged_at) AS latest FROM (SELECT recipe_id, unnest(ids) AS id FROM rid) x JOIN ep ON ep.id = x.id GROUP BY 1),
      rr AS (SELECT rt.recipe_id, repo, support, conf, first_pos, {_PREFIX} AS pre, rtrim({_PREFIX}, '/') AS base, coalesce(sig, []) AS sig, latest, {names(cluster_form("before"))} AS bn, {names(cluster_form("after"))} AS an, max(support) OVER () AS top FROM rt LEFT JOIN sl ON sl.recipe_id = rt.recipe_id JOIN la ON la.recipe_id = rt.recipe_id),
      hh AS (SELECT delivery_id AS hunk_pos, repo, path, try_cast(regexp_extract(diff_hunk, '^@@ -\\d+(?:,\\d+)? \\+(\\d+)', 1) AS INTEGER) AS start_line, array_to_string(list_transform(list_filter(string_split(diff_hunk, chr(10)), lambda x : starts_with(x, '+') OR starts_with(x, ' ')), lambda x : substr(x, 2)), chr(10)) AS snippet
        FROM pull_review_comments WHERE diff_hunk IS NOT NULL AND path IS NOT NULL AND repo IS NOT NULL),
      mt AS (SELECT rr.*, hunk_pos, path, start_line, snippet FROM hh JOIN rr ON {same} AND (path = base OR starts_with(path, base || '/'))),
      nm AS (SELECT *, {names(cluster_form("snippet"))} AS hn FROM mt),
      jj AS (SELECT *, CASE WHEN len(hn) = 0 AND len(bn) = 0 THEN 1.0 WHEN len(hn) = 0 OR len(bn) = 0 THEN 0.0 ELSE len(list_intersect(hn, bn))::DOUBLE / (len(hn) + len(bn) - len(list_intersect(hn, bn))) END AS bs,
        CASE WHEN len(hn) = 0 AND len(an) = 0 THEN 1.0 WHEN len(hn) = 0 OR len(an) = 0 THEN 0.0 ELSE len(list_intersect(hn, an))::DOUBLE / (len(hn) + len(an) - len(list_intersect(hn, an))) END AS av,
        CASE WHEN len(sig) = 0 THEN 0.0 ELSE len(list_filter(sig, lambda x : contains(lower(snippet), x)))::DOUBLE / len(sig) END AS ss FROM nm),
      sc AS (SELECT recipe_id, hunk_pos, path, start_line, support, conf, first_pos, greatest(ss, bs) AS signal, 0.35::DOUBLE * (support::DOUBLE / greatest(1, top)) + 0.25::DOUBLE * conf + 0.2::DOUBLE * least(1.0::DOUBLE, len(list_filter(string_split(pre, '/'), lambda x : x <> '')) / 4.0::DOUBLE)
        + 0.1::DOUBLE * greatest(0.0::DOUBLE, 1 - (epoch_us(TIMESTAMPTZ '2025-06-01 00:00:00+00') - epoch_us(latest)) / 1e6::DOUBLE / 31536000.0::DOUBLE) + 0.1::DOUBLE * greatest(ss, bs) AS score FROM jj WHERE greatest(ss, bs) >= 0.15 AND NOT (av >= 0.85 AND av > bs))"""


_SUGGESTED = f"""{_scores("true")},
      one AS (SELECT *, min(hunk_pos) OVER (PARTITION BY recipe_id) AS first_seen FROM sc QUALIFY row_number() OVER (PARTITION BY recipe_id ORDER BY score DESC, hunk_pos) = 1),
      sugg AS (SELECT *, row_number() OVER (ORDER BY score DESC, first_seen, first_pos, recipe_id) AS "rank" FROM one)"""

_CARD = f"""{_MEDOID}, cd AS (SELECT *, CASE WHEN conf >= 0.85 THEN 'high' WHEN conf >= 0.6 THEN 'medium' ELSE 'low' END AS label, coalesce(list_distinct(languages), []) AS langs FROM rt)"""


def _shown(c: str) -> str:
    lines = f"string_split({c}, chr(10))"
    return f"CASE WHEN len({lines}) <= 40 THEN {c} ELSE array_to_string(list_slice({lines}, 1, 40), chr(10)) || chr(10) || '… (' || (len({lines}) - 40) || ' more lines)' END"


SQL = {
    "redact_hunks": f"SELECT delivery_id, md5({redact('diff_hunk')}) AS redacted, length({redact('body')})::INTEGER AS body_length FROM pull_review_comments",
    "secret_flags": "SELECT delivery_id, coalesce(" + " OR ".join(f"regexp_matches(diff_hunk, {q(p)})" for p, _ in REDACTIONS) + ", false) AS has_secret FROM pull_review_comments",
    "actionability": f"WITH {_ACT} SELECT * FROM act",
    "actionability_counts": f"WITH {_ACT} SELECT coalesce(discard_reason, 'kept') AS reason, count(*) AS n FROM act GROUP BY 1",
    "body_preview": f"WITH s AS (SELECT delivery_id, {trim(sub('body', r's+'.replace('s+', chr(92) + 's+'), ' '))} AS s FROM pull_review_comments) SELECT delivery_id, CASE WHEN length(s) <= 60 THEN s ELSE substr(s, 1, 59) || '…' END AS preview FROM s",
    "comment_keywords": f"""WITH w AS (SELECT delivery_id, regexp_extract_all({sub("lower(body)", "(?s)```.*?```", " ")}, '[a-z][a-z0-9_]{{2,}}') AS w FROM pull_review_comments),
      x AS (SELECT delivery_id, k, min(i) AS i FROM (SELECT delivery_id, unnest(w) AS k, generate_subscripts(w, 1) AS i FROM w) WHERE k NOT IN {among(COMMENT_STOP_WORDS)} GROUP BY 1, 2)
      SELECT w.delivery_id, CASE WHEN w.w IS NOT NULL THEN coalesce(s, '') END AS keywords FROM w LEFT JOIN (SELECT delivery_id, string_agg(k, ' ' ORDER BY i) AS s FROM x GROUP BY 1) y ON w.delivery_id = y.delivery_id""",
    "keyword_topk": f"""WITH w AS (SELECT source, unnest({_TITLE % 'text'}) AS word FROM documents),
      c AS (SELECT source, word, count(*) AS n FROM w GROUP BY 1, 2)
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, word)::INTEGER AS r FROM c) WHERE r <= 5""",
    "normal_forms": f"SELECT delivery_id, md5({span_form('diff_hunk')}) AS span, md5({cluster_form('diff_hunk')}) AS cluster, sha256({cluster_form('diff_hunk')}) AS sha FROM pull_review_comments",
    "name_sets": """WITH w AS (SELECT delivery_id, regexp_extract_all(diff_hunk, '[A-Za-z_][A-Za-z0-9_]*') AS w FROM pull_review_comments),
      x AS (SELECT delivery_id, k, min(i) AS i FROM (SELECT delivery_id, unnest(w) AS k, generate_subscripts(w, 1) AS i FROM w) GROUP BY 1, 2)
      SELECT w.delivery_id, CASE WHEN w.w IS NOT NULL THEN coalesce(s, '') END AS names, coalesce(c, 0)::INTEGER AS n FROM w LEFT JOIN (SELECT delivery_id, string_agg(k, ' ' ORDER BY i) AS s, count(*) AS c FROM x GROUP BY 1) y ON w.delivery_id = y.delivery_id""",
    "before_signals": f"""WITH {_EP}, l AS (
        SELECT id, list_concat(list_filter(list_transform(string_split(rejected.text, chr(10)), lambda x : {trim("x")}), lambda x : length(x) >= 4 AND regexp_matches(x, '[A-Za-z0-9]')),
          list_filter(regexp_extract_all(rejected.text, '[A-Za-z_][A-Za-z0-9_.]*'), lambda x : length(x) >= 4 AND NOT regexp_full_match(x, '_+'))) AS w FROM ep),
      x AS (SELECT id, s, min(i) AS i FROM (SELECT id, unnest(w) AS s, generate_subscripts(w, 1) AS i FROM l) GROUP BY 1, 2),
      r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS r FROM x)
      SELECT l.id, CASE WHEN l.w IS NOT NULL THEN coalesce(signals, '') END AS signals FROM l LEFT JOIN (SELECT id, string_agg(s, chr(10) ORDER BY i) AS signals FROM r WHERE r <= 12 GROUP BY 1) y ON l.id = y.id""",
    "path_features": f"""SELECT delivery_id, CASE lower(regexp_extract(regexp_extract(path, '[^/\\\\]*$'), '^.+\\.([^.]*)$', 1)) {' '.join(f"WHEN {q(k)} THEN {q(v)}" for k, v in LANGUAGES.items())} END AS language, {_SEG} AS segment FROM pull_review_comments""",
    "common_folders": f"""WITH p AS (SELECT pull_request_url, min(string_split(path, '/')) AS lo, max(string_split(path, '/')) AS hi, min(path) AS path FROM pull_review_comments WHERE path IS NOT NULL GROUP BY 1),
      s AS (SELECT *, list_slice(lo, 1, len(list_filter(range(1, least(len(lo), len(hi))), lambda i : list_slice(lo, 1, i) = list_slice(hi, 1, i)))) AS shared FROM p)
      SELECT pull_request_url, {_PREFIX} AS folder FROM s""",
    "suggestion_blocks": f"""SELECT delivery_id, CASE WHEN regexp_matches(body, '(?is)```suggestion[^\\n]*\\r?\\n(.*?)```') THEN md5(regexp_replace(regexp_extract(body, '(?is)```suggestion[^\\n]*\\r?\\n(.*?)```', 1), '\\r?\\n$', '')) END AS suggestion,
      CASE WHEN upper({trim("side")}) IN ('LEFT', 'L') THEN 'LEFT' WHEN upper({trim("side")}) IN ('RIGHT', 'R') THEN 'RIGHT' END AS side FROM pull_review_comments""",
    "stable_ids": f"SELECT delivery_id, 'ep_' || substr(sha256({trim('repo')} || chr(0) || {trim('id')}), 1, 16) AS episode_id, 'https://github.com/' || repo || '/pull/' || pr_number || '#discussion_' || {trim('id')} AS url FROM review_comments WHERE id IS NOT NULL",
    "confidence": f"""WITH {_EP}, s AS (SELECT repo, avg(CASE link_confidence WHEN 'high' THEN 1.0::DOUBLE WHEN 'medium' THEN 0.7 WHEN 'low' THEN 0.3 ELSE 0.0 END) AS a, sum(CASE WHEN link_confidence IN ('high', 'medium') THEN 1 ELSE 0 END) AS m FROM ep GROUP BY 1)
      SELECT repo, round(a, 6) AS avg_score, CASE WHEN round(a, 9) >= 0.85 THEN 'high' WHEN round(a, 9) >= 0.6 THEN 'medium' ELSE 'low' END AS label, m::BIGINT AS medium_or_higher FROM s""",
    "similar_pairs": f"""{_ALL}, f AS (SELECT bucket, form, min(k) AS k FROM it GROUP BY 1, 2)
      SELECT id_a, id_b FROM sim JOIN f x ON sim.bucket = x.bucket AND sim.a = x.k JOIN f y ON sim.bucket = y.bucket AND sim.b = y.k WHERE s >= 0.72""",
    "leader_clusters": f"{_ALL} SELECT id, leader_id FROM led",
    "cluster_support": f"{_ALL} SELECT support, count(*) AS n_clusters FROM (SELECT bucket, leader, count(*) AS support FROM led GROUP BY 1, 2) GROUP BY 1",
    "cluster_medoids": f"""{_ALL}, m AS (SELECT bucket, k, leader, leader_id, id FROM led), sy AS (SELECT bucket, a, b, s FROM sim UNION ALL SELECT bucket, b, a, s FROM sim),
      c AS (SELECT x.bucket, x.leader, x.leader_id, x.id, x.k, round(sum(sy.s), 9) AS mean FROM m x JOIN m y ON x.bucket = y.bucket AND x.leader = y.leader AND x.k <> y.k JOIN sy ON sy.bucket = x.bucket AND sy.a = x.k AND sy.b = y.k GROUP BY ALL),
      z AS (SELECT bucket, leader, leader_id, count(*) AS support, min(id) AS only FROM m GROUP BY 1, 2, 3)
      SELECT z.leader_id, coalesce(b.id, z.only) AS medoid_id, z.support FROM z LEFT JOIN (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY bucket, leader ORDER BY mean DESC, k) = 1) b ON z.bucket = b.bucket AND z.leader = b.leader""",
    "drop_histogram": f"""WITH {_EP} SELECT count(*) FILTER (WHERE accepted IS NULL) AS no_accepted, count(*) FILTER (WHERE accepted IS NOT NULL AND link_confidence = 'low') AS low_confidence,
      count(*) FILTER (WHERE accepted IS NOT NULL AND link_confidence = 'none') AS none_confidence FROM ep""",
    "recipes_from_episodes": f"""{_RECIPE} SELECT recipe_id, repo, support, array_to_string(ids, ',') AS episodes, coalesce({ordered_distinct('reviewers')}, '') AS reviewers, coalesce({ordered_distinct('languages')}, '') AS languages,
      {_PREFIX} AS prefixes, round(conf, 6) AS avg_link_confidence FROM rid""",
    "suppress_filter": f"{_RECIPE} SELECT recipe_id, repo FROM rid WHERE recipe_id >= 'rcp_4'",
    "list_recipes": f"""{_RECIPE}, f AS (SELECT recipe_id, support, conf, first_pos, len(ids)::INTEGER AS evidence_count, CASE WHEN conf >= 0.85 THEN 'high' WHEN conf >= 0.6 THEN 'medium' ELSE 'low' END AS confidence, {_PREFIX} AS pre FROM rid WHERE recipe_id >= 'rcp_4'),
      g AS (SELECT *, count(*) OVER () AS total_matched FROM f WHERE starts_with('src', pre) OR starts_with(pre, 'src') OR pre = 'src' OR pre = 'src/')
      SELECT recipe_id, support, evidence_count, confidence, total_matched FROM g ORDER BY support DESC, conf DESC, first_pos LIMIT 20""",
    "payload_budget": """SELECT doc_id, source, n_chars FROM (SELECT *, sum(strlen('{"doc_id":' || doc_id || coalesce(',"source":"' || source || '"', '') || coalesce(',"n_chars":' || n_chars, '') || '}') + 1) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) + 1 AS b FROM documents) WHERE b <= 32768""",
    "browse": f"""{_CARD}, m AS (SELECT * FROM cd WHERE len(langs) = 0 OR len(list_filter(langs, lambda x : lower(x) = 'go')) > 0)
      SELECT recipe_id, count(*) OVER () AS total_matched, count(*) OVER () > 20 AS truncated, support, len(ids)::INTEGER AS evidence_count, md5({_shown("before")}) AS before, md5({_shown("after")}) AS "after", coalesce({ordered_distinct("languages")}, '') AS languages
      FROM m ORDER BY support DESC, conf DESC, first_pos LIMIT 20""",
    "explain": f"""{_RECIPE}, o AS (SELECT * FROM rid ORDER BY recipe_id LIMIT 1), n AS (SELECT recipe_id, support, unnest(ids) AS id, generate_subscripts(ids, 1) - 1 AS place FROM o)
      SELECT recipe_id, place::INTEGER AS place, n.id AS episode_id, 'https://github.com/' || repo || '/pull/' || pr_number || '#discussion_' || comment_id AS comment_url, comment_body, link_confidence, reviewer, support FROM n JOIN ep ON ep.id = n.id""",
    "suggestions": f"""{_SUGGESTED} SELECT "rank"::INTEGER AS "rank", s.recipe_id, round(score, 6) AS score, s.path AS path, start_line, s.support, CASE WHEN s.conf >= 0.85 THEN 'high' WHEN s.conf >= 0.6 THEN 'medium' ELSE 'low' END AS confidence, len(rt.ids)::INTEGER AS n_evidence,
      md5(CASE WHEN start_line IS NULL THEN '--- before (rejected pattern)' || chr(10) || before || chr(10) || '+++ after (historical accept)' || chr(10) || after ELSE
        '--- a/' || s.path || chr(10) || '+++ b/' || s.path || chr(10) || '@@ -' || start_line || ',' || len(string_split(before, chr(10))) || ' +' || start_line || ',' || len(string_split(after, chr(10))) || ' @@' || chr(10)
        || array_to_string(list_transform(string_split(before, chr(10)), lambda x : '-' || x), chr(10)) || chr(10) || array_to_string(list_transform(string_split(after, chr(10)), lambda x : '+' || x), chr(10)) END) AS patch
      FROM sugg s JOIN rt ON rt.recipe_id = s.recipe_id WHERE "rank" <= 20""",
    "editor_suggestions": f"""{_SUGGESTED} SELECT recipe_id, support, CASE WHEN conf >= 0.85 THEN 'high' WHEN conf >= 0.6 THEN 'medium' ELSE 'low' END AS confidence FROM sugg WHERE "rank" <= 20 AND support >= 2 AND conf >= 0.6""",
    "compile_counts": f"""{_REPO}, z AS (SELECT count(*) AS n FROM led GROUP BY bucket, leader)
      SELECT count(*) FILTER (WHERE accepted IS NULL) AS no_accepted, count(*) FILTER (WHERE accepted IS NOT NULL AND link_confidence = 'low') AS low_confidence, count(*) FILTER (WHERE accepted IS NOT NULL AND link_confidence = 'none') AS none_confidence,
        count(*) AS episodes, (SELECT count(*) FROM led) AS eligible_episodes, (SELECT count(*) FROM z) AS clusters, (SELECT count(*) FROM z WHERE n < 2) AS below_min_support, 2::INTEGER AS min_support, 0.72::DOUBLE AS similarity_threshold FROM ep""",
    "suppressed_recipes": f"{_RECIPE} SELECT recipe_id, recipe_id < 'rcp_8' AS suppressed FROM rid",
    "single_high_recipes": f"""{_RECIPE.replace("HAVING count(*) >= 2", "HAVING count(*) >= 3 OR (count(*) = 1 AND max(link_confidence) = 'high')")} SELECT recipe_id, repo, support FROM rid""",
    "validated_links": f"""WITH {_EP}, v AS (SELECT *, CASE WHEN link_confidence = 'medium' AND accepted IS NOT NULL AND length(accepted.text) <> length(rejected.text) THEN length(accepted.text) > length(rejected.text) END AS said FROM ep)
      SELECT id, CASE WHEN said THEN 'high' WHEN NOT said THEN 'low' ELSE link_confidence END AS link_confidence, link_reason || CASE WHEN said THEN '+validated' WHEN NOT said THEN '+rejected_by_validation' ELSE '' END AS link_reason FROM v""",
    "comment_files": """WITH p AS (SELECT pr_number, max(merge_commit_sha) AS s FROM pull_requests GROUP BY 1), x AS (SELECT p.s AS commit_ref, path FROM review_comments c JOIN p ON p.pr_number = c.pr_number UNION ALL SELECT commit_id, path FROM review_comments)
      SELECT DISTINCT trim(commit_ref) AS commit_ref, trim(path) AS path FROM x WHERE trim(commit_ref) <> '' AND trim(path) <> ''""",
    "blob_index_rows": f"SELECT commit_ref, path, lower({trim('sha')}) AS sha FROM blob_index WHERE {trim('sha')} <> ''",
    "episode_index": f"WITH {_EP} SELECT pos, id, pr_number, comment_id, path, link_confidence, link_reason, actionable FROM ep",
    "recipe_listing": f"""{_RECIPE}, kc AS (SELECT bucket, leader, w, count(*) AS n FROM (SELECT bucket, leader, unnest({_TITLE % redact('comment_body')}) AS w FROM led) GROUP BY 1, 2, 3),
      kw AS (SELECT bucket, leader, w AS top FROM kc QUALIFY row_number() OVER (PARTITION BY bucket, leader ORDER BY n DESC, translate(w, '_-', chr(1) || chr(2))) = 1),
      tx AS (SELECT rid.*, top, {_PREFIX} AS prefixes, CASE WHEN rtrim({_PREFIX}, '/') = '' THEN 'repo' ELSE rtrim({_PREFIX}, '/') END AS hint FROM rid LEFT JOIN kw ON kw.bucket = rid.bucket AND kw.leader = rid.leader)
      SELECT recipe_id, CASE WHEN top IS NOT NULL THEN upper(substr(top, 1, 1)) || substr(top, 2) || ': ' || hint || ' rewrite (' || support || ' reviews)' ELSE 'Review rewrite in ' || hint || ' (' || support || ' reviews)' END AS title,
        support, prefixes, coalesce({ordered_distinct('languages')}, '') AS languages, false AS suppressed, first_pos AS recipe_order FROM tx""",
    "evidence": f"""{_RECIPE}, n AS (SELECT recipe_id, unnest(ids) AS id, generate_subscripts(ids, 1) - 1 AS place FROM rid)
      SELECT recipe_id, n.id AS episode_id, place::INTEGER AS place, pr_number, 'https://github.com/' || repo || '/pull/' || pr_number || '#discussion_' || comment_id AS comment_url FROM n JOIN ep ON ep.id = n.id""",
    "recipe_texts": f"""{_MEDOID},
      kc AS (SELECT bucket, leader, w, count(*) AS n FROM (SELECT bucket, leader, unnest({_TITLE % redact('comment_body')}) AS w FROM led) GROUP BY 1, 2, 3),
      kw AS (SELECT bucket, leader, list(w ORDER BY r) AS kw FROM (SELECT *, row_number() OVER (PARTITION BY bucket, leader ORDER BY n DESC, translate(w, '_-', chr(1) || chr(2))) AS r FROM kc) WHERE r <= 5 GROUP BY 1, 2),
      tx AS (SELECT rt.*, coalesce(kw, []) AS kw, CASE WHEN rtrim({_PREFIX}, '/') = '' THEN 'repo' ELSE rtrim({_PREFIX}, '/') END AS hint FROM rt LEFT JOIN kw ON kw.bucket = rt.bucket AND kw.leader = rt.leader)
      SELECT recipe_id, CASE WHEN len(kw) > 0 THEN upper(substr(kw[1], 1, 1)) || substr(kw[1], 2) || ': ' || hint || ' rewrite (' || support || ' reviews)' ELSE 'Review rewrite in ' || hint || ' (' || support || ' reviews)' END AS title,
        'Past reviewers flagged ' || CASE WHEN len(kw) > 0 THEN array_to_string(list_slice(kw, 1, 3), ', ') ELSE 'historical review pattern' END || ' in ' || hint || '; accepted fixes clustered from ' || support || ' linked episode(s).' AS rationale,
        before, after, 'compile_' || substr(sha256(repo || chr(0) || '2025-06-01T00:00:00.000Z'), 1, 12) AS compile_run_id, '2025-06-01T00:00:00.000Z' AS created_at, false AS suppressed FROM tx""",
    "patches": f"""{_MEDOID} SELECT recipe_id, '--- a/a/b.ts' || chr(10) || '+++ b/a/b.ts' || chr(10) || '@@ -7,' || len(string_split(before, chr(10))) || ' +7,' || len(string_split(after, chr(10))) || ' @@' || chr(10)
      || array_to_string(list_transform(string_split(before, chr(10)), lambda x : '-' || x), chr(10)) || chr(10) || array_to_string(list_transform(string_split(after, chr(10)), lambda x : '+' || x), chr(10)) AS patch FROM rt""",
    "suggest_topk": f"""{_scores("hh.repo = rr.repo")}
      SELECT recipe_id, hunk_pos, round(score, 6) AS score, round(signal, 6) AS signal FROM sc QUALIFY row_number() OVER (PARTITION BY recipe_id ORDER BY score DESC, hunk_pos) = 1""",
    "link_join": f"WITH {_EP}, p AS (SELECT repo, pr_number, arg_max(merge_commit_sha, id) AS merge_commit_sha FROM pull_requests GROUP BY 1, 2) SELECT ep.id, ep.pr_number, p.merge_commit_sha FROM ep LEFT JOIN p ON p.repo = ep.repo AND p.pr_number = ep.pr_number",
    "missing_parent": f"WITH {_EP} SELECT id, repo FROM ep WHERE NOT EXISTS (SELECT 1 FROM pull_requests p WHERE p.repo = ep.repo AND p.pr_number = ep.pr_number)",
    "first_hit_lookup": f"""SELECT repo, commit_ref, path, sha FROM (SELECT repo, {trim('commit_ref')} AS commit_ref, {trim('path')} AS path, lower({trim('sha')}) AS sha, entry_id FROM blob_index)
      WHERE commit_ref <> '' AND path <> '' AND sha <> '' QUALIFY row_number() OVER (PARTITION BY repo, commit_ref, path ORDER BY entry_id) = 1""",
    "only_blobs": "SELECT repo || ':' || path AS repo, min(sha) AS only_sha FROM contents WHERE content IS NOT NULL AND repo IS NOT NULL AND path IS NOT NULL GROUP BY ALL HAVING count(DISTINCT sha) = 1",
    "watermark": "SELECT epoch_us(merged_at) AS merged_at, pr_number AS \"number\" FROM pull_requests p WHERE merged_at IS NOT NULL ORDER BY p.merged_at DESC, pr_number DESC LIMIT 1",
    "watermark_merge": "SELECT epoch_us(merged_at) AS merged_at, pr_number AS \"number\" FROM pull_requests p WHERE merged_at IS NOT NULL AND pr_number IS NOT NULL ORDER BY p.merged_at DESC, pr_number DESC LIMIT 1",
    "incremental_since": "SELECT repo, pr_number AS \"number\", epoch_us(merged_at) AS merged_at, url FROM pull_requests p WHERE p.merged_at > TIMESTAMPTZ '2024-06-01 00:00:00+00'",
    "newest_prs": "SELECT DISTINCT repo, pr_number AS \"number\", epoch_us(merged_at) AS merged_at, id FROM pull_requests ORDER BY merged_at DESC, \"number\" DESC, id LIMIT 50",
    "ingest_counters": "WITH o AS (SELECT DISTINCT id FROM review_comments WHERE received_at < TIMESTAMPTZ '2024-06-01 00:00:00+00'), n AS (SELECT DISTINCT id FROM review_comments WHERE received_at >= TIMESTAMPTZ '2024-06-01 00:00:00+00') SELECT count(*) AS n, count(*) FILTER (WHERE id NOT IN (SELECT id FROM o WHERE id IS NOT NULL)) AS n_new FROM n",
    "upsert_created": """SELECT DISTINCT repo, pr_number, epoch_us(merged_at) AS merged_at, epoch_us(received_at) AS received_at FROM pull_requests n WHERE n.received_at >= TIMESTAMPTZ '2024-06-01 00:00:00+00'
      AND NOT EXISTS (SELECT 1 FROM pull_requests o WHERE o.received_at < TIMESTAMPTZ '2024-06-01 00:00:00+00' AND o.repo = n.repo AND o.pr_number = n.pr_number)""",
    "distinct_paths": "SELECT pull_request_url, count(DISTINCT path) AS n_paths FROM pull_review_comments WHERE path IS NOT NULL GROUP BY 1",
    "pull_projection": "SELECT id, pr_number AS \"number\", merge_commit_sha, base_ref, head_ref, title, url FROM pull_requests WHERE deleted_at IS NULL AND trim(merge_commit_sha) <> '' AND merged_at >= TIMESTAMPTZ '2024-01-01 00:00:01+00'",
    "comment_projection": f"""SELECT CASE WHEN trim(node_id) <> '' THEN node_id ELSE CAST(id AS VARCHAR) END AS id, try_cast(regexp_extract(pull_request_url, '/pulls/(\\d+)$', 1) AS INTEGER) AS pr_number, path,
      CASE WHEN trim(gh_user.login) <> '' THEN gh_user.login ELSE 'ghost' END AS author, md5({redact('body')}) AS body, line FROM pull_review_comments""",
    "blob_texts": f"""WITH d AS (SELECT sha, path, CASE WHEN encoding = 'base64' THEN decode(from_base64(regexp_replace(content, '\\s+', '', 'g'))) WHEN encoding = 'utf-8' THEN content END AS t FROM contents WHERE entry_type = 'file' AND content IS NOT NULL)
      SELECT sha, length(arg_min({redact('t')}, path))::INTEGER AS n FROM d WHERE t IS NOT NULL GROUP BY sha""",
    "repo_catalog": "SELECT DISTINCT string_split(repo, '/')[1] AS owner, string_split(repo, '/')[2] AS name FROM pull_review_comments WHERE repo IS NOT NULL",
    "freshness": f"""{_RECIPE}, c AS (SELECT repo, max(received_at) AS i FROM review_comments GROUP BY 1), l AS (SELECT repo, max(linked_at) AS l FROM ep GROUP BY 1), k AS (SELECT repo, max(received_at) AS k FROM pull_requests GROUP BY 1),
      e AS (SELECT repo, count(*) AS n FROM ep GROUP BY 1), r AS (SELECT repo, count(*) AS n FROM rid GROUP BY 1),
      x AS (SELECT c.repo, CASE WHEN l IS NOT NULL AND k IS NULL THEN 'Episodes linked but recipes not compiled since last link.' WHEN l > k THEN 'Link watermark is newer than last compile; compile again.' WHEN i > k THEN 'New pull requests ingested since last compile; compile again.' END AS reason,
        coalesce(e.n, 0) AS episode_count, coalesce(r.n, 0) AS recipe_count FROM c LEFT JOIN l USING (repo) LEFT JOIN k USING (repo) LEFT JOIN e USING (repo) LEFT JOIN r USING (repo))
      SELECT repo, reason IS NOT NULL AS stale, reason, episode_count, recipe_count FROM x""",
    "merge_events": """WITH e AS (SELECT *, event_id % 8 AS k, event_type = 'purchase' AND user_id >= 1 AND event_id % 8 NOT IN (2, 3, 4, 5) AS told FROM events)
      SELECT event_id, CASE WHEN k = 6 THEN 401 WHEN k IN (4, 5) THEN 400 WHEN told THEN 202 ELSE 200 END::INTEGER AS status, CASE WHEN told THEN 'acme/shop' || (user_id % 7) END AS repo, CASE WHEN told THEN user_id END::INTEGER AS "number" FROM e""",
    "merge_events_stream": """WITH r AS (SELECT DISTINCT 'acme/shop' || (user_id % 7) AS repo FROM events WHERE event_type = 'purchase' AND user_id >= 1 AND event_id % 8 IN (0, 1, 7))
      SELECT repo, 'ingest' AS stage, 'done' AS outcome FROM r UNION ALL SELECT repo, 'link', CASE WHEN ends_with(repo, '3') THEN 'failed' ELSE 'done' END FROM r""",
}
