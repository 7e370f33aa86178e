"""From a comment to the code it rejected and the code that was accepted instead.

One Arrow function decides each row, because the line alignment needs an imperative walk and the
rest of the decision reads its result; texts cross to Python once.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F, types as T

from revloom.functions.diffs import edit_hunks, file_lines, new_side, undo_hunk
from revloom.functions.text import COMMENT_STOP_WORDS

#: Lines around the rejected code in which a change counts as near.
NEAR = 3

_STRINGS = re.compile(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`")
_NUMBERS = re.compile(r"\b\d+(?:\.\d+)?\b", re.ASCII)
_SUGGESTION = re.compile(r"```suggestion[^\n]*\r?\n(.*?)```", re.I | re.S)
_WORDS = re.compile(r"[a-z][a-z0-9_]{2,}")
_STOP = frozenset(COMMENT_STOP_WORDS)

SPAN = T.StructType([T.StructField("path", T.StringType()), T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType()), T.StructField("sha", T.StringType()), T.StructField("text", T.StringType()), T.StructField("normalized", T.StringType())])
LINK = T.StructType([T.StructField("rejected", SPAN), T.StructField("rejected_source", T.StringType()), T.StructField("before_source", T.StringType()), T.StructField("accepted", SPAN), T.StructField("confidence", T.StringType()), T.StructField("reason", T.StringType())])


def normal_span(text: str) -> str:
    return "\n".join(re.sub(r"\s+", "", _NUMBERS.sub("N", _STRINGS.sub("S", x.strip()))) for x in text.split("\n"))


def _span(path, first, last, sha, text):
    return {"path": path, "start_line": first, "end_line": last, "sha": sha, "text": text, "normalized": normal_span(text)}


def rejected_span(path, line, original_line, side, commit_id, hunk, blob, blob_sha):
    """(span, source): the code a comment stands at; its line in the file, else in the hunk, else what the hunk adds."""
    left = str(side or "").strip().upper() in ("LEFT", "L")
    at = line if line is not None else original_line
    if blob and blob_sha and blob_sha.strip() and not left and at is not None:
        lines = file_lines(blob)
        if 1 <= at <= len(lines):
            return _span(path, at, at, blob_sha.strip(), lines[at - 1]), "line_blob"
    side_lines = new_side(hunk) if hunk and hunk.strip() else None
    if side_lines is None:
        return None, "none"
    here = [x for x in side_lines if x[0] == at] if at is not None and not left else []
    chosen = here or [x for x in side_lines if x[2]] or side_lines
    sha = commit_id if commit_id and commit_id.strip() else "diff-hunk"
    return _span(path, chosen[0][0], chosen[-1][0], sha, "\n".join(x[1] for x in chosen)), "diff_hunk"


def before_text(comment_text, tip_text, hunk):
    """(text, source): the file before the fix; at the comment's commit, else the merged file with the hunk undone, else the merged file."""
    if comment_text:
        return comment_text, "comment_commit_blob"
    if tip_text:
        undone = undo_hunk(tip_text, hunk) if hunk and hunk.strip() else None
        return (undone, "hunk_reverse") if undone is not None else (tip_text, "tip_fallback")
    return None, "none"


@lru_cache(maxsize=64)
def _changes(before, after):
    """The changes between two texts; comments on one pair of versions come one after the other and share them."""
    return tuple(edit_hunks(file_lines(before), file_lines(after)))


def suggestion_of(body):
    found = _SUGGESTION.search(body or "")
    return re.sub(r"\r?\n$", "", found[1]) if found else None


def applied_suggestion(path, sha, after, suggestion, rejected):
    """Where the suggested lines stand in the file after: exactly, else up to literals and white space; near the rejected code if anywhere there."""
    want = file_lines(suggestion)
    k = len(want)
    if not k:
        return None
    starts = [i for i in range(len(after) - k + 1) if after[i : i + k] == want]
    if not starts:
        normal, own = normal_span("\n".join(after)).split("\n"), normal_span(suggestion).split("\n")
        if suggestion.endswith("\n"):
            own = own[:-1] if len(own) > k else own
        starts = [i for i in range(len(after) - k + 1) if normal[i : i + k] == own]
    if not starts:
        return None
    if rejected is not None:
        low, high = max(1, rejected["start_line"] - NEAR), rejected["end_line"] + NEAR
        starts = [i for i in starts if i + 1 <= high and low <= i + k] or starts
    i = starts[0]
    return _span(path, i + 1, i + k, sha, "\n".join(after[i : i + k]))


def accepted_fix(path, body, rejected, before, after, after_sha):
    """(span, confidence, reason): the change that answered a comment, by the first rule that holds."""
    if before is None or after is None or after_sha is None or not after_sha.strip():
        return None, "none", "missing_accepted_inputs"
    sha, new, suggestion = after_sha.strip(), file_lines(after), suggestion_of(body)
    if rejected is None:
        span = applied_suggestion(path, sha, new, suggestion, None) if suggestion is not None else None
        return (span, "high", "suggestion_block_applied") if span else (None, "none", "no_rejected_locus")
    old = file_lines(before)
    changes = list(_changes(before, after)) if before != after else []
    if not changes:
        return None, "none", "no_change"
    if suggestion is not None:
        span = applied_suggestion(path, sha, new, suggestion, rejected)
        if span:
            return span, "high", "suggestion_block_applied"
    low, high = max(1, rejected["start_line"] - NEAR), rejected["end_line"] + NEAR

    def near(c):
        i0, i1 = c[:2]
        return low - 1 <= i0 <= high if i0 == i1 else i0 + 1 <= high and low <= i1

    def span_of(c):
        return _span(path, c[2] + 1, c[3], sha, "\n".join(new[c[2] : c[3]])) if c[3] > c[2] else None

    overlapping = [c for c in changes if near(c)]
    for c in overlapping:
        was, now = "\n".join(old[c[0] : c[1]]), "\n".join(new[c[2] : c[3]])
        if c[1] > c[0] and c[3] > c[2] and (c[0] + 1, c[1]) == (rejected["start_line"], rejected["end_line"]) and was == rejected["text"] and was != now:
            return span_of(c), "high", "exact_span_replacement"
    least = min(overlapping or changes, key=lambda c: c[1] - c[0] + c[3] - c[2])
    if not overlapping:
        return span_of(least), "low", "same_file_only"
    words = {w for w in _WORDS.findall(re.sub(r"```.*?```", " ", body or "", flags=re.S).lower()) if w not in _STOP}
    code = "\n".join(new[least[2] : least[3]] + old[least[0] : least[1]]).lower()
    if not words or any(w in code for w in words):
        return span_of(least), "medium", "overlap_lexical"
    return span_of(least), "low", "same_file_only"


def link_one(path, body, line, original_line, side, commit_id, hunk, comment_text, comment_sha, tip_text, tip_sha):
    rejected, source = rejected_span(path, line, original_line, side, commit_id, hunk, comment_text or tip_text, comment_sha if comment_text else tip_sha)
    before, before_source = before_text(comment_text, tip_text, hunk)
    accepted, confidence, reason = accepted_fix(path, body, rejected, before, tip_text, tip_sha)
    return {"rejected": rejected, "rejected_source": source, "before_source": before_source, "accepted": accepted, "confidence": confidence, "reason": reason}


def _null(v):
    return None if v is None or v is pd.NA or v != v else v


@F.pandas_udf(LINK)
def link_row(path: pd.Series, body: pd.Series, line: pd.Series, original_line: pd.Series, side: pd.Series, commit_id: pd.Series, hunk: pd.Series, comment_text: pd.Series, comment_sha: pd.Series, tip_text: pd.Series, tip_sha: pd.Series) -> pd.DataFrame:
    rows = []
    for p, b, n, o, *rest in zip(path, body, line, original_line, side, commit_id, hunk, comment_text, comment_sha, tip_text, tip_sha):
        n, o = _null(n), _null(o)
        rows.append(link_one(_null(p), _null(b), None if n is None else int(n), None if o is None else int(o), *map(_null, rest)))
    return pd.DataFrame(rows, columns=[f.name for f in LINK.fields])


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("before_start", "before_end", "after_start", "after_end")])))
def line_hunks(before: pd.Series, after: pd.Series) -> pd.Series:
    """The changed line ranges between two texts, from 1; an empty range ends before it starts."""
    return pd.Series([None if x is None or y is None else [{"before_start": i0 + 1, "before_end": i1, "after_start": j0 + 1, "after_end": j1} for i0, i1, j0, j1 in edit_hunks(file_lines(x), file_lines(y))] for x, y in zip(before, after)])
