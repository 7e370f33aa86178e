import random

import pytest

from revloom.functions.diffs import edit_hunks, file_lines, new_side, parse_diff, undo_hunk
from revloom.functions import diffs
from revloom.operators.linking import accepted_fix, link_one, rejected_span
from revloom.plans.link import link_comments


def apply(before, after, hunks):
    out, at = [], 0
    for i0, i1, j0, j1 in hunks:
        out += before[at:i0] + after[j0:j1]
        at = i1
    return out + before[at:]


@pytest.mark.parametrize("kept_cells", [4_000_000, 7])
def test_hunks_turn_before_into_after(monkeypatch, kept_cells):
    monkeypatch.setattr(diffs, "KEPT_CELLS", kept_cells)
    rnd = random.Random(5)
    for _ in range(400):
        b, a = ([rnd.choice("abcd") for _ in range(rnd.randint(0, 11))] for _ in "xy")
        hunks = edit_hunks(b, a)
        assert apply(b, a, hunks) == a
        n, m = len(b), len(a)
        lcs = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n):
            for j in range(m):
                lcs[i + 1][j + 1] = lcs[i][j] + 1 if b[i] == a[j] else max(lcs[i][j + 1], lcs[i + 1][j])
        assert n - sum(h[1] - h[0] for h in hunks) == lcs[n][m]
        assert all(x[1] < y[0] for x, y in zip(hunks, hunks[1:]))


def test_deletion_comes_first():
    assert edit_hunks(["a", "b"], ["b", "a"]) == [(0, 1, 0, 0), (2, 2, 1, 2)]


HUNK = "@@ -3,2 +3,3 @@ def f\n ctx\n-old\n+new1\n+new2\n\\ No newline"


def test_sides_of_a_hunk():
    assert new_side(HUNK) == [(3, "ctx", False), (4, "new1", True), (5, "new2", True)]
    assert new_side("no header") is None and new_side("@@ -1 +1 @@\n-x") is None and new_side(None) is None
    assert undo_hunk("1\n2\nctx\nnew1\nnew2\n6\n", HUNK) == "1\n2\nctx\nold\n6\n"
    assert undo_hunk("1\n2\nother\nnew1\nnew2\n", HUNK) is None
    assert undo_hunk("1\n2\n", "@@ -2,1 +2,0 @@\n-gone") == "1\ngone\n2\n"
    assert file_lines("") == [] and file_lines("a\n\n") == ["a", ""]


def test_parse_diff():
    d = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,2 +1,2 @@\n a\n-b\n+c\n--- a/y\n+++ b/y\n@@ -9 +9 @@\n+z"
    got = parse_diff(d)
    # Without a "diff " line the second file's hunk stays with the first file.
    assert [(h["path"], h["new_start"], h["new_lines"]) for h in got] == [("x", 1, ["a", "c"]), ("x", 9, ["z"])]
    with pytest.raises(ValueError):
        parse_diff("@@ -1 +1 @@\n+x")


@pytest.mark.parametrize(
    "line, original, side, hunk, blob, want",
    [
        (2, None, "RIGHT", HUNK, "a\nb\nc\n", ("line_blob", 2, 2, "b")),
        (None, 3, None, HUNK, "a\nb\nc\n", ("line_blob", 3, 3, "c")),
        (9, None, "RIGHT", HUNK, "a\n", ("diff_hunk", 4, 5, "new1\nnew2")),
        (5, None, "RIGHT", HUNK, None, ("diff_hunk", 5, 5, "new2")),
        (5, None, "LEFT", HUNK, "a\nb\nc\nd\ne\n", ("diff_hunk", 4, 5, "new1\nnew2")),
        (None, None, None, "@@ -1 +1 @@\n only", None, ("diff_hunk", 1, 1, "only")),
        (1, None, None, None, None, ("none",)),
    ],
)
def test_rejected(line, original, side, hunk, blob, want):
    span, source = rejected_span("p", line, original, side, "c1", hunk, blob, "s1")
    assert (source,) + ((span["start_line"], span["end_line"], span["text"]) if span else ()) == want


BEFORE = "".join(f"l{i}\n" for i in range(1, 21))


def rej(n):
    return {"path": "p", "start_line": n, "end_line": n, "sha": "s", "text": f"l{n}", "normalized": ""}


@pytest.mark.parametrize(
    "body, before, after, rejected, want",
    [
        ("x", None, "a", rej(1), ("none", "missing_accepted_inputs", None)),
        ("x", BEFORE, BEFORE, rej(1), ("none", "no_change", None)),
        ("x", BEFORE, BEFORE.replace("l5\n", "new\n"), rej(5), ("high", "exact_span_replacement", "new")),
        ("```suggestion\nnew\n```", BEFORE, BEFORE.replace("l5\n", "new\n"), rej(5), ("high", "suggestion_block_applied", "new")),
        ("```suggestion\nnew  (1)\n```", BEFORE, BEFORE.replace("l5\n", "new (2)\n"), rej(5), ("high", "suggestion_block_applied", "new (2)")),
        ("```suggestion\nnew\n```", BEFORE, BEFORE.replace("l5\n", "new\n"), None, ("high", "suggestion_block_applied", "new")),
        ("none", BEFORE, BEFORE.replace("l5\n", "new\n"), None, ("none", "no_rejected_locus", None)),
        ("rename thing", BEFORE, BEFORE.replace("l7\n", "thing\n"), rej(5), ("medium", "overlap_lexical", "thing")),
        ("it", BEFORE, BEFORE.replace("l7\n", "thing\n"), rej(5), ("medium", "overlap_lexical", "thing")),
        ("unrelated words", BEFORE, BEFORE.replace("l7\n", "thing\n"), rej(5), ("low", "same_file_only", "thing")),
        ("x", BEFORE, BEFORE.replace("l19\n", "far\n"), rej(5), ("low", "same_file_only", "far")),
        ("l7", BEFORE, BEFORE.replace("l7\n", ""), rej(5), ("medium", "overlap_lexical", None)),
    ],
)
def test_accepted(body, before, after, rejected, want):
    span, confidence, reason = accepted_fix("p", body, rejected, before, after, "sha")
    assert (confidence, reason, span and span["text"]) == want


def test_link_one_without_anything():
    got = link_one("p", None, None, None, None, None, None, None, None, None, None)
    assert got["rejected"] is None and got["reason"] == "missing_accepted_inputs"


def test_link_comments(spark):
    comments = spark.createDataFrame(
        [
            ("a/b", "c1", 1, "src/x.ts", "please rename thing", "ann", None, 5, None, "RIGHT", "com"),
            ("a/b", "c2", 1, "src/x.ts", "LGTM", "ann", None, 5, None, "RIGHT", "com"),
            ("a/b", "c3", 9, "src/x.ts", "please rename thing", "ann", None, 5, None, "RIGHT", "com"),
            ("a/b", "c4", 1, "src/y.ts", "please rename thing", "ann", None, None, None, None, None),
            (None, None, None, None, None, None, None, None, None, None, None),
        ],
        "repo string, id string, pr_number int, path string, body string, author string, diff_hunk string, line int, original_line int, side string, commit_id string",
    )
    prs = spark.createDataFrame([("a/b", 1, None, "old", "p0"), ("a/b", 1, None, "tip", "p1")], "repo string, number int, merged_at timestamp, merge_commit_sha string, id string")
    index = spark.createDataFrame([("a/b", "tip", "src/x.ts", "S1", 1), ("a/b", "tip", "src/x.ts", "s9", 2), ("a/b", "com", " src/x.ts", "s0", 3), ("a/b", "com", "src/x.ts", " ", 0)], "repo string, commit_ref string, path string, sha string, pos long")
    blobs = spark.createDataFrame([("a/b", "s0", BEFORE), ("a/b", "s1", BEFORE.replace("l5\n", "thing\n"))], "repo string, sha string, text string")
    episodes, discards = link_comments(comments, prs, index, blobs)
    got = episodes.collect()
    assert [(r.comment_id, r.link_confidence, r.link_reason, r.accepted.text, r.rejected.text) for r in got] == [("c1", "high", "rejected_from_line_blob+exact_span_replacement", "thing", "l5")]
    assert {(r.comment_id, r.discard_reason) for r in discards.collect()} == {("c2", "lgtm"), ("c3", "missing_pull_request"), ("c4", "no_rejected_span"), (None, "too_short")}
    empty = link_comments(comments.limit(0), prs.limit(0), index.limit(0), blobs.limit(0))
    assert [x.count() for x in empty] == [0, 0]
