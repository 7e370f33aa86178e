"""Line diffs and hunks, in plain Python for Arrow batches."""

from __future__ import annotations

import re

import numpy as np

HUNK_HEADER = re.compile(r"^@@\s+-(\d+)(?:,\d+)?\s+\+(\d+)(?:,\d+)?\s@@", re.ASCII)
#: Rows of the alignment table that are kept; the others are made again when they are walked through.
KEPT_CELLS = 4_000_000


def file_lines(text: str) -> list[str]:
    """The lines of a file: none for an empty text, none behind a final line break."""
    if text == "":
        return []
    lines = text.split("\n")
    return lines[:-1] if lines[-1] == "" else lines


def edit_hunks(before: list[str], after: list[str]) -> list[tuple[int, int, int, int]]:
    """(i0, i1, j0, j1) of each change: lines i0..i1 before became lines j0..j1 after (half open, from 0).

    The changes are those of a longest common subsequence; where a deletion and an insertion leave
    equally much in common, the deletion comes first. The alignment table is made row by row from
    the end; with long files only every so many rows are kept.
    """
    start = 0
    while start < min(len(before), len(after)) and before[start] == after[start]:
        start += 1
    codes: dict[str, int] = {}
    a = np.array([codes.setdefault(x, len(codes)) for x in before[start:]], dtype=np.int64)
    b = np.array([codes.setdefault(x, len(codes)) for x in after[start:]], dtype=np.int64)
    n, m = len(a), len(b)

    def row(i: int, below: np.ndarray) -> np.ndarray:
        best = below.copy()
        best[:-1] = np.where(b == a[i], below[1:] + 1, below[:-1])
        return np.maximum.accumulate(best[::-1])[::-1]

    every = max(1, -(-n * (m + 1) // KEPT_CELLS))
    kept = {n: np.zeros(m + 1, dtype=np.int32)}
    current = kept[n]
    for i in range(n - 1, -1, -1):
        current = row(i, current)
        if i % every == 0:
            kept[i] = current
    block: dict[int, np.ndarray] = {}

    def common(i: int) -> np.ndarray:
        if i in kept:
            return kept[i]
        if i not in block:
            block.clear()
            top = min(n, (i // every + 1) * every)
            low = kept[top]
            for k in range(top - 1, i // every * every, -1):
                low = block[k] = row(k, low)
        return block[i]

    out, i, j, i0, j0 = [], 0, 0, 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i] == b[j]:
            if i > i0 or j > j0:
                out.append((i0, i, j0, j))
            i, j = i + 1, j + 1
            i0, j0 = i, j
        elif j >= m or (i < n and common(i + 1)[j] >= common(i)[j + 1]):
            i += 1
        else:
            j += 1
    if i > i0 or j > j0:
        out.append((i0, i, j0, j))
    return [(p + start, q + start, r + start, s + start) for p, q, r, s in out]


def read_hunk(hunk: str | None) -> tuple[int, int, list[tuple[str, str]]] | None:
    """(old start, new start, [(sign, line)]) of the first hunk of a text; null without one.

    Lines without any sign that are empty count as context; those that begin with a backslash are skipped.
    """
    if hunk is None:
        return None
    lines = hunk.replace("\r\n", "\n").split("\n")
    for k, line in enumerate(lines):
        head = HUNK_HEADER.match(line)
        if head:
            break
    else:
        return None
    body = []
    for line in lines[k + 1 :]:
        if line.startswith("@@"):
            break
        if line == "":
            body.append((" ", ""))
        elif line[0] in "+- ":
            body.append((line[0], line[1:]))
    return int(head[1]), int(head[2]), body


def new_side(hunk: str | None) -> list[tuple[int, str, bool]] | None:
    """(line number, text, added) of a hunk's new side; null without any."""
    read = read_hunk(hunk)
    if read is None or read[1] < 1:
        return None
    lines = [(text, sign == "+") for sign, text in read[2] if sign != "-"]
    return [(read[1] + k, text, added) for k, (text, added) in enumerate(lines)] or None


def undo_hunk(after: str, hunk: str | None) -> str | None:
    """The file before a hunk, from the file after it; null if the file does not hold the hunk's new side."""
    read = read_hunk(hunk)
    if read is None or read[0] < 1 or read[1] < 1 or not read[2]:
        return None
    old = [t for s, t in read[2] if s != "+"]
    new = [t for s, t in read[2] if s != "-"]
    lines, at = file_lines(after), read[1] - 1
    if new and lines[at : at + len(new)] != new:
        return None
    return "\n".join(lines[:at] + old + lines[at + len(new) :]) + "\n"


def parse_diff(diff: str) -> list[dict]:
    """path, new_start, new_lines and raw of the hunks of a unified diff.

    A hunk needs a ``+++ b/`` line before it. Inside a hunk, lines that begin with ``+++ `` or
    ``--- `` are skipped and do not end it. Raises ValueError for a diff without hunks.
    """
    path, open_, out = None, None, []
    for line in re.split(r"\r?\n", diff):
        if open_ is not None and not line.startswith(("@@ ", "diff ")):
            if not line.startswith(("+++ ", "--- ")):
                open_["raw"].append(line)
                if line[:1] == " " or (line[:1] == "+" and not line.startswith("+++")):
                    open_["new_lines"].append(line[1:])
            continue
        open_ = None
        named = re.match(r"^\+\+\+ b/(.+)$", line)
        head = re.match(r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@", line, re.ASCII)
        if named:
            path = named[1]
        elif head and path is not None:
            open_ = {"path": path, "new_start": int(head[2]), "new_lines": [], "raw": [line]}
            out.append(open_)
    if not out:
        raise ValueError("no hunk: expected +++ b/<path> and @@ lines")
    return [h | {"raw": "\n".join(h["raw"])} for h in out]
