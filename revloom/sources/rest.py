"""A Spark data source for a forge's REST pages, with retries; recorded pages serve tests.

``spark.dataSource.register(ForgePages)``, then
``spark.read.format("forge_pages").schema(S).option("kind", "pulls").option("repo", "a/b").load()``.

Options: kind (pulls or comments), repo, path (a folder of recorded pages: nothing is
fetched), url (the interface's address, without path), token, max_prs, since, retries, numbers (the
pull requests whose comments to read, one partition each). Files at a ref are fetched by
``fetch_files``, from a table of places.
"""

from __future__ import annotations

import json
import os
import re
import time
import urllib.error
import urllib.parse
import urllib.request

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from revloom.errors import AccessFailed

PAGE = 100
RETRIES, BASE_MS = 5, 1000


def is_retryable(status: int | None, headers: dict[str, str], message: str = "") -> bool:
    """Server hiccups, and refusals that are rate limits."""
    if status in (429, 502, 503):
        return True
    return status == 403 and (headers.get("x-ratelimit-remaining") == "0" or "retry-after" in headers or "rate limit" in message.lower())


def delay_ms(headers: dict[str, str], attempt: int, base_ms: int = BASE_MS, now: float | None = None) -> int:
    """How long to wait: what the answer asks for, else until the limit resets, else twice as long each time."""
    after = headers.get("retry-after", "")
    if re.fullmatch(r"\d+(?:\.\d+)?", after):
        return int(float(after) * 1000)
    reset = headers.get("x-ratelimit-reset", "")
    if headers.get("x-ratelimit-remaining") == "0" and reset.isdigit():
        return max(0, int((int(reset) - (time.time() if now is None else now)) * 1000))
    return base_ms * 2**attempt


def fetch(url: str, token: str | None = None, retries: int = RETRIES, base_ms: int = BASE_MS, opener=urllib.request.urlopen, sleep=time.sleep):
    """The JSON answer of ``url``; None for 404."""
    for attempt in range(retries + 1):
        try:
            request = urllib.request.Request(url, headers={"Accept": "application/json", **({"Authorization": f"Bearer {token}"} if token else {})})
            with opener(request) as answer:
                return json.loads(answer.read())
        except urllib.error.HTTPError as e:
            headers = {k.lower(): v for k, v in (e.headers or {}).items()}
            if e.code == 404:
                return None
            if not is_retryable(e.code, headers, str(e.reason)):
                raise AccessFailed("unauthorized" if e.code in (401, 403) else "failed", f"{url}: {e.code}") from e
            if attempt == retries:
                raise AccessFailed("exhausted", f"{url}: {e.code} after {retries} retries") from e
            sleep(delay_ms(headers, attempt, base_ms) / 1000)
    raise AccessFailed("exhausted", url)


def pages_of(get, max_rows: int | None = None, keep=lambda row: True):
    """Rows of the pages ``get(1)``, ``get(2)``, ...; ends at an empty or short page or after ``max_rows`` kept rows."""
    page, kept = 1, 0
    while True:
        rows = get(page) or []
        for row in rows:
            if keep(row):
                yield row
                kept += 1
                if max_rows is not None and kept >= max_rows:
                    return
        if len(rows) < PAGE:
            return
        page += 1


def recorded(path: str, name: str):
    """Serves ``path``/``name``/page-N.json, or ``path``/``name``.json as the only page; nothing else is reachable."""

    def get(page: int):
        for file, ok in ((os.path.join(path, name, f"page-{page}.json"), True), (os.path.join(path, f"{name}.json"), page == 1)):
            if ok and os.path.exists(file):
                with open(file, encoding="utf-8") as f:
                    return json.load(f)
        return []

    return get


def file_at(o: dict, ref: str, path: str) -> dict | None:
    """The contents answer for a path at a ref, None where there is none; folders and what is no base64 file are errors."""
    if o.get("path"):
        row = recorded(o["path"], f"contents/{urllib.parse.quote(ref, safe='')}/{urllib.parse.quote(path, safe='')}")(1) or None
    else:
        row = fetch(f"{o['url']}/repos/{o['repo']}/contents/{urllib.parse.quote(path)}?ref={urllib.parse.quote(ref, safe='')}", o.get("token"), int(o.get("retries", RETRIES)))
    if row is None:
        return None
    kind = row.get("type") if isinstance(row, dict) else "dir"
    if kind != "file":
        raise AccessFailed("failed", f"{path}@{ref}: a file was asked for, not {kind}")
    if row.get("encoding") != "base64" or not isinstance(row.get("content"), str):
        raise AccessFailed("failed", f"{path}@{ref}: no base64 content")
    return row


def fetch_files(places: DataFrame, options: dict[str, str]) -> DataFrame:
    """The contents answers for ``places`` (commit_ref, path), fetched where the rows lie; a file that is not there gives no row."""
    from revloom.plans.ingest import FILE_SCHEMA

    names = [f.split()[0] for f in FILE_SCHEMA.split(", ")]

    def run(batches):
        for b in batches:
            rows = []
            for ref, path in zip(b.column("commit_ref").to_pylist(), b.column("path").to_pylist()):
                row = file_at(options, ref, path)
                if row is not None:
                    row = row | {"commit_ref": ref, "asked_path": path}
                    rows.append([row.get(n) if n == "size" or row.get(n) is None else str(row.get(n)) for n in names])
            cols = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "size" else pa.string()) for c, n in zip(cols, names)], names=names)

    return places.select("commit_ref", "path").mapInArrow(run, FILE_SCHEMA)


def is_merged(row: dict, since: str | None) -> bool:
    return not row.get("draft") and bool(row.get("merged_at")) and bool(row.get("merge_commit_sha")) and (since is None or row["merged_at"] > since)


class ForgePages(DataSource):
    @classmethod
    def name(cls):
        return "forge_pages"

    def schema(self):
        from revloom.plans.ingest import COMMENT_SCHEMA, PULL_SCHEMA

        return PULL_SCHEMA if self.options.get("kind", "pulls") == "pulls" else COMMENT_SCHEMA

    def reader(self, schema):
        return _Reader(schema, dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, schema, options):
        self.schema, self.options = schema, options

    def partitions(self):
        if self.options.get("kind", "pulls") == "pulls":
            return [InputPartition(None)]
        return [InputPartition(int(n)) for n in self.options.get("numbers", "").split(",") if n.strip()]

    def read(self, partition):
        if partition is None:  # no pull request, no comments
            return
        o = self.options
        number = partition.value
        if o.get("path"):
            get = recorded(o["path"], "pulls" if number is None else f"comments/{number}")
        else:
            base = f"{o['url']}/repos/{o['repo']}/pulls"
            query = "?state=closed&sort=updated&direction=desc&" if number is None else f"/{number}/comments?"
            get = lambda page: fetch(f"{base}{query}per_page={PAGE}&page={page}", o.get("token"), int(o.get("retries", RETRIES)))
        since = o.get("since")
        rows = pages_of(get, int(o["max_prs"]), lambda r: is_merged(r, since)) if number is None and "max_prs" in o else pages_of(get)
        for row in rows:
            yield _shaped(row, self.schema)


def _shaped(row, schema):
    """A JSON object as a tuple of a struct type; absent fields are null, numbers for texts become texts."""
    from pyspark.sql import types as T

    out = []
    for f in schema.fields:
        v = row.get(f.name) if row else None
        if v is not None and isinstance(f.dataType, T.StructType):
            v = _shaped(v, f.dataType)
        elif v is not None and isinstance(f.dataType, T.StringType) and not isinstance(v, str):
            v = str(v)
        out.append(v)
    return tuple(out)
