"""Pages of a forge's REST interface to raw tables, with a cursor that only moves forward."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from revloom.functions import text as T

PULL_SCHEMA = "id bigint, node_id string, number int, state string, title string, html_url string, merged_at string, merge_commit_sha string, draft boolean, base struct<ref: string>, head struct<ref: string>, updated_at string"
COMMENT_SCHEMA = "id bigint, node_id string, pull_request_review_id bigint, body string, path string, diff_hunk string, line int, original_line int, side string, commit_id string, original_commit_id string, user struct<login: string>, created_at string, updated_at string, html_url string, url string, pull_request_url string"
CONTENT_SCHEMA = "type string, encoding string, size int, name string, path string, content string, sha string, url string"
#: What was asked for, and the answer.
FILE_SCHEMA = "commit_ref string, asked_path string, " + CONTENT_SCHEMA


def _filled(c: Column) -> Column:
    return F.when(T.trim(c) != "", c)


def pull_rows(pulls: DataFrame, since: datetime | None = None, max_prs: int | None = None) -> DataFrame:
    """Merged pull requests of REST pages: no drafts, none without a merge commit, only after ``since``; the newest updated first up to ``max_prs``."""
    merged = F.try_to_timestamp("merged_at")
    kept = pulls.filter(~F.coalesce("draft", F.lit(False)) & merged.isNotNull() & _filled(F.col("merge_commit_sha")).isNotNull())
    if since is not None:
        kept = kept.filter(merged > F.lit(since))
    if max_prs is not None:
        kept = kept.orderBy(F.desc("updated_at"), F.desc("number")).limit(max_prs)
    return kept.select(F.coalesce(_filled(F.col("node_id")), F.col("id").cast("string")).alias("id"), "number", merged.alias("merged_at"), "merge_commit_sha", F.col("base.ref").alias("base_ref"), F.col("head.ref").alias("head_ref"), "title", F.col("html_url").alias("url"))


def oldest_first(prs: DataFrame) -> DataFrame:
    return prs.orderBy("merged_at", "number")


def comment_rows(comments: DataFrame, user: str = "user") -> DataFrame:
    """Review comments of REST pages; a missing author is the ghost, and body and hunk are stored redacted."""
    return comments.select(
        F.coalesce(_filled(F.col("node_id")), F.col("id").cast("string")).alias("id"),
        F.regexp_extract("pull_request_url", r"/pulls/(\d+)$", 1).cast("int").alias("pr_number"),
        "path",
        T.redact(F.col("body")).alias("body"),
        F.coalesce(_filled(F.col(f"{user}.login")), F.lit("ghost")).alias("author"),
        F.try_to_timestamp("created_at").alias("created_at"),
        T.redact(F.col("diff_hunk")).alias("diff_hunk"),
        "line",
        "original_line",
        F.col("side").cast("string").alias("side"),
        "commit_id",
        "html_url",
    )


def blob_rows(contents: DataFrame) -> DataFrame:
    """(sha, path, text): fetched files as redacted text; folders and other encodings are left out, the first of a sha counts."""
    text = F.when(F.col("encoding") == "base64", F.try_to_binary(F.regexp_replace("content", r"\s+", ""), F.lit("base64")))
    decoded = F.when(F.col("encoding") == "utf-8", F.col("content")).otherwise(F.call_function("try_validate_utf8", text.cast("string")))
    return contents.filter("type = 'file'").select("sha", "path", T.redact(decoded).alias("text")).filter("text is not null").groupBy("sha").agg(F.min_by("path", "path").alias("path"), F.min_by("text", "path").alias("text"))


def files_of(pulls: DataFrame, comments: DataFrame) -> DataFrame:
    """(commit_ref, path): the files comments are on, at the merge commit of their pull request and at the comment's commit."""
    merged = comments.join(pulls.select(F.col("number").alias("pr_number"), "merge_commit_sha"), "pr_number").select(F.col("merge_commit_sha").alias("commit_ref"), "path")
    places = merged.unionByName(comments.select(F.col("commit_id").alias("commit_ref"), "path"))
    return places.select(T.trim(F.col("commit_ref")).alias("commit_ref"), T.trim(F.col("path")).alias("path")).filter("commit_ref <> '' and path <> ''").distinct()


def index_entries(files: DataFrame) -> DataFrame:
    """(commit_ref, path, sha, pos) of fetched files."""
    return files.select("commit_ref", F.col("asked_path").alias("path"), F.lower(T.trim(F.col("sha"))).alias("sha"), F.lit(0).cast("bigint").alias("pos")).filter("sha <> ''")


def watermark(prs: DataFrame) -> DataFrame:
    """(merged_at, number) of the last merged pull request; no row for none."""
    return prs.agg(F.max(F.struct("merged_at", "number")).alias("w")).filter("w is not null").select("w.*")


def later(a: DataFrame, b: DataFrame) -> DataFrame:
    """The later of two watermarks, each of one row or none."""
    return watermark(a.unionByName(b))


def since_cursor(prs: DataFrame, last_merged_at: datetime | None) -> DataFrame:
    return prs if last_merged_at is None else prs.filter(F.col("merged_at") > F.lit(last_merged_at))


def upsert(stored: DataFrame, new: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(all rows, created rows): ``new`` replaces stored rows of the same key; created are those whose key was not stored."""
    return stored.join(new.select(*key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True), new.join(stored.select(*key).distinct(), key, "left_anti")


def counters(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """(n, n_new): rows of a batch, and those not stored before."""
    marked = new.join(stored.select(*key).distinct().withColumn("__old", F.lit(1)), key, "left")
    return marked.agg(F.count("*").alias("n"), F.sum(F.col("__old").isNull().cast("bigint")).alias("n_new"))
