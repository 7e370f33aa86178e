"""Raw review history to linked episodes and discarded comments."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from revloom.functions import text as T
from revloom.functions.comments import discard_reason
from revloom.operators.linking import link_row
from revloom.session import materialize


def first_index_hits(index: DataFrame) -> DataFrame:
    """(repo, commit_ref, path, sha): of each place the entry with the smallest ``pos``; blank entries are none."""
    clean = index.select("repo", T.trim(F.col("commit_ref")).alias("commit_ref"), T.trim(F.col("path")).alias("path"), F.lower(T.trim(F.col("sha"))).alias("sha"), "pos")
    filled = clean.filter("commit_ref <> '' and path <> '' and sha <> ''")
    return filled.groupBy("repo", "commit_ref", "path").agg(F.min(F.struct("pos", "sha"))["sha"].alias("sha"))


def only_blobs(blobs: DataFrame) -> DataFrame:
    """(repo, only_sha, only_text): the blob of each repository that has just one."""
    one = blobs.groupBy("repo").agg(F.count_distinct("sha").alias("n"), F.min("sha").alias("only_sha")).filter("n = 1")
    text = blobs.groupBy("repo", F.col("sha").alias("only_sha")).agg(F.max("text").alias("only_text"))
    return one.select("repo", "only_sha").join(text, ["repo", "only_sha"])


def link_comments(comments: DataFrame, prs: DataFrame, index: DataFrame, blobs: DataFrame, extra_bots: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(episodes, discards) of review ``comments``.

    comments: repo, id, pr_number, path, body, author, diff_hunk, line, original_line, side,
    commit_id. prs: repo, number, merged_at, merge_commit_sha, id (the greatest id of a number
    counts). index: repo, commit_ref, path, sha, pos. blobs: repo, sha, text, one text per sha.

    Comments that ask for nothing are discarded before any blob is looked up, then those without a
    pull request, then those without rejected code.
    """
    comments = comments.select("repo", "id", "pr_number", "path", "body", "author", "diff_hunk", "line", "original_line", "side", "commit_id")
    told = comments.withColumn("discard_reason", discard_reason(F.col("body"), F.col("author"), extra_bots=extra_bots))
    merged = prs.groupBy("repo", F.col("number").alias("pr_number")).agg(F.max(F.struct("id", "merged_at", "merge_commit_sha")).alias("pr"))
    told = materialize(told.join(merged, ["repo", "pr_number"], "left"), "told")
    reason = F.when(F.col("discard_reason").isNotNull(), F.col("discard_reason")).when(F.col("pr").isNull(), "missing_pull_request")
    early = told.withColumn("discard_reason", reason)
    kept = early.filter("discard_reason is null")
    hits = first_index_hits(index)
    text = blobs.select("repo", "sha", "text")

    def sha_of(df: DataFrame, ref, name: str) -> DataFrame:
        shas = hits.select("repo", F.col("commit_ref").alias("__ref"), "path", F.col("sha").alias(f"{name}_sha"))
        return df.withColumn("__ref", ref).join(shas, ["repo", "__ref", "path"], "left").drop("__ref")

    def text_of(df: DataFrame, name: str) -> DataFrame:
        return df.join(text.select("repo", F.col("sha").alias(f"{name}_sha"), F.col("text").alias(f"{name}_text")), ["repo", f"{name}_sha"], "left")

    # Texts join each pair of file versions once; comments meet their pair, and both texts, last.
    named = materialize(sha_of(sha_of(kept, F.col("pr.merge_commit_sha"), "tip"), F.col("commit_id"), "comment"), "named")
    pair = {"__tip": F.coalesce("tip_sha", F.lit("")), "__comment": F.coalesce("comment_sha", F.lit(""))}
    pairs = text_of(text_of(named.select("repo", "tip_sha", "comment_sha").distinct(), "tip"), "comment")
    placed = named.withColumns(pair).drop("tip_sha", "comment_sha").join(pairs.withColumns(pair), ["repo", *pair])
    placed = placed.join(only_blobs(blobs), "repo", "left")
    use_only = F.col("tip_text").isNull() & F.col("only_text").isNotNull()
    placed = placed.withColumn("tip_sha", F.when(use_only, F.col("only_sha")).otherwise(F.col("tip_sha"))).withColumn("tip_text", F.coalesce("tip_text", "only_text"))
    linked = materialize(
        placed.select(
            "repo", "id", "pr_number", "path", "body", "author", "pr",
            link_row("path", "body", "line", "original_line", "side", "commit_id", "diff_hunk", "comment_text", "comment_sha", "tip_text", "tip_sha").alias("link"),
        ),
        "linked",
    )

    def shown(span: str):
        c = F.col(span)
        return F.when(c.isNotNull(), c.withField("text", T.redact(c["text"])).withField("normalized", T.redact(c["normalized"])))

    episodes = linked.filter("link.rejected is not null").select(
        T.episode_id(F.col("repo"), F.col("id")).alias("id"),
        "repo",
        "pr_number",
        F.col("id").alias("comment_id"),
        "path",
        T.language_of(F.col("path")).alias("file_language"),
        T.redact(F.col("body")).alias("comment_body"),
        shown("link.rejected").alias("rejected"),
        shown("link.accepted").alias("accepted"),
        F.col("link.confidence").alias("link_confidence"),
        F.concat(F.lit("rejected_from_"), F.col("link.rejected_source"), F.lit("+"), F.col("link.reason")).alias("link_reason"),
        F.lit(True).alias("actionable"),
        F.lit(None).cast("string").alias("discard_reason"),
        F.when(T.trim(F.col("author")) != "", F.col("author")).alias("reviewer"),
        F.col("pr.merged_at").alias("merged_at"),
    )
    gone = ["repo", F.col("id").alias("comment_id"), "pr_number", "path", "author"]
    preview = T.body_preview(T.redact(F.coalesce("body", F.lit("")))).alias("body_preview")
    discards = early.filter("discard_reason is not null").select(*gone, "discard_reason", preview).unionByName(linked.filter("link.rejected is null").select(*gone, F.lit("no_rejected_span").alias("discard_reason"), preview))
    return episodes, discards
