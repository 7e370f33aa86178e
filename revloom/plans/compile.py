"""Linked episodes to recipes: eligibility, clusters, support, titles and compile counts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window as W, functions as F

from revloom.functions import text as T
from revloom.operators.clustering import THRESHOLD, bucket_of, clusters, medoids
from revloom.session import materialize

ELIGIBLE = ("high", "medium")


def eligible(episodes: DataFrame) -> DataFrame:
    """Episodes with accepted code and a link of high or medium confidence."""
    return episodes.filter(F.col("accepted").isNotNull() & F.col("link_confidence").isin(*ELIGIBLE))


def with_forms(episodes: DataFrame) -> DataFrame:
    """Episodes with ``form``, the normal forms of both sides, and ``bucket``; only the columns that compiling reads."""
    episodes = episodes.select("pos", "id", "repo", "path", "file_language", "comment_body", "rejected", "accepted", "link_confidence", "reviewer")
    rejected, accepted = (T.normalize_cluster(F.coalesce(F.col(f"{c}.text"), F.lit(""))) for c in ("rejected", "accepted"))
    return episodes.withColumn("form", F.concat_ws("\n", rejected, accepted)).withColumn("bucket", F.concat_ws("\x00", F.col("repo"), bucket_of(F.col("file_language"), F.col("path"))))


def drop_histogram(episodes: DataFrame) -> DataFrame:
    """(no_accepted, low_confidence, none_confidence): why episodes do not compile; the first reason counts."""
    gone, label = F.col("accepted").isNull(), F.col("link_confidence")
    return episodes.agg(
        F.coalesce(F.sum(gone.cast("bigint")), F.lit(0)).alias("no_accepted"),
        F.coalesce(F.sum((~gone & (label == "low")).cast("bigint")), F.lit(0)).alias("low_confidence"),
        F.coalesce(F.sum((~gone & (label == "none")).cast("bigint")), F.lit(0)).alias("none_confidence"),
    )


def title_keywords(members: DataFrame, most: int = 5) -> DataFrame:
    """(cluster keys, keywords): the most frequent title words of the comments of each cluster."""
    by = ["bucket", "leader"]
    counted = members.select(*by, F.explode(T.title_words(T.redact(F.col("comment_body")))).alias("word")).groupBy(*by, "word").agg(F.count("*").alias("n"))
    ranked = counted.withColumn("r", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("n"), F.expr("word collate UNICODE"), "word"))).filter(F.col("r") <= most)
    return ranked.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "word"))), lambda x: x["word"]).alias("keywords"))


def cluster_members(episodes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The eligible ones of ``episodes`` with their cluster (bucket, leader); written once for all that reads it."""
    items = materialize(with_forms(eligible(episodes)), "compile-items")
    return materialize(clusters(items.select("bucket", "pos", "form"), threshold).join(items.drop("form"), ["bucket", "pos"]), "compile-members")


def compile_meta(episodes: DataFrame, members: DataFrame, min_support: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """One row about a run: its settings, how many episodes and clusters there were, and why others dropped out."""
    sizes = members.groupBy("bucket", "leader").agg(F.count("*").alias("n"))
    below = F.coalesce(F.sum((F.col("n") < min_support).cast("bigint")), F.lit(0))
    return drop_histogram(episodes).withColumns(
        {
            "episodes": episodes.agg(F.count("*")).scalar(),
            "eligible_episodes": members.agg(F.count("*")).scalar(),
            "clusters": sizes.agg(F.count("*")).scalar(),
            "below_min_support": sizes.agg(below).scalar(),
            "min_support": F.lit(min_support),
            "similarity_threshold": F.lit(threshold),
        }
    )


def compile_recipes(episodes: DataFrame, min_support: int = 2, allow_single_high: bool = False, as_of: datetime | None = None, threshold: float = THRESHOLD, suppressed: DataFrame | None = None) -> DataFrame:
    """The recipes of linked ``episodes``, one row per cluster with enough support.

    ``episodes`` has the columns of the episode table and ``pos``, the order of episodes. Rows
    repeated in full are one episode. ``suppressed`` (recipe_id) marks recipes; ``as_of`` is the
    time of the run.
    """
    return recipes_of(cluster_members(episodes, threshold), min_support, allow_single_high, as_of, suppressed)


def recipes_of(members: DataFrame, min_support: int = 2, allow_single_high: bool = False, as_of: datetime | None = None, suppressed: DataFrame | None = None) -> DataFrame:
    """The recipes of clustered episodes."""
    as_of = as_of or datetime(2025, 1, 1)
    by = ["bucket", "leader"]
    segments = F.split("path", "/")
    labelled = lambda x: F.sum((F.col("link_confidence") == x).cast("bigint")).alias(f"n_{x}")
    told = members.groupBy(*by).agg(
        F.max("repo").alias("repo"),
        # The list of a recipe's episodes is its evidence; it is as long as its support.
        F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("id").alias("v")))), lambda x: x["v"]).alias("episode_ids"),
        F.count("*").alias("n"),
        *map(labelled, ELIGIBLE),
        F.min(segments).alias("low_path"),
        F.max(segments).alias("high_path"),
        F.min(F.struct("pos", "path"))["path"].alias("first_path"),
    )

    def distinct(column: str, out: str) -> DataFrame:
        """The values of a cluster in the order of their first members."""
        first = members.filter(T.trim(F.col(column)) != "").groupBy(*by, column).agg(F.min("pos").alias("pos"))
        return first.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col(column).alias("v")))), lambda x: x["v"]).alias(out))

    told = told.join(distinct("reviewer", "reviewers"), by, "left").join(distinct("file_language", "languages"), by, "left")
    told = told.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("reviewers", "languages")})
    centre = medoids(members.select("bucket", "leader", "form", "pos"))
    medoid = members.select("bucket", F.col("pos").alias("medoid"), F.col("rejected.text").alias("before"), F.col("accepted.text").alias("after"), F.col("link_confidence").alias("medoid_confidence"))
    enough = F.col("support") >= min_support
    if allow_single_high:
        enough = enough | ((F.col("support") == 1) & (F.col("medoid_confidence") == "high"))
    iso = as_of.strftime("%Y-%m-%dT%H:%M:%S.") + f"{as_of.microsecond // 1000:03d}Z"
    prefix = T.common_folder(F.col("low_path"), F.col("high_path"), F.col("first_path"))
    out = (
        told.join(centre.filter(F.col("support") >= (1 if allow_single_high else min_support)), by)
        .join(medoid, ["bucket", "medoid"])
        .filter(enough)
        .join(title_keywords(members), by, "left")
        .withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))
        .withColumn("path_prefixes", prefix)
        .withColumn("avg_link_confidence", sum((F.col(f"n_{x}") * T.confidence_score(F.lit(x)) for x in ELIGIBLE), F.lit(0.0)) / F.col("n"))
    )
    # The wording of titles and rationales.
    hint = F.regexp_replace(F.coalesce(F.get("path_prefixes", F.lit(0)), F.lit("")), "/$", "")
    hint = F.when(hint == "", "repo").otherwise(hint)
    top = F.col("keywords")[0]
    n = F.col("support").cast("string")
    title = F.when(F.size("keywords") > 0, F.concat(F.upper(F.substring(top, 1, 1)), F.expr("substring(keywords[0], 2)"), F.lit(": "), hint, F.lit(" rewrite ("), n, F.lit(" reviews)"))).otherwise(F.concat(F.lit("Review rewrite in "), hint, F.lit(" ("), n, F.lit(" reviews)")))
    phrase = F.when(F.size("keywords") > 0, F.array_join(F.slice("keywords", 1, 3), ", ")).otherwise("historical review pattern")
    recipes = out.select(
        T.recipe_id(F.col("repo"), F.col("episode_ids")).alias("recipe_id"),
        "repo",
        title.alias("title"),
        T.redact(F.concat(F.lit("Past reviewers flagged "), phrase, F.lit(" in "), hint, F.lit("; accepted fixes clustered from "), n, F.lit(" linked episode(s)."))).alias("rationale"),
        "path_prefixes",
        "languages",
        T.redact(F.col("before")).alias("before"),
        T.redact(F.col("after")).alias("after"),
        T.before_signals(F.col("before")).alias("before_signals"),
        "support",
        "episode_ids",
        "reviewers",
        "avg_link_confidence",
        F.col("leader").alias("recipe_order"),
        F.lit(iso).alias("created_at"),
        T.run_id(F.col("repo"), F.lit(iso)).alias("compile_run_id"),
    )
    if suppressed is None:
        return recipes.withColumn("suppressed", F.lit(False))
    marked = suppressed.select("recipe_id").distinct().withColumn("__s", F.lit(True))
    return recipes.join(marked, "recipe_id", "left").withColumn("suppressed", F.coalesce("__s", F.lit(False))).drop("__s")
