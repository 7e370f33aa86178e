"""Answers from compiled recipes: suggestions, browsing, explanations, suppression, freshness."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from revloom.errors import InvalidDiff, NotFound
from revloom.functions import text as T
from revloom.functions.diffs import parse_diff
from revloom.operators import matching as M
from revloom.session import materialize

LIMIT, MAX_LIMIT = 8, 20
PAYLOAD_BYTES = 32 * 1024
CODE_LINES = 40


def clamp(limit: int | None, most: int = MAX_LIMIT) -> int:
    return LIMIT if limit is None else min(most, max(1, int(limit)))


def visible(recipes: DataFrame, suppressions: DataFrame | None = None, include_suppressed: bool = False) -> DataFrame:
    """Recipes that are not suppressed; ``suppressions`` (recipe_id) is the single truth where it is given."""
    if include_suppressed:
        return recipes
    if suppressions is None:
        return recipes.filter(~F.col("suppressed"))
    return recipes.join(suppressions.select("recipe_id").distinct(), "recipe_id", "left_anti")


def hunks_of(spark: SparkSession, diff: str | None = None, files: list[tuple[str, str]] | None = None, path_hint: str | None = None) -> DataFrame:
    """(hunk_pos, path, snippet, start_line, end_line) of a diff and of whole files, in this order."""
    rows = []
    if diff is not None:
        if not diff.strip():
            raise InvalidDiff("empty diff")
        try:
            rows += [(h["path"], h["new_lines"], h["new_start"]) for h in parse_diff(diff)]
        except ValueError as e:
            raise InvalidDiff(str(e)) from None
    rows += [(p, c.split("\n"), 1) for p, c in files or []]
    made = [(i, path_hint or p, "\n".join(lines), start, start + max(0, len(lines) - 1)) for i, (p, lines, start) in enumerate(rows)]
    return spark.createDataFrame(made, "hunk_pos int, path string, snippet string, start_line int, end_line int")


def evidence(recipes: DataFrame, episodes: DataFrame) -> DataFrame:
    """(recipe_id, place, episode_id, pr_number, comment_url): the known episodes of recipes, in their order."""
    named = recipes.select("recipe_id", F.posexplode("episode_ids").alias("place", "id"))
    known = episodes.select("id", "repo", "pr_number", "comment_id")
    return named.join(known, "id").select("recipe_id", "place", F.col("id").alias("episode_id"), "pr_number", T.evidence_url(F.col("repo"), F.col("pr_number"), F.col("comment_id")).alias("comment_url"))


def suggest(hunks: DataFrame, recipes: DataFrame, episodes: DataFrame, as_of: datetime, limit: int | None = None, patch: Column | None = None) -> DataFrame:
    """The best recipes for ``hunks``, one row each with rank, patch and evidence."""
    order = [F.desc("score"), "first_seen", "recipe_order", "recipe_id"]
    best = M.best_per_recipe(M.score_matches(hunks, M.with_latest_evidence(recipes, episodes), F.lit(as_of).cast("timestamp"))).orderBy(*order).limit(clamp(limit))
    # At most ``MAX_LIMIT`` rows, scored once; only they fetch texts.
    ranked = materialize(best.withColumn("rank", F.row_number().over(W.orderBy(*order))), "ranked").join(recipes.drop("recipe_order"), "recipe_id")
    proof = evidence(ranked.select("recipe_id", "episode_ids"), episodes).groupBy("recipe_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "pr_number", "comment_url", "episode_id"))), lambda e: F.struct(e["pr_number"].alias("pr_number"), e["comment_url"].alias("comment_url"), e["episode_id"].alias("episode_id"))).alias("evidence"))
    made = patch if patch is not None else M.unified_patch(F.col("path"), F.col("start_line"), F.col("before"), F.col("after"))
    return ranked.withColumn("patch", made).join(proof, "recipe_id").select("rank", "recipe_id", "score", "path", "start_line", "end_line", "patch", "title", "rationale", "support", T.confidence_label(F.col("avg_link_confidence")).alias("confidence"), "evidence")


def warnings(fresh: DataFrame, suggestions: DataFrame | None = None) -> list[str]:
    """What a caller should know, each once: recipes out of date, or nothing found. ``fresh``: the row of ``freshness``."""
    said = [r.banner for r in fresh.select("banner").collect() if r.banner]
    if suggestions is not None and suggestions.isEmpty():
        said.append("No recipe fits this code.")
    return list(dict.fromkeys(said))


def fits_path(prefixes: Column, query: str | None) -> Column:
    """Whether a recipe's scope and a path prefix lie on one line of folders; true without a query."""
    q = (query or "").strip()
    if not q:
        return F.lit(True)
    segs = q.split("/")
    head = lambda p: F.array_join(F.slice(F.array(*map(F.lit, segs)), F.lit(1), F.size(F.split(F.regexp_replace(p, "/$", ""), "/"))), "/")
    return F.exists(prefixes, lambda p: F.lit(q).startswith(p) | p.startswith(q) | (head(p) == F.regexp_replace(p, "/$", "")))


def fits_language(languages: Column, query: str | None) -> Column:
    q = (query or "").strip().lower()
    return F.lit(True) if not q else (F.size(languages) == 0) | F.exists(languages, lambda x: F.lower(x) == q)


def fits_words(query: str | None) -> Column:
    q = (query or "").strip().lower()
    if not q:
        return F.lit(True)
    return F.lower(F.concat_ws("\n", "title", "rationale", "before", "after", "before_signals")).contains(q)


def cards(recipes: DataFrame) -> DataFrame:
    """The short form of recipes."""
    return recipes.select(
        "recipe_id", "title", "rationale", T.truncated_code(F.col("before"), CODE_LINES).alias("before"), T.truncated_code(F.col("after"), CODE_LINES).alias("after"), "support",
        T.confidence_label(F.col("avg_link_confidence")).alias("confidence"), F.size("episode_ids").alias("evidence_count"), "path_prefixes", "languages", "avg_link_confidence", "recipe_order",
    )


def within_budget(ordered: DataFrame, order: list[Column], budget: int = PAYLOAD_BYTES) -> DataFrame:
    """The longest beginning of a list in the order of ``order`` whose JSON array stays within ``budget`` bytes.

    A row takes at least three bytes, so only so many rows come together, however long the list.
    """
    columns = [c for c in ordered.columns if c != "recipe_order"]
    ordered = ordered.orderBy(*order).limit(budget // 3)
    size = F.octet_length(F.to_json(F.struct(*columns)))
    so_far = F.sum(size + 1).over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)) + 1
    return ordered.withColumn("__b", so_far).filter(F.col("__b") <= budget).drop("__b")


def list_recipes(recipes: DataFrame, path: str | None = None, language: str | None = None, words: str | None = None, limit: int | None = None) -> DataFrame:
    """The cards that fit, by support and confidence, within limit and budget, with ``total_matched`` and ``truncated``."""
    order = [F.desc("support"), F.desc("avg_link_confidence"), F.col("recipe_order"), F.col("recipe_id")]
    matched = recipes.filter(fits_path(F.col("path_prefixes"), path) & fits_language(F.col("languages"), language) & fits_words(words))
    total = matched.agg(F.count("*").alias("total_matched"))
    shown = within_budget(cards(matched.orderBy(*order).limit(clamp(limit))), order)
    counted = shown.withColumn("total_matched", total.scalar()).withColumn("n", F.count("*").over(W.partitionBy()))  # at most ``limit`` rows
    return counted.withColumn("truncated", F.col("n") < F.col("total_matched")).drop("n", "recipe_order")


def explain(recipes: DataFrame, episodes: DataFrame, recipe_id: str) -> DataFrame:
    """The evidence of one recipe; raises if there is no such recipe."""
    one = recipes.filter(F.col("recipe_id") == recipe_id)
    if one.isEmpty():
        raise NotFound(f"no recipe {recipe_id}")
    shown = episodes.select(F.col("id").alias("episode_id"), "comment_body", "link_confidence", "link_reason", "reviewer", "merged_at")
    return evidence(one, episodes).join(shown, "episode_id").join(one.select("recipe_id", "title", "support"), "recipe_id").orderBy("place")


def set_suppressed(suppressions: DataFrame, recipe_id: str, on: bool = True) -> DataFrame:
    """(recipe_id): the suppressed recipes after one is added or taken away."""
    spark = suppressions.sparkSession
    one = spark.createDataFrame([(recipe_id,)], "recipe_id string")
    ids = suppressions.select("recipe_id")
    return (ids.unionByName(one).distinct() if on else ids.join(one, "recipe_id", "left_anti").distinct()).orderBy("recipe_id")


def freshness(cursors: DataFrame, episodes: DataFrame, recipes: DataFrame) -> DataFrame:
    """One row per repository of ``cursors`` (repo, ingest_at, link_at, compile_at): whether its recipes are up to date."""
    n_episodes = episodes.groupBy("repo").agg(F.count("*").alias("episode_count"))
    n_recipes = recipes.groupBy("repo").agg(F.count("*").alias("recipe_count"))
    # The reasons why recipes are out of date.
    reason = (
        F.when(F.col("link_at").isNotNull() & F.col("compile_at").isNull(), "Episodes linked but recipes not compiled since last link.")
        .when(F.col("link_at") > F.col("compile_at"), "Link watermark is newer than last compile; compile again.")
        .when(F.col("ingest_at") > F.col("compile_at"), "New pull requests ingested since last compile; compile again.")
    )
    return (
        cursors.join(n_episodes, "repo", "left").join(n_recipes, "repo", "left")
        .withColumn("reason", reason)
        .withColumn("stale", F.col("reason").isNotNull())
        .withColumn("banner", F.concat(F.lit("⚠ STALE: "), F.col("reason")))
        .fillna(0, ["episode_count", "recipe_count"])
    )


def preview(recipes: DataFrame, recipe_id: str, path: str, start_line: int | None = None) -> DataFrame:
    """(recipe_id, patch): one recipe applied at a place."""
    one = recipes.filter(F.col("recipe_id") == recipe_id)
    if one.isEmpty():
        raise NotFound(f"no recipe {recipe_id}")
    return one.select("recipe_id", M.unified_patch(F.lit(path), F.lit(start_line).cast("int"), F.col("before"), F.col("after")).alias("patch"))


def preview_of(suggestions: DataFrame, recipe_id: str) -> DataFrame:
    """(recipe_id, path, start_line, end_line, patch): one of ``suggestions`` as it would be applied."""
    one = suggestions.filter(F.col("recipe_id") == recipe_id)
    if one.isEmpty():
        raise NotFound(f"no suggestion of {recipe_id}")
    return one.select("recipe_id", "path", "start_line", "end_line", "patch")


def high_support(suggestions: DataFrame, least: int = 2) -> DataFrame:
    """Suggestions worth showing unasked: enough support and more than low confidence."""
    return suggestions.filter((F.col("support") >= least) & (F.col("confidence") != "low"))
