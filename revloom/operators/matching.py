"""Scoring of recipes against pieces of code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from revloom.functions import text as T

YEAR_SECONDS = 365 * 24 * 60 * 60


def _bare(prefix: Column) -> Column:
    return F.regexp_replace(prefix, "/$", "")


def depth_of_scope(path: Column, prefixes: Column) -> Column:
    """How specific the deepest prefix is that holds the file: a quarter per folder, at most one; zero for none."""
    depth = lambda p: F.when((path == _bare(p)) | path.startswith(F.concat(_bare(p), F.lit("/"))), F.least(F.lit(1.0), F.size(F.filter(F.split(p, "/"), lambda s: s != "")) / 4.0)).otherwise(0.0)
    return F.coalesce(F.array_max(F.transform(prefixes, depth)), F.lit(0.0))


def signal_strength(snippet: Column, signals: Column) -> Column:
    """The share of a recipe's signals that a snippet holds, letter case ignored."""
    low = F.lower(snippet)
    return F.when(F.size(signals) > 0, F.size(F.filter(signals, lambda s: low.contains(F.lower(s)))) / F.size(signals)).otherwise(0.0)


def recency(latest: Column, as_of: Column) -> Column:
    """One for evidence of this moment, down to zero for a year ago; future evidence counts above one."""
    age = (F.unix_micros(as_of) - F.unix_micros(latest)) / F.lit(1e6)
    return F.coalesce(F.greatest(F.lit(0.0), F.lit(1.0) - age / F.lit(float(YEAR_SECONDS))), F.lit(0.0))


def with_latest_evidence(recipes: DataFrame, episodes: DataFrame) -> DataFrame:
    """Recipes with ``latest``, the newest merge among their episodes; those without any known episode are gone."""
    found = recipes.select("recipe_id", F.explode("episode_ids").alias("id")).join(episodes.select("id", "merged_at"), "id").groupBy("recipe_id").agg(F.max("merged_at").alias("latest"))
    return recipes.join(found, "recipe_id")


def score_matches(hunks: DataFrame, recipes: DataFrame, as_of: Column, within: tuple[str, ...] = ()) -> DataFrame:
    """(hunk_pos, recipe_id, path, start_line, end_line, signal, score, recipe_order) of every hunk and recipe that fit.

    hunks: hunk_pos, path, snippet, start_line, end_line. recipes: with ``latest``. ``within`` names
    columns both sides must agree on, as the repository. Keys alone meet first, on the recipe's
    prefixes, which are equal to one of the file's own ancestors, so no cross join is made; then each
    side's names and the snippet are fetched once. A pair needs some signal, and code that already
    reads like the accepted form is left alone.
    """
    top = recipes.agg(F.greatest(F.lit(1), F.coalesce(F.max("support"), F.lit(1))).alias("max_support"))
    segs = F.split("path", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(segs)), lambda i: F.array_join(F.slice(segs, F.lit(1), i), "/"))
    h_scopes = hunks.select("hunk_pos", *within, F.explode(ancestors).alias("scope"))
    r_scopes = recipes.select("recipe_id", *within, F.explode(F.array_distinct(F.transform("path_prefixes", _bare))).alias("scope"))
    pairs = h_scopes.join(r_scopes, [*within, "scope"]).select("hunk_pos", "recipe_id").distinct()
    h = hunks.select("hunk_pos", "path", "snippet", "start_line", "end_line", T.name_set(T.normalize_cluster(F.col("snippet"))).alias("hunk_names"))
    names = [T.name_set(T.normalize_cluster(F.col(c))).alias(f"{c}_names") for c in ("before", "after")]
    r = recipes.select("recipe_id", "support", "avg_link_confidence", "path_prefixes", "latest", "before_signals", "recipe_order", *names)
    met = pairs.join(r, "recipe_id").join(h, "hunk_pos").withColumn("max_support", top.scalar())
    signal = signal_strength(F.col("snippet"), F.col("before_signals"))
    before, after = T.jaccard(F.col("hunk_names"), F.col("before_names")), T.jaccard(F.col("hunk_names"), F.col("after_names"))
    staged = met.withColumn("before_sim", before).withColumn("after_sim", after).withColumn("signal", F.greatest(signal, F.col("before_sim")))
    fit = staged.filter(F.col("signal") >= 0.15).filter(~((F.col("after_sim") >= 0.85) & (F.col("after_sim") > F.col("before_sim"))))
    score = (
        F.lit(0.35) * (F.col("support") / F.col("max_support"))
        + F.lit(0.25) * F.col("avg_link_confidence")
        + F.lit(0.2) * depth_of_scope(F.col("path"), F.col("path_prefixes"))
        + F.lit(0.1) * recency(F.col("latest"), as_of)
        + F.lit(0.1) * F.col("signal")
    )
    return fit.select("hunk_pos", "recipe_id", "path", "start_line", "end_line", "signal", score.alias("score"), "recipe_order")


def best_per_recipe(matches: DataFrame) -> DataFrame:
    """Of each recipe the match of the highest score, the first hunk at a tie; with ``first_seen``, the first hunk it fits."""
    shown = ["path", "start_line", "end_line", "signal", "recipe_order"]
    best = F.max(F.struct("score", (-F.col("hunk_pos")).alias("neg"), "hunk_pos", *shown)).alias("best")
    return matches.groupBy("recipe_id").agg(best, F.min("hunk_pos").alias("first_seen")).select("recipe_id", "first_seen", "best.score", "best.hunk_pos", *(f"best.{c}" for c in shown))


def unified_patch(path: Column, start_line: Column, before: Column, after: Column) -> Column:
    """A patch that replaces ``before`` by ``after`` at a line; without a line both blocks one after the other."""
    old, new = F.split(before, "\n"), F.split(after, "\n")
    at = start_line.cast("string")
    head = F.concat(F.lit("--- a/"), path, F.lit("\n+++ b/"), path, F.lit("\n@@ -"), at, F.lit(","), F.size(old).cast("string"), F.lit(" +"), at, F.lit(","), F.size(new).cast("string"), F.lit(" @@"))
    body = F.concat_ws("\n", F.transform(old, lambda x: F.concat(F.lit("-"), x)), F.transform(new, lambda x: F.concat(F.lit("+"), x)))
    block = F.concat(F.lit("--- before (rejected pattern)\n"), before, F.lit("\n+++ after (historical accept)\n"), after)
    return F.when(start_line.isNull(), block).otherwise(F.concat_ws("\n", head, body))
