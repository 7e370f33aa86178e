"""Queries over the driver tables for each operator of the core, and their SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from revloom.functions import comments as C, text as T
from revloom.functions.message_ids import id_pairs, with_message_key
from revloom.operators import clustering, matching
from revloom.operators.linking import line_hunks
from revloom.operators.ordering import with_positions
from revloom.operators.validation import validate_medium
from revloom.plans import compile as compiling, ingest, link, retrieve
from revloom.session import materialize, scratch_path, table
from revloom.sources.store import index_rows, recipe_index
from revloom.streaming import merges

AS_OF = datetime(2025, 6, 1)


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return table(spark, sf, name)


def _episodes(spark, sf):
    """One row per episode with its order."""
    one = _t(spark, sf, "episodes").filter("id is not null").dropDuplicates(["id"])
    return with_positions(one, ["id"])


def _md5(c):
    return F.md5(c)


def redact_hunks(spark, sf):
    return _t(spark, sf, "pull_review_comments").select("delivery_id", _md5(T.redact(F.col("diff_hunk"))).alias("redacted"), F.length(T.redact(F.col("body"))).alias("body_length"))


def secret_flags(spark, sf):
    return _t(spark, sf, "pull_review_comments").select("delivery_id", F.coalesce(T.is_redactable(F.col("diff_hunk")), F.lit(False)).alias("has_secret"))


def actionability(spark, sf):
    return _t(spark, sf, "pull_review_comments").select("delivery_id", C.discard_reason(F.col("body"), F.col("gh_user.login")).alias("discard_reason"))


def actionability_counts(spark, sf):
    return actionability(spark, sf).groupBy(F.coalesce("discard_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def body_preview(spark, sf):
    return _t(spark, sf, "pull_review_comments").select("delivery_id", T.body_preview(F.col("body"), 60).alias("preview"))


def comment_keywords(spark, sf):
    return _t(spark, sf, "pull_review_comments").select("delivery_id", F.array_join(T.comment_keywords(F.col("body")), " ").alias("keywords"))


def keyword_topk(spark, sf):
    words = _t(spark, sf, "documents").select("source", F.explode(T.title_words(F.col("text"))).alias("word"))
    counted = words.groupBy("source", "word").agg(F.count("*").alias("n"))
    return counted.withColumn("r", F.row_number().over(W.partitionBy("source").orderBy(F.desc("n"), "word"))).filter("r <= 5")


def normal_forms(spark, sf):
    c = F.col("diff_hunk")
    return _t(spark, sf, "pull_review_comments").select("delivery_id", _md5(T.normalize_span(c)).alias("span"), _md5(T.normalize_cluster(c)).alias("cluster"), T.normal_hash(c).alias("sha"))


def name_sets(spark, sf):
    return _t(spark, sf, "pull_review_comments").select("delivery_id", F.array_join(T.name_set(F.col("diff_hunk")), " ").alias("names"), F.size(T.name_set(F.coalesce(F.col("diff_hunk"), F.lit("")))).alias("n"))


def before_signals(spark, sf):
    return _episodes(spark, sf).select("id", F.array_join(T.before_signals(F.col("rejected.text")), "\n").alias("signals"))


def path_features(spark, sf):
    return _t(spark, sf, "pull_review_comments").select("delivery_id", T.language_of(F.col("path")).alias("language"), T.top_segment(F.col("path")).alias("segment"))


def common_folders(spark, sf):
    """The shared folder of all paths commented on in each pull request."""
    segs = F.split("path", "/")
    rows = _t(spark, sf, "pull_review_comments").filter("path is not null")
    agg = rows.groupBy("pull_request_url").agg(F.min(segs).alias("a"), F.max(segs).alias("b"), F.min("path").alias("p"))
    return agg.select("pull_request_url", F.array_join(T.common_folder(F.col("a"), F.col("b"), F.col("p")), ",").alias("folder"))


def suggestion_blocks(spark, sf):
    return _t(spark, sf, "pull_review_comments").select("delivery_id", _md5(T.suggestion_block(F.col("body"))).alias("suggestion"), T.comment_side(F.col("side")).alias("side"))


def stable_ids(spark, sf):
    return _t(spark, sf, "review_comments").filter("id is not null").select("delivery_id", T.episode_id(F.col("repo"), F.col("id")).alias("episode_id"), T.evidence_url(F.col("repo"), F.col("pr_number"), T.trim(F.col("id"))).alias("url"))


def confidence(spark, sf):
    """Per repository: the mean score and its label, and the links of medium confidence or more."""
    return _episodes(spark, sf).groupBy("repo").agg(F.round(F.avg(T.confidence_score(F.col("link_confidence"))), 6).alias("avg_score"), T.confidence_label(F.round(F.avg(T.confidence_score(F.col("link_confidence"))), 9)).alias("label"), F.sum(F.col("link_confidence").isin("high", "medium").cast("bigint")).alias("medium_or_higher"))


def _buckets(spark, sf):
    e = compiling.eligible(_episodes(spark, sf))
    return compiling.with_forms(e).withColumn("bucket", clustering.bucket_of(F.col("file_language"), F.col("path")))


def similar_pairs(spark, sf):
    items = materialize(_buckets(spark, sf).select("bucket", "pos", "form", "id"), "items")
    fs = materialize(clustering.forms(items), "forms")
    ids = items.groupBy("bucket", "form").agg(F.min("id").alias("id")).join(fs, ["bucket", "form"]).select("bucket", "first", "id")
    e = clustering.similar_forms(fs)
    return e.join(ids.withColumnsRenamed({"first": "a", "id": "id_a"}), ["bucket", "a"]).join(ids.withColumnsRenamed({"first": "b", "id": "id_b"}), ["bucket", "b"]).select("id_a", "id_b")


def _clusters(spark, sf):
    items = materialize(_buckets(spark, sf).select("bucket", "pos", "form", "id"), "items")
    return materialize(clustering.clusters(items), "clusters"), items


def leader_clusters(spark, sf):
    c, items = _clusters(spark, sf)
    names = items.select("bucket", F.col("pos").alias("leader"), F.col("id").alias("leader_id"))
    return c.join(names, ["bucket", "leader"]).select("id", "leader_id")


def cluster_support(spark, sf):
    c, _ = _clusters(spark, sf)
    return c.groupBy("bucket", "leader").agg(F.count("*").alias("support")).groupBy("support").agg(F.count("*").alias("n_clusters"))


def cluster_medoids(spark, sf):
    c, items = _clusters(spark, sf)
    names = items.select("bucket", "pos", "id")
    m = clustering.medoids(c.select("bucket", "leader", "form", "pos"))
    return m.join(names.withColumnsRenamed({"pos": "leader", "id": "leader_id"}), ["bucket", "leader"]).join(names.withColumnsRenamed({"pos": "medoid", "id": "medoid_id"}), ["bucket", "medoid"]).select("leader_id", "medoid_id", "support")


def drop_histogram(spark, sf):
    return compiling.drop_histogram(_episodes(spark, sf))


def _recipes(spark, sf):
    return compiling.compile_recipes(_episodes(spark, sf), as_of=AS_OF)


def recipes_from_episodes(spark, sf):
    return _recipes(spark, sf).select("recipe_id", "repo", "support", F.array_join("episode_ids", ",").alias("episodes"), F.array_join("reviewers", ",").alias("reviewers"), F.array_join("languages", ",").alias("languages"), F.array_join("path_prefixes", ",").alias("prefixes"), F.round("avg_link_confidence", 6).alias("avg_link_confidence"))


def recipe_texts(spark, sf):
    return _recipes(spark, sf).select("recipe_id", "title", "rationale", "before", "after", "compile_run_id", "created_at", "suppressed")


def _visible(spark, sf):
    """Recipes but those with an id that begins with 0 to 3, which count as suppressed."""
    r = materialize(_recipes(spark, sf), "recipes")
    return retrieve.visible(r, r.filter("recipe_id < 'rcp_4'").select("recipe_id"))


def suppress_filter(spark, sf):
    return _visible(spark, sf).select("recipe_id", "repo")


def list_recipes(spark, sf):
    """The browse list (a top-k report)."""
    return retrieve.list_recipes(_visible(spark, sf), path="src", limit=20).select("recipe_id", "support", "evidence_count", "confidence", "total_matched")


def payload_budget(spark, sf):
    """The first documents whose JSON forms fit into one answer together."""
    return retrieve.within_budget(_t(spark, sf, "documents").select("doc_id", "source", "n_chars"), [F.col("doc_id")])


def browse(spark, sf):
    """The cards of a language that hold some words (a top-k report)."""
    found = retrieve.list_recipes(_recipes(spark, sf), language="Go", words="Past Reviewers", limit=20)
    return found.select("recipe_id", "total_matched", "truncated", "support", "evidence_count", F.md5("before").alias("before"), F.md5("after").alias("after"), F.array_join("languages", ",").alias("languages"))


def explain(spark, sf):
    """All that speaks for the first recipe by id."""
    recipes = materialize(_recipes(spark, sf), "recipes")
    first = recipes.agg(F.min("recipe_id")).first()[0]
    if first is None:
        return spark.createDataFrame([], "recipe_id string, place int, episode_id string, comment_url string, comment_body string, link_confidence string, reviewer string, support bigint")
    return retrieve.explain(recipes, _episodes(spark, sf), first).select("recipe_id", "place", "episode_id", "comment_url", "comment_body", "link_confidence", "reviewer", "support")


def suggestions(spark, sf):
    """The best recipes for all reviewed code together (a top-k report)."""
    recipes = materialize(_recipes(spark, sf), "recipes")
    found = retrieve.suggest(_comment_hunks(spark, sf), recipes, _episodes(spark, sf), AS_OF, 20)
    return found.select("rank", "recipe_id", F.round("score", 6).alias("score"), "path", "start_line", "support", "confidence", F.size("evidence").alias("n_evidence"), F.md5("patch").alias("patch"))


def editor_suggestions(spark, sf):
    return retrieve.high_support(suggestions(spark, sf)).select("recipe_id", "support", "confidence")


def compile_counts(spark, sf):
    e = _episodes(spark, sf)
    return compiling.compile_meta(e, compiling.cluster_members(e))


def suppressed_recipes(spark, sf):
    """Recipes compiled while those with an id that begins with 0 to 7 are suppressed."""
    members = compiling.cluster_members(_episodes(spark, sf))
    ids = compiling.recipes_of(members, as_of=AS_OF).select("recipe_id").filter("recipe_id < 'rcp_8'")
    return compiling.recipes_of(members, as_of=AS_OF, suppressed=materialize(ids, "suppressed")).select("recipe_id", "suppressed")


def single_high_recipes(spark, sf):
    """Recipes where one episode of high confidence is enough."""
    return compiling.compile_recipes(_episodes(spark, sf), min_support=3, allow_single_high=True, as_of=AS_OF).select("recipe_id", "repo", "support")


def validated_links(spark, sf):
    """Links after a second opinion: accepted code that is longer than the rejected one is said to answer the comment."""
    def scorer(comment, rejected, accepted):
        return None if len(accepted) == len(rejected) else 'I think: {"addresses": %s}.' % ("true" if len(accepted) > len(rejected) else "false")

    return validate_medium(_episodes(spark, sf), scorer).select("id", "link_confidence", "link_reason")


def comment_files(spark, sf):
    """The places whose files are fetched for the kept messages."""
    pulls = _t(spark, sf, "pull_requests").groupBy("pr_number").agg(F.max("merge_commit_sha").alias("merge_commit_sha")).select(F.col("pr_number").alias("number"), "merge_commit_sha")
    return ingest.files_of(pulls, _t(spark, sf, "review_comments"))


def blob_index_rows(spark, sf):
    files = _t(spark, sf, "blob_index").select("commit_ref", F.col("path").alias("asked_path"), "sha")
    return ingest.index_entries(files).select("commit_ref", "path", "sha")


def episode_index(spark, sf):
    return index_rows(_episodes(spark, sf))


def recipe_listing(spark, sf):
    return recipe_index(_recipes(spark, sf)).select("recipe_id", "title", "support", F.array_join("path_prefixes", ",").alias("prefixes"), F.array_join("languages", ",").alias("languages"), "suppressed", "recipe_order")


def evidence(spark, sf):
    return retrieve.evidence(_recipes(spark, sf), _episodes(spark, sf)).select("recipe_id", "episode_id", "place", "pr_number", "comment_url")


def _comment_hunks(spark, sf):
    new = F.transform(F.filter(F.split("diff_hunk", "\n"), lambda x: x.startswith("+") | x.startswith(" ")), lambda x: F.substr(x, F.lit(2)))
    start = F.regexp_extract("diff_hunk", r"^@@ -\d+(?:,\d+)? \+(\d+)", 1).try_cast("int")
    kept = _t(spark, sf, "pull_review_comments").filter("diff_hunk is not null and path is not null and repo is not null")
    return kept.select(F.col("delivery_id").alias("hunk_pos"), "repo", "path", F.array_join(new, "\n").alias("snippet"), start.alias("start_line"), (start + F.greatest(F.size(new) - 1, F.lit(0))).alias("end_line"))


def suggest_topk(spark, sf):
    """For every recipe the review comment whose code it fits best, in its own repository."""
    episodes = _episodes(spark, sf)
    recipes = matching.with_latest_evidence(_recipes(spark, sf), episodes)
    best = matching.best_per_recipe(matching.score_matches(_comment_hunks(spark, sf), recipes, F.lit(AS_OF).cast("timestamp"), ("repo",)))
    return best.select("recipe_id", "hunk_pos", F.round("score", 6).alias("score"), F.round("signal", 6).alias("signal"))


def patches(spark, sf):
    return _recipes(spark, sf).select("recipe_id", matching.unified_patch(F.lit("a/b.ts"), F.lit(7), F.col("before"), F.col("after")).alias("patch"))


def link_join(spark, sf):
    """Episodes with the merge commit of their pull request; the greatest id of a number counts."""
    prs = _t(spark, sf, "pull_requests").groupBy("repo", "pr_number").agg(F.max_by("merge_commit_sha", "id").alias("merge_commit_sha"))
    return _episodes(spark, sf).join(prs, ["repo", "pr_number"], "left").select("id", "pr_number", "merge_commit_sha")


def missing_parent(spark, sf):
    prs = _t(spark, sf, "pull_requests").select("repo", "pr_number")
    return _episodes(spark, sf).join(prs, ["repo", "pr_number"], "left_anti").select("id", "repo")


def first_hit_lookup(spark, sf):
    index = _t(spark, sf, "blob_index").withColumn("pos", F.col("entry_id"))
    return link.first_index_hits(index)


def only_blobs(spark, sf):
    """The blob of each file, taken for a repository, that has just one."""
    blobs = _t(spark, sf, "contents").filter("content is not null and repo is not null and path is not null").select(F.concat("repo", F.lit(":"), "path").alias("repo"), "sha", F.col("content").alias("text"))
    return link.only_blobs(blobs).select("repo", "only_sha")


def _prs(spark, sf):
    return _t(spark, sf, "pull_requests").withColumnRenamed("pr_number", "number")


def _micros(df: DataFrame, *cols: str) -> DataFrame:
    """Instants as microseconds, which every engine writes alike."""
    return df.withColumns({c: F.unix_micros(c) for c in cols})


def watermark(spark, sf):
    return _micros(ingest.watermark(_prs(spark, sf)), "merged_at")


def watermark_merge(spark, sf):
    prs = _prs(spark, sf)
    return _micros(ingest.later(ingest.watermark(prs.filter("number < 110")), ingest.watermark(prs.filter("number >= 110"))), "merged_at")


def incremental_since(spark, sf):
    return _micros(ingest.since_cursor(_prs(spark, sf), datetime(2024, 6, 1)).select("repo", "number", "merged_at", "url"), "merged_at")


def newest_prs(spark, sf):
    """The 50 newest pull requests, oldest first (a top-k report)."""
    newest = _prs(spark, sf).select("repo", "number", "merged_at", "id").distinct().orderBy(F.desc("merged_at"), F.desc("number"), "id").limit(50)
    return _micros(ingest.oldest_first(newest), "merged_at")


def ingest_counters(spark, sf):
    """Messages of one month against all that came before."""
    rows = _t(spark, sf, "review_comments")
    old, new = rows.filter("received_at < '2024-06-01'"), rows.filter("received_at >= '2024-06-01'")
    return ingest.counters(old.select("id"), new.select("id").distinct(), ["id"])


def upsert_created(spark, sf):
    rows = _t(spark, sf, "pull_requests").select("repo", "pr_number", "merged_at", "received_at")
    return ingest.upsert(rows.filter("received_at < '2024-06-01'"), rows.filter("received_at >= '2024-06-01'"), ["repo", "pr_number"])[1].distinct().transform(_micros, "merged_at", "received_at")


def distinct_paths(spark, sf):
    return _t(spark, sf, "pull_review_comments").filter("path is not null").select("pull_request_url", "path").distinct().groupBy("pull_request_url").agg(F.count("*").alias("n_paths"))


def pull_projection(spark, sf):
    """Pull requests as REST rows and back through the ingest projection."""
    p = _t(spark, sf, "pull_requests")
    rest = p.select(F.lit(None).cast("bigint").alias("id"), F.col("id").alias("node_id"), F.col("pr_number").alias("number"), F.date_format("merged_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("merged_at"), "merge_commit_sha", F.col("deleted_at").isNotNull().alias("draft"), F.struct(F.col("base_ref").alias("ref")).alias("base"), F.struct(F.col("head_ref").alias("ref")).alias("head"), "title", F.col("url").alias("html_url"), F.lit("").alias("updated_at"))
    return ingest.pull_rows(rest, datetime(2024, 1, 1)).select("id", "number", "merge_commit_sha", "base_ref", "head_ref", "title", "url")


def comment_projection(spark, sf):
    return ingest.comment_rows(_t(spark, sf, "pull_review_comments"), "gh_user").select("id", "pr_number", "path", "author", F.md5("body").alias("body"), "line")


def blob_texts(spark, sf):
    return ingest.blob_rows(_t(spark, sf, "contents").withColumnRenamed("entry_type", "type")).select("sha", F.length("text").alias("n"))


def repo_catalog(spark, sf):
    return _t(spark, sf, "pull_review_comments").select(F.split("repo", "/")[0].alias("owner"), F.split("repo", "/")[1].alias("name")).filter("owner is not null").distinct()


def freshness(spark, sf):
    """Per repository, with its latest messages, links and merges as the three cursors."""
    ingest_at = _t(spark, sf, "review_comments").groupBy("repo").agg(F.max("received_at").alias("ingest_at"))
    link_at = _episodes(spark, sf).groupBy("repo").agg(F.max("linked_at").alias("link_at"))
    compile_at = _t(spark, sf, "pull_requests").groupBy("repo").agg(F.max("received_at").alias("compile_at"))
    cursors = ingest_at.join(link_at, "repo", "left").join(compile_at, "repo", "left")
    return retrieve.freshness(cursors, _episodes(spark, sf), _recipes(spark, sf)).select("repo", "stale", "reason", "episode_count", "recipe_count")


def edit_hunks(spark, sf):
    """The changed lines between the rejected and the accepted code of each episode."""
    e = _episodes(spark, sf).filter("accepted is not null")
    return e.select("id", F.explode(line_hunks("rejected.text", "accepted.text")).alias("h")).select("id", "h.*")


def _messages(spark, sf):
    """The kept review comments that were not withdrawn, one row per message, named by its node id."""
    rows = with_message_key(_t(spark, sf, "review_comments").filter("deleted_at is null"), "id", id_pairs(_t(spark, sf, "pull_review_comments"))).filter("message_key is not null")
    columns = ["repo", "pr_number", "path", "body", "author", "diff_hunk", "line", "original_line", "side", "commit_id"]
    return rows.groupBy("message_key").agg(F.min(F.struct("delivery_id", *columns)).alias("m")).select(F.col("message_key").alias("id"), *(f"m.{c}" for c in columns))


def _linked(spark, sf):
    prs = _prs(spark, sf).select("repo", "number", "merged_at", "merge_commit_sha", "id")
    index = _t(spark, sf, "blob_index").withColumn("pos", F.col("entry_id"))
    blobs = ingest.blob_rows(_t(spark, sf, "contents").withColumnRenamed("entry_type", "type"))
    repos = _t(spark, sf, "contents").select("repo", "sha").distinct()
    return link.link_comments(_messages(spark, sf), prs, index, repos.join(blobs, "sha").select("repo", "sha", "text"))


def link_episodes(spark, sf):
    e = _linked(spark, sf)[0]
    span = [F.col(f"{c}.{f}").alias(f"{c}_{f}") for c in ("rejected", "accepted") for f in ("start_line", "end_line")]
    return e.select("id", "repo", "comment_id", "pr_number", "file_language", "reviewer", "link_confidence", "link_reason", *span, F.md5("rejected.text").alias("rejected_text"), F.md5("accepted.text").alias("accepted_text"), F.md5("rejected.normalized").alias("rejected_normal"), F.md5("comment_body").alias("body"))


def link_discards(spark, sf):
    return _linked(spark, sf)[1].groupBy("discard_reason").agg(F.count("*").alias("n"))


def _payloads(spark, sf):
    """Events dressed as requests: merges told in two ways, other actions, malformed names, no JSON, nothing, unsigned."""
    e = _t(spark, sf, "events")
    k = F.pmod("event_id", F.lit(8))
    action = F.when(F.col("event_type") == "purchase", "closed").otherwise("opened")
    merged = F.when(k == 2, "false").otherwise("true")
    shop = F.concat(F.lit("shop"), F.pmod("user_id", F.lit(7)).cast("string"))
    repo = F.when(k == 1, F.concat(F.lit('{"name": "'), shop, F.lit('", "owner": {"login": "acme"}}'))).when(k == 3, '{"full_name": "not a slug"}').otherwise(F.concat(F.lit('{"full_name": "acme/'), shop, F.lit('"}')))
    body = F.concat(F.lit('{"action": "'), action, F.lit('", "pull_request": {"merged": '), merged, F.lit(', "number": '), F.col("user_id").cast("string"), F.lit('}, "repository": '), repo, F.lit("}"))
    return e.select("event_id", F.when(k == 4, "nonsense").when(k == 5, None).otherwise(body).alias("body"), (k != 6).alias("signed"))


def merge_events(spark, sf):
    """The status each request gets, and the merge it tells of."""
    s = merges.statuses(_payloads(spark, sf), signed="signed")
    m = merges.merge_events(F.col("body"))
    return s.select("event_id", "status", m["repo"].alias("repo"), m["number"].alias("number"))


def merge_events_stream(spark, sf):
    """What a stream of the requests sets off: two stages per repository, of which one fails for one."""
    source, mark, dead = (scratch_path(spark, x) for x in ("stream-in", "stream-mark", "stream-dead"))
    _payloads(spark, sf).filter("signed and body is not null").select("body").coalesce(1).write.parquet(source)
    ran = []

    def linked(_, repo):
        if repo.endswith("3"):
            raise ValueError("this one fails")
        ran.append((repo, "link"))

    merges.run_merges(spark.readStream.schema("body string").parquet(source), mark, [("ingest", lambda _, repo: ran.append((repo, "ingest"))), ("link", linked)], dead)
    done = spark.createDataFrame([(*r, "done") for r in ran], "repo string, stage string, outcome string")
    return done.unionByName(spark.read.schema("repo string, stage string").parquet(dead).withColumn("outcome", F.lit("failed"))) if ran else done


_NAMES = [
    redact_hunks, secret_flags, actionability, actionability_counts, body_preview, comment_keywords, keyword_topk, normal_forms, name_sets, before_signals,
    path_features, common_folders, suggestion_blocks, stable_ids, confidence, similar_pairs, leader_clusters, cluster_support, cluster_medoids, drop_histogram,
    recipes_from_episodes, recipe_texts, suppress_filter, list_recipes, payload_budget, evidence, suggest_topk, patches, link_join, missing_parent,
    first_hit_lookup, only_blobs, watermark, watermark_merge, incremental_since, newest_prs, ingest_counters, upsert_created, distinct_paths, pull_projection,
    browse, explain, suggestions, editor_suggestions, compile_counts, suppressed_recipes, single_high_recipes, validated_links, comment_files, blob_index_rows, episode_index, recipe_listing,
    comment_projection, blob_texts, repo_catalog, freshness, edit_hunks, link_episodes, link_discards, merge_events, merge_events_stream,
]
QUERIES = {f.__name__: f for f in _NAMES}
