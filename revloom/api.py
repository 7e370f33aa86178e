"""The functions a user calls, over a stored repository."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from revloom import config as C
from revloom.errors import InvalidInput, NoData
from revloom.operators.ordering import with_positions
from revloom.operators.validation import validate_medium
from revloom.plans import compile as compiling, ingest as ingesting, link as linking, retrieve
from revloom.sources.rest import ForgePages, fetch_files
from revloom.sources.store import Store, by_ids, catalog, index_rows, recipe_index
from revloom.streaming.merges import run_merges

CURSOR_COLUMNS = "repo string, ingest_at timestamp, link_at timestamp, compile_at timestamp"


class Engine:
    """All stages and queries for the repositories below one data folder.

    ``now`` is asked for the time of each run, so that runs can be repeated.
    """

    def __init__(self, spark: SparkSession, root: str, allowed: str | None = None, now=lambda: datetime.now(timezone.utc).replace(tzinfo=None)):
        self.spark, self.root, self.allowed, self.now = spark, root, C.allow_list(allowed), now

    def store(self, slug: str) -> Store:
        C.check_allowed(slug, self.allowed)
        return Store(self.spark, self.root, slug)

    def repos(self) -> list[str]:
        return [s for s in catalog(self.spark, self.root) if not self.allowed or s in self.allowed]

    def ingest(self, slug: str, max_prs: int | None = None, on_ingested: Callable[[int], None] | None = None, **options: str) -> dict:
        """Read merged pull requests after the cursor, their comments and the files these are on.

        All is fetched before anything is stored, and the cursor moves only after all is written, pull
        request by pull request, oldest first; ``on_ingested`` hears of each. Where no limit is given
        the repository's settings have one, and where there is no cursor, a first day.
        """
        store = self.store(slug)
        self.spark.dataSource.register(ForgePages)
        settings = store.config()
        max_prs = max_prs or settings.max_prs
        cursor = store.cursors().get("ingest_at") or settings.since
        reader = self.spark.read.format("forge_pages").options(repo=slug, max_prs=str(max_prs), **options)
        source = (reader.option("since", cursor) if cursor else reader).option("kind", "pulls").load()
        pulls = ingesting.pull_rows(source).withColumn("repo", F.lit(slug))
        store.write("incoming_prs", pulls)
        pulls = store.read("incoming_prs")
        # One read partition per pull request; at most ``max_prs`` numbers.
        numbers = sorted(r.number for r in pulls.select("number").toLocalIterator())
        comments = self.spark.read.format("forge_pages").options(repo=slug, kind="comments", numbers=",".join(map(str, numbers)), **options).load()
        store.write("incoming_comments", ingesting.comment_rows(comments).withColumn("repo", F.lit(slug)))
        rows = store.read("incoming_comments")
        store.write("incoming_files", fetch_files(ingesting.files_of(pulls, rows), {"repo": slug, **options}))
        files = store.read("incoming_files")
        blobs = ingesting.blob_rows(files).withColumn("sha", F.lower(F.trim("sha"))).withColumn("repo", F.lit(slug))
        index = ingesting.index_entries(files).withColumn("repo", F.lit(slug))
        counts = {}
        for name, new, key in (("prs", pulls, ["number"]), ("comments", rows, ["id"]), ("blobs", blobs, ["sha"]), ("blob_index", index, ["commit_ref", "path"])):
            stored = store.read(name) if store.exists(name) else new.limit(0)
            counts[name], counts[f"{name}_new"] = ingesting.counters(stored, new, key).first()
            store.write(name, ingesting.upsert(stored, new, key)[0])
        # At most ``max_prs`` rows.
        for r in ingesting.oldest_first(pulls.select("merged_at", "number")).toLocalIterator():
            store.set_cursors(ingest_at=r.merged_at.strftime("%Y-%m-%dT%H:%M:%SZ"), ingest_number=r.number)
            if on_ingested:
                on_ingested(r.number)
        return {k: v or 0 for k, v in counts.items()}

    def link(self, slug: str, scorer=None, extra_bots: list[str] | None = None) -> dict:
        """Link all stored comments; tables written by ``ingest`` are used before raw files.

        ``scorer`` judges links of medium confidence, as ``operators.validation`` says.
        """
        store = self.store(slug)
        prs, comments, blobs, index = store.raw()
        if store.exists("prs"):
            prs, comments = store.read("prs"), store.read("comments")
        # Fetched files come before the raw ones of the same sha or place.
        if store.exists("blobs"):
            kept = store.read("blobs").select("repo", "sha", "text")
            blobs = kept.unionByName(blobs.join(kept.select("sha"), F.lower(F.trim(blobs.sha)) == kept.sha, "left_anti"))
        if store.exists("blob_index"):
            index = store.read("blob_index").select("repo", "commit_ref", "path", "sha", "pos").unionByName(index.withColumn("pos", F.col("pos") + 1))
        if comments.isEmpty():
            raise NoData(f"{slug} has no comments")
        episodes, discards = linking.link_comments(comments, prs, index, blobs, extra_bots)
        if scorer is not None:
            episodes = validate_medium(episodes, scorer)
        store.write("episodes", with_positions(episodes.withColumn("__c", F.expr("comment_id collate UNICODE")), ["pr_number", "__c", "comment_id"]).drop("__c"))
        store.write("discards", discards)
        store.write("episode_index", index_rows(store.read("episodes")))
        store.set_cursors(link_at=self.now().isoformat())
        strong = store.read("episodes").agg(F.count("*").alias("episodes"), F.coalesce(F.sum(F.col("link_confidence").isin("high", "medium").cast("bigint")), F.lit(0)).alias("medium_or_higher")).first()
        return strong.asDict() | {"discards": store.read("discards").count()}

    def compile(self, slug: str, min_support: int | None = None, allow_single_high: bool | None = None) -> dict:
        store = self.store(slug)
        settings = C.resolve(store.config())
        at = self.now()
        episodes = store.read("episodes")
        least = min_support or settings.min_support
        members = compiling.cluster_members(episodes)
        recipes = compiling.recipes_of(members, least, settings.allow_single_high_confidence if allow_single_high is None else allow_single_high, at, store.suppressions())
        store.write("recipes", recipes)
        store.write("recipe_index", recipe_index(store.read("recipes")))
        store.write("compile_meta", compiling.compile_meta(episodes, members, least))
        run = store.read("recipes").agg(F.count("*").alias("recipes"), F.max("compile_run_id").alias("run")).first()
        store.set_cursors(compile_at=at.isoformat(), compile_run_id=run.run)
        return {"recipes": run.recipes, **store.read("compile_meta").first().asDict()}

    def recipes(self, slug: str, include_suppressed: bool = False) -> DataFrame:
        store = self.store(slug)
        return retrieve.visible(store.read("recipes"), store.suppressions(), include_suppressed)

    def list_recipes(self, slug: str, **query) -> DataFrame:
        return retrieve.list_recipes(self.recipes(slug), **query)

    def suggest(self, slug: str, diff: str | None = None, code: str | None = None, path: str | None = None, limit: int | None = None) -> DataFrame:
        if diff is None and not (code is not None and path):
            raise InvalidInput("a diff, or code with its path, is needed")
        hunks = retrieve.hunks_of(self.spark, diff, [(path, code)] if code is not None else None, path)
        return retrieve.suggest(hunks, self.recipes(slug), self.store(slug).read("episodes"), self.now(), retrieve.clamp(limit))

    def explain(self, slug: str, recipe_id: str) -> DataFrame:
        return retrieve.explain(self.recipes(slug, True), self.store(slug).read("episodes"), recipe_id)

    def suppress(self, slug: str, recipe_id: str, on: bool = True) -> DataFrame:
        """Suppress a recipe or bring it back; one that is not compiled can still be brought back."""
        store = self.store(slug)
        if on:
            retrieve.preview(store.read("recipes"), recipe_id, "")
        store.write("suppressions", retrieve.set_suppressed(store.suppressions(), recipe_id, on))
        return store.suppressions()

    def apply_preview(self, slug: str, recipe_id: str, path: str, start_line: int | None = None) -> DataFrame:
        return retrieve.preview(self.recipes(slug), recipe_id, path, start_line)

    def freshness(self, slug: str) -> DataFrame:
        store, c = self.store(slug), self.store(slug).cursors()
        at = lambda k: datetime.fromisoformat(c[k].replace("Z", "")) if c.get(k) else None
        cursors = self.spark.createDataFrame([(slug, at("ingest_at"), at("link_at"), at("compile_at"))], CURSOR_COLUMNS)
        return retrieve.freshness(cursors, store.read("episodes", "repo string"), store.read("recipes", "repo string"))

    def suggestion_warnings(self, slug: str, suggestions: DataFrame | None = None) -> list[str]:
        return retrieve.warnings(self.freshness(slug), suggestions)

    def preview_suggestion(self, slug: str, recipe_id: str, **query) -> DataFrame:
        """One of the suggestions for a piece of code, as it would be applied."""
        return retrieve.preview_of(self.suggest(slug, **query, limit=retrieve.MAX_LIMIT), recipe_id)

    def episodes(self, slug: str, ids: list[str]) -> DataFrame:
        return by_ids(self.store(slug).read("episodes"), ids)

    def run_merge_events(self, events: DataFrame, checkpoint: str, dead_letters: str, **options: str) -> None:
        """Ingest, link and compile the repositories of a stream of merge events; those not on the allow list go to the dead letters."""
        stages = [("ingest", lambda _, slug: self.ingest(slug, **options)), ("link", lambda _, slug: self.link(slug)), ("compile", lambda _, slug: self.compile(slug))]
        run_merges(events, checkpoint, stages, dead_letters)

    def purge(self, slug: str) -> bool:
        return self.store(slug).purge()
