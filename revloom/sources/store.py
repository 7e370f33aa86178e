"""Tables of one repository: JSON folders at the borders, Parquet in between.

Every path is scoped to one repository and reached through Hadoop's file systems. A table is a folder
of numbered versions, of which the last complete one counts: a write that breaks off changes nothing.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from revloom.config import RepoConfig, config_of, repo_slug, scoped_path
from revloom.errors import InvalidInput, NoData
from revloom.sources import files

PR_JSON = "id string, number int, mergedAt timestamp, mergeCommitSha string, baseRef string, headRef string, title string, url string"
COMMENT_JSON = "id string, prNumber int, path string, body string, author string, createdAt timestamp, diffHunk string, line int, originalLine int, side string, commitId string, htmlUrl string"


def _snake(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c).alias("".join("_" + x.lower() if x.isupper() else x for x in c)) for c in df.columns if not c.startswith("_")))


def _has_files(spark: SparkSession, path: str, ending: str) -> bool:
    return any(x.endswith(ending) for x in files.names(spark, path, False))


def read_json_folder(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object per file; a missing folder is empty, unknown keys are dropped, an unreadable file fails the read (``violations`` tells which)."""
    if not _has_files(spark, path, ".json"):
        return _snake(spark.createDataFrame([], schema))
    return _snake(spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").option("pathGlobFilter", "*.json").json(path))


def violations(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    """(file, problem) of the files of a folder that cannot be read or lack a required field."""
    if not _has_files(spark, path, ".json"):
        return spark.createDataFrame([], "file string, problem string")
    read = spark.read.schema(schema + ", _bad string").option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(path).withColumn("file", F.col("_metadata.file_name"))
    lacks = F.array_join(F.filter(F.array(*(F.when(F.col(c).isNull(), F.lit(f"{c} is missing")) for c in required)), lambda x: x.isNotNull()), "; ")
    problem = F.when(F.col("_bad").isNotNull(), "not readable").otherwise(lacks)
    return read.select("file", problem.alias("problem")).filter("problem <> ''")


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """(sha, text) of the ``<sha>.txt`` files of a folder."""
    if not _has_files(spark, path, ".txt"):
        return spark.createDataFrame([], "sha string, text string")
    return spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.+)\.txt$", 1).alias("sha"), F.col("value").alias("text"))


def blob_shas(spark: SparkSession, path: str) -> DataFrame:
    """(sha) of the ``<sha>.txt`` files of a folder, without reading them."""
    if not _has_files(spark, path, ".txt"):
        return spark.createDataFrame([], "sha string")
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("path")
    return listed.select(F.regexp_extract("path", r"([^/]+)\.txt$", 1).alias("sha"))


def read_blob_index(spark: SparkSession, file: str) -> DataFrame:
    """(commit_ref, path, sha, pos) of an index file, leniently: blank and odd entries are skipped, an unreadable file is empty."""
    if not files.exists(spark, file):
        return spark.createDataFrame([], "commit_ref string, path string, sha string, pos bigint")
    entries = spark.read.text(file, wholetext=True).select(F.posexplode(F.from_json("value", "files array<string>")["files"]).alias("pos", "entry"))
    read = entries.select("pos", F.from_json("entry", "ref string, path string, sha string").alias("e"))
    clean = [F.trim(F.col(f"e.{c}")).alias(n) for c, n in (("ref", "commit_ref"), ("path", "path"), ("sha", "sha"))]
    return read.select(*clean, F.col("pos").cast("bigint").alias("pos")).filter("commit_ref <> '' and path <> '' and sha <> ''")


class Store:
    """The tables of one repository below a data folder."""

    def __init__(self, spark: SparkSession, root: str, slug: str):
        self.spark, self.root, self.slug = spark, root, slug
        self.owner, self.name = repo_slug(slug)

    def path(self, *segments: str) -> str:
        return scoped_path(self.root, self.slug, *segments)

    def _versions(self, name: str) -> list[int]:
        return sorted(int(x) for x in files.names(self.spark, self.path(name), True) if x.isdigit())

    def _current(self, name: str) -> str | None:
        done = [self.path(name, str(v)) for v in self._versions(name) if files.exists(self.spark, self.path(name, str(v), "_SUCCESS"))]
        return done[-1] if done else None

    def exists(self, name: str) -> bool:
        return self._current(name) is not None

    def write(self, name: str, df: DataFrame) -> None:
        """A new version of a table; the one before stays for those who are reading it, older ones go."""
        before, versions = self._current(name), self._versions(name)
        df.write.parquet(self.path(name, str(versions[-1] + 1 if versions else 0)))
        for v in versions:
            if self.path(name, str(v)) != before:
                files.delete(self.spark, self.path(name, str(v)))

    def read(self, name: str, schema: str | None = None) -> DataFrame:
        """A table; where it is absent an empty one of ``schema``, or an error without."""
        current = self._current(name)
        if current is not None:
            return self.spark.read.parquet(current)
        if schema is None:
            raise NoData(f"{self.slug} has no {name}")
        return self.spark.createDataFrame([], schema)

    def raw(self) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """(pull requests, comments, blobs, index) from the JSON and text files of ``raw``."""
        repo = F.lit(self.slug).alias("repo")
        prs = read_json_folder(self.spark, self.path("raw", "prs"), PR_JSON).select(repo, "*")
        comments = read_json_folder(self.spark, self.path("raw", "comments"), COMMENT_JSON).select(repo, "*")
        blobs = read_blobs(self.spark, self.path("raw", "blobs")).select(repo, "*")
        index = read_blob_index(self.spark, self.path("raw", "blob-index.json")).select(repo, "*")
        return prs, comments, blobs, index

    def _object(self, file: str) -> dict:
        try:
            found = json.loads(files.read_text(self.spark, file))
        except ValueError as e:
            raise InvalidInput(f"{file} is not JSON") from e
        if not isinstance(found, dict):
            raise InvalidInput(f"{file} is not an object")
        return found

    def config(self) -> RepoConfig:
        """The settings in ``config.json``; the defaults where there is none."""
        file = self.path("config.json")
        return config_of(self.owner, self.name, self._object(file) if files.exists(self.spark, file) else {})

    def _cursor_files(self) -> list[str]:
        found = [x for x in files.names(self.spark, self.path("cursors"), False) if x.removesuffix(".json").isdigit()]
        return sorted(found, key=lambda x: int(x.removesuffix(".json")))

    def cursors(self) -> dict:
        found = self._cursor_files()
        return self._object(self.path("cursors", found[-1])) if found else {}

    def set_cursors(self, **values) -> None:
        found = self._cursor_files()
        merged = self.cursors() | {k: v for k, v in values.items() if v is not None}
        number = int(found[-1].removesuffix(".json")) + 1 if found else 0
        files.write_text(self.spark, self.path("cursors", f"{number}.json"), json.dumps(merged, indent=2, sort_keys=True))
        for x in found[:-1]:
            files.delete(self.spark, self.path("cursors", x))

    def suppressions(self) -> DataFrame:
        return self.read("suppressions", "recipe_id string")

    def purge(self) -> bool:
        """Remove all that is stored of the repository; says whether there was anything."""
        return files.delete(self.spark, self.path())


def catalog(spark: SparkSession, root: str) -> list[str]:
    """The repositories stored below a data folder, sorted; hidden folders and odd names are no repositories."""
    found = []
    base = f"{root.rstrip('/')}/repos"
    for owner in files.names(spark, base, True):
        for name in files.names(spark, f"{base}/{owner}", True) if not owner.startswith(".") else []:
            if not name.startswith("."):
                try:
                    repo_slug(f"{owner}/{name}")
                except InvalidInput:
                    continue
                found.append(f"{owner}/{name}")
    return sorted(found)


def index_rows(episodes: DataFrame) -> DataFrame:
    """The narrow form of episodes."""
    return episodes.select("pos", "id", "pr_number", "comment_id", "path", "link_confidence", "link_reason", "actionable")


def recipe_index(recipes: DataFrame) -> DataFrame:
    return recipes.select("recipe_id", "title", "support", "path_prefixes", "languages", "avg_link_confidence", "suppressed", "recipe_order")


def by_ids(df: DataFrame, ids: list[str], key: str = "id") -> DataFrame:
    """The rows with the ids of a list; those not there are skipped."""
    return df.join(df.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(ids)], f"{key} string"), key, "left_semi")
