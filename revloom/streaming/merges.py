"""Merge events as a stream: each event runs ingest, link and compile of its repository in turn."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

EVENT = "action string, pull_request struct<merged: boolean, number: int>, repository struct<full_name: string, name: string, owner: struct<login: string>>"
SLUG = r"^[A-Za-z0-9._-]+/[A-Za-z0-9._-]+$"


def signature_holds(body: bytes, header: str | None, secret: str | None) -> bool:
    """Whether a request is signed with the secret; without a secret everything passes."""
    if not secret:
        return True
    want = "sha256=" + hmac.new(secret.encode(), body, hashlib.sha256).hexdigest()
    return hmac.compare_digest(want.encode(), (header or "").strip().encode())


def merge_events(payload: Column) -> Column:
    """The (repo, number) of a closed and merged pull request in a JSON text; null for all else."""
    e = F.from_json(payload, EVENT)
    repo = F.coalesce(F.when(F.trim(e["repository"]["full_name"]) != "", F.trim(e["repository"]["full_name"])), F.concat(e["repository"]["owner"]["login"], F.lit("/"), e["repository"]["name"]))
    ok = (e["action"] == "closed") & e["pull_request"]["merged"] & (e["pull_request"]["number"] >= 1) & repo.rlike(SLUG)
    return F.when(ok, F.struct(repo.alias("repo"), e["pull_request"]["number"].alias("number")))


def statuses(events: DataFrame, payload: str = "body", signed: str | None = None) -> DataFrame:
    """``events`` with the status their request gets: 202 for merges, 200 for what is ignored, 400 for no JSON object, 401 unsigned."""
    parsed = F.from_json(F.col(payload), EVENT)
    bad = F.col(payload).isNull() | ~F.col(payload).rlike(r"(?s)^\s*\{.*\}\s*$") | parsed.isNull()
    status = F.when(bad, 400).when(merge_events(F.col(payload)).isNotNull(), 202).otherwise(200)
    if signed:
        status = F.when(~F.col(signed), 401).otherwise(status)
    return events.withColumn("status", status)


def run_merges(
    events: DataFrame,
    checkpoint: str,
    stages: list[tuple[str, Callable[[SparkSession, str], None]]],
    dead_letters: str,
    payload: str = "body",
) -> None:
    """Work through all events that are there, in batches one after the other.

    Each repository of a batch runs ``stages`` once, in order; a stage that fails ends its
    repository's run, goes to ``dead_letters`` and does not stop the others. The checkpoint
    remembers which events were done.
    """

    def work(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        merges = batch.select(merge_events(F.col(payload)).alias("m")).filter("m is not null").groupBy("m.repo").agg(F.count("*").alias("n"))
        failed = []
        for row in merges.orderBy("repo").toLocalIterator():
            for name, stage in stages:
                try:
                    stage(spark, row.repo)
                except Exception as e:  # noqa: BLE001
                    failed.append((batch_id, row.repo, name, str(e)[:500]))
                    break
        if failed:
            spark.createDataFrame(failed, "batch bigint, repo string, stage string, error string").write.mode("append").parquet(dead_letters)

    events.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def event_counts(events: DataFrame) -> DataFrame:
    """Accepted events per type and key, the form a stream and a batch share."""
    return events.withColumn("k", F.get_json_object("props", "$.k").cast("bigint")).groupBy("event_type", (F.col("k") % 10).alias("k10")).agg(F.count("*").alias("n"))
