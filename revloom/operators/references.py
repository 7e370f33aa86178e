"""References to records that do not exist (problem 5).

Both sides of a reference are turned into a change log of one signed count per key: a target row
adds +1 when it arrives and -1 when it is withdrawn, a reference adds to the reference count of its
instant. Counts are summed per (key, day) first, with map-side combine, then the existence count is
carried over the days of each key. A day on which a key's existence count does not change settles
all its references at once: they are orphans if the count carried in is zero. Days with a change are
split into hours in the same way, and only the hours with a change are looked at instant by instant.

So a key that holds a third of all rows is one row per day in the carried sum, and its references
are spread over (key, day) and (key, hour). No group is collected.

``ReferenceCounts`` maintains the signed counts themselves: batches of changes of either side, also
references that go, are added to a stored table of one row per key, whose keys with positive references
and no existence are the current report.

Defined cases: null or blank references are none; a target withdrawn at or before its arrival never
exists; a target that arrives at the very instant of the reference exists, one withdrawn at that
instant does not; a null arrival means the target never arrived; a reference without an instant
sees no target; repeated referring rows give one result row; empty tables give none or leave every
reference broken.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from revloom.functions.message_ids import id_pairs, trimmed, with_message_key
from revloom.session import materialize, scratch_path, table
from revloom.sources import files

#: References without an instant are placed before everything.
BEFORE_ALL = -(2**62)
#: Spans of time that are settled at once, one within the other.
UNITS_US = (86_400_000_000, 3_600_000_000)


def target_deltas(targets: DataFrame, arrived: str, deleted: str | None) -> DataFrame:
    """(ref_field, key, at, delta) from target rows with ref_field and key."""
    a = F.unix_micros(arrived)
    d = F.unix_micros(deleted) if deleted else F.lit(None).cast("bigint")
    base = targets.select("ref_field", "key", a.alias("a"), d.alias("d")).filter("a is not null and key is not null and (d is null or d > a)")
    return base.select("ref_field", "key", F.col("a").alias("at"), F.lit(1).alias("delta")).unionByName(
        base.filter("d is not null").select("ref_field", "key", F.col("d").alias("at"), F.lit(-1).alias("delta"))
    )


def broken_references(refs: DataFrame, deltas: DataFrame) -> DataFrame:
    """The rows of ``refs`` (src_table, src_key, ref_field, key, at) whose key has existence count zero at ``at``."""
    shown = ["src_table", "src_key", "ref_field", "key", "at"]
    open_ = refs.select(*shown).withColumn("at", F.coalesce("at", F.lit(BEFORE_ALL))).withColumns({"slot": F.lit(0).cast("bigint"), "before": F.lit(0).cast("bigint")})
    changes = deltas.groupBy("ref_field", "key", "at").agg(F.sum("delta").alias("delta")).withColumn("slot", F.lit(0).cast("bigint"))
    by, found = ["ref_field", "key", "within", "slot"], []
    for unit in UNITS_US:
        slot = {"within": F.col("slot"), "slot": F.floor(F.col("at") / F.lit(unit)).cast("bigint")}
        open_, changes = open_.withColumns(slot), changes.withColumns(slot)
        counts = (
            changes.select(*by, "delta", F.lit(1).alias("changes"), F.lit(0).alias("refs"))
            .unionByName(open_.select(*by, F.lit(0).cast("bigint").alias("delta"), F.lit(0).alias("changes"), F.lit(1).alias("refs")))
            .groupBy(*by)
            .agg(F.sum("delta").alias("delta"), F.sum("changes").alias("changes"), F.sum("refs").alias("refs"))
        )
        over_slots = W.partitionBy("ref_field", "key", "within").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
        carried = counts.withColumn("gain", F.coalesce(F.sum("delta").over(over_slots), F.lit(0))).filter("refs > 0")
        if unit == UNITS_US[0]:  # nothing is carried into the first level, so what exists settles here
            carried = carried.filter("gain = 0 or changes > 0")
        told = open_.join(carried.select(*by, "gain", "changes"), by).withColumn("before", F.col("before") + F.col("gain"))
        told = materialize(told.filter("changes > 0 or before = 0").drop("gain", "within"), "references")
        found.append(told.filter("changes = 0").select(*shown))
        open_ = told.filter("changes > 0").drop("changes")
        changes = changes.join(open_.select("ref_field", "key", "slot").distinct(), ["ref_field", "key", "slot"], "left_semi").drop("within")
    # Within a changing slot: the count at the instant is what was carried in plus the slot's changes up to it.
    by = ["ref_field", "key", "slot"]
    in_slot = W.partitionBy(*by).orderBy("at").rangeBetween(W.unboundedPreceding, W.currentRow)
    at_moment = (
        changes.select(*by, "at", "delta", F.lit(False).alias("asked"))
        .unionByName(open_.select(*by, "at", F.lit(0).cast("bigint").alias("delta"), F.lit(True).alias("asked")).distinct())
        .withColumn("so_far", F.sum("delta").over(in_slot))
        .filter("asked")
        .select(*by, "at", "so_far")
    )
    found.append(open_.join(at_moment, [*by, "at"]).filter("before + so_far = 0").select(*shown))
    return reduce(DataFrame.unionByName, found)


class ReferenceCounts:
    """Signed reference and existence counts per key, in a folder that all executors share; each batch makes a new version."""

    COUNTS = "ref_field string, key string, refs bigint, existing bigint"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> list[int]:
        found = [int(x) for x in files.names(self.spark, self.path, True) if x.isdigit()]
        return sorted(x for x in found if files.exists(self.spark, f"{self.path}/{x}/_SUCCESS"))

    def counts(self) -> DataFrame:
        done = self._versions()
        return self.spark.read.schema(self.COUNTS).parquet(f"{self.path}/{done[-1]}") if done else self.spark.createDataFrame([], self.COUNTS)

    def add(self, references: DataFrame | None = None, targets: DataFrame | None = None) -> None:
        """Add changes (ref_field, key, delta): +1 for each row that came, -1 for each that went. Null keys are none."""
        done = self._versions()
        parts = [self.counts()]
        for changes, column, other in ((references, "refs", "existing"), (targets, "existing", "refs")):
            if changes is not None:
                parts.append(changes.filter("key is not null").select("ref_field", "key", F.col("delta").cast("bigint").alias(column), F.lit(0).cast("bigint").alias(other)))
        summed = reduce(DataFrame.unionByName, parts).groupBy("ref_field", "key").agg(F.sum("refs").alias("refs"), F.sum("existing").alias("existing"))
        new = done[-1] + 1 if done else 0
        summed.filter("refs <> 0 or existing <> 0").write.mode("overwrite").parquet(f"{self.path}/{new}")
        for v in done[:-1]:
            files.delete(self.spark, f"{self.path}/{v}")

    def orphans(self) -> DataFrame:
        """(ref_field, key, refs): the keys that are referred to now and do not exist."""
        return self.counts().filter("refs > 0 and existing <= 0").select("ref_field", "key", "refs")


def _references(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    episodes, index = table(spark, sf_dir, "episodes"), table(spark, sf_dir, "blob_index")
    pairs = id_pairs(table(spark, sf_dir, "pull_review_comments"))
    comment_targets = with_message_key(table(spark, sf_dir, "review_comments").select("id", "received_at", "deleted_at"), "id", pairs, "key").withColumn("ref_field", F.lit("comment_id"))
    pr_key = F.concat_ws("\x00", F.col("repo"), F.col("pr_number").cast("string"))
    pr_targets = table(spark, sf_dir, "pull_requests").filter("repo is not null and pr_number is not null").select(pr_key.alias("key"), F.lit("pr_number").alias("ref_field"), "received_at", "deleted_at")
    sha_targets = table(spark, sf_dir, "contents").select(F.lower(trimmed(F.col("sha"))).alias("key"), F.lit("sha").alias("ref_field"), "fetched_at", "deleted_at")
    deltas = reduce(
        DataFrame.unionByName,
        [target_deltas(comment_targets, "received_at", "deleted_at"), target_deltas(pr_targets, "received_at", "deleted_at"), target_deltas(sha_targets, "fetched_at", "deleted_at")],
    )
    slim = episodes.select("id", "repo", "pr_number", "comment_id", F.unix_micros("linked_at").alias("at"))
    comment_refs = with_message_key(slim, "comment_id", pairs, "key").filter("key is not null").select(F.lit("episodes").alias("src_table"), F.col("id").alias("src_key"), F.lit("comment_id").alias("ref_field"), "key", "at")
    pr_refs = slim.filter("pr_number is not null").select(F.lit("episodes").alias("src_table"), F.col("id").alias("src_key"), F.lit("pr_number").alias("ref_field"), pr_key.alias("key"), "at")
    sha_refs = index.select(F.lit("blob_index").alias("src_table"), F.col("entry_id").cast("string").alias("src_key"), F.lit("sha").alias("ref_field"), F.lower(trimmed(F.col("sha"))).alias("key"), F.unix_micros("indexed_at").alias("at")).filter("key is not null")
    return reduce(DataFrame.unionByName, [comment_refs, pr_refs, sha_refs]), deltas


def orphans_now(spark, sf_dir: str) -> DataFrame:
    """p5_current: per field and key without any target row, how many rows refer to it, from counts maintained in three batches."""
    refs, deltas = _references(spark, sf_dir)
    refs, deltas = materialize(refs.select("ref_field", "key", F.lit(1).alias("delta")), "refs"), materialize(deltas.select("ref_field", "key", "delta"), "deltas")
    state = ReferenceCounts(spark, scratch_path(spark, "reference-counts"))
    state.add(references=refs)
    state.add(targets=deltas.filter("delta > 0"))
    state.add(targets=deltas.filter("delta < 0"))
    return state.orphans()


def _current(spark, sf_dir: str) -> DataFrame:
    refs, deltas = _references(spark, sf_dir)
    return broken_references(materialize(refs, "refs"), materialize(deltas, "deltas"))


def orphan_references(spark, sf_dir: str) -> DataFrame:
    """p5_found: every reference without a valid target at the time of the referring row."""
    return _current(spark, sf_dir).select("src_table", "src_key", "ref_field").distinct()


def orphans_by_month(spark, sf_dir: str) -> DataFrame:
    """p5_by_month: broken references per table, field and month of the referring row."""
    rows = _current(spark, sf_dir).select("src_table", "src_key", "ref_field", "at").distinct()
    month = F.when(F.col("at") > BEFORE_ALL, F.date_format(F.timestamp_micros("at"), "yyyy-MM"))
    return rows.groupBy("src_table", "ref_field", month.alias("month")).agg(F.count("*").alias("n_broken"))
