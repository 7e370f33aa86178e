"""Exactly one copy of each message (problem 4).

Messages arrive at least once. The operator keeps a *bucketed storage*: per time bucket and
message the best copy seen there, in slices by the hash of the identifier. A Bloom filter per slice and
time bucket, built from the stored identifiers, screens them: an identifier that no other bucket's
filter holds is new for certain and its bucket's best copy stays. Only the identifiers some other
filter may hold are compared exactly, with nothing but the stored rows of the buckets they may be in.

Copies are combined before they are shuffled, once, by slice; a slice's filters are built and probed
where its rows lie, and only possible repeats move again. So one message with a third of all rows is
a row per batch and time bucket. ``MessageStorage`` keeps storage and filters as tables, to which batch
after batch is added; ``winners`` does the same for one table at once.

Defined cases: rows with a null identifier are no message and are never surplus; a null arrival
time has a bucket of its own; ties on the order go to the smallest row key; rows repeated in full
(same row key) count once; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from revloom.functions.message_ids import id_pairs, with_message_key
from revloom.session import materialize, table
from revloom.sources import files

#: Bits per identifier and bits set per identifier of each filter (false positives about 1 %).
BITS_PER_ID, BITS_SET = 12, 4
BUCKET = "month"
#: Messages of a slice; in a storage, its number of slices and the bits of each filter.
SLICE_ROWS, SLICES, FILTER_BITS = 500_000, 64, 1 << 20

_STORED = "message_key string, bucket string, rank bigint, row_key bigint, n bigint"


def _combined(batches):
    """Per Arrow batch one row per message and bucket: its best copy and how many there were."""
    for b in batches:
        f = b.to_pandas().sort_values(["message_key", "bucket", "rank", "row_key"])
        n = f.groupby(["message_key", "bucket"], sort=False)["n"].transform("sum")
        first = f.assign(n=n).drop_duplicates(["message_key", "bucket"])
        yield pa.RecordBatch.from_pandas(first, preserve_index=False, schema=b.schema)


def _slim(rows: DataFrame) -> DataFrame:
    """Messages with the rank turned so that the smallest is best."""
    return rows.filter("message_key is not null").select("message_key", "bucket", (-F.coalesce("rank_at", F.lit(-(2**62)))).alias("rank"), "row_key", F.lit(1).cast("bigint").alias("n"))


def _best(rows: DataFrame, *by: str) -> DataFrame:
    best = rows.groupBy(*by).agg(F.min(F.struct("rank", "row_key")).alias("best"), F.sum("n").alias("n"))
    return best.select(*by, "best.rank", "best.row_key", "n")


def bucket_storage(rows: DataFrame, slices: int) -> DataFrame:
    """(message_key, bucket, rank, row_key, n): per message and time bucket the best copy and the number of copies, all of a message in one slice."""
    return _best(_slim(rows).mapInArrow(_combined, _STORED).repartition(slices, "message_key"), "message_key", "bucket")


def filter_places(h: np.ndarray, n_bits: int) -> np.ndarray:
    """The bits that each hash value sets."""
    u = h.astype(np.uint64)
    low, high = u & np.uint64(0xFFFFFFFF), (u >> np.uint64(32)) | np.uint64(1)
    return ((low[:, None] + high[:, None] * np.arange(BITS_SET, dtype=np.uint64)) % np.uint64(n_bits)).astype(np.int64)


def bloom(h: np.ndarray, n_bits: int) -> np.ndarray:
    bits = np.zeros(n_bits, dtype=bool)
    bits[filter_places(h, n_bits).ravel()] = True
    return bits


def may_hold(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    return bits[filter_places(h, len(bits))].all(axis=1)


def _screened(batches):
    """The rows of a slice with ``maybe``: whether another time bucket's filter may hold the identifier."""
    parts = list(batches)
    if not parts:
        return
    t = pa.Table.from_batches(parts)
    h, (codes, names) = t.column("h").to_numpy(), _codes(t.column("bucket"))
    maybe = np.zeros(len(h), dtype=bool)
    for k in range(len(names)):
        mine = codes == k
        bits = bloom(h[mine], max(64, int(mine.sum()) * BITS_PER_ID))
        others = np.flatnonzero(~mine & ~maybe)
        maybe[others] = may_hold(bits, h[others])
    yield from t.drop_columns(["h"]).append_column("maybe", pa.array(maybe)).to_batches()


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, list[str]]:
    d = column.combine_chunks().dictionary_encode()
    d = d.combine_chunks() if isinstance(d, pa.ChunkedArray) else d
    return d.indices.to_numpy(zero_copy_only=False), d.dictionary.to_pylist()


def winners(rows: DataFrame) -> DataFrame:
    """(message_key, keep_key, copies) of every message with more than one copy.

    ``rows`` has message_key (string), rank_at (bigint; the largest wins, null least), row_key
    (bigint; the smallest wins a tie) and bucket (string).
    """
    slices = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // SLICE_ROWS))
    stored = bucket_storage(rows, slices).withColumn("h", F.xxhash64("message_key"))
    screened = materialize(stored.mapInArrow(_screened, _STORED + ", maybe boolean"), "screened")
    new = screened.filter(~F.col("maybe") & (F.col("n") > 1)).select("message_key", "row_key", "n")
    again = _best(screened.filter("maybe"), "message_key").filter("n > 1").select("message_key", "row_key", "n")
    return new.unionByName(again).select("message_key", F.col("row_key").alias("keep_key"), F.col("n").alias("copies"))


class MessageStorage:
    """Storage and filters of all messages so far, in a folder that all executors share; each batch is a version of its own."""

    def __init__(self, spark: SparkSession, path: str, slices: int = SLICES, filter_bits: int = FILTER_BITS):
        self.spark, self.path, self.slices, self.filter_bits = spark, path.rstrip("/"), slices, filter_bits

    def _batches(self) -> list[int]:
        done = [int(x) for x in files.names(self.spark, f"{self.path}/filters", True) if x.isdigit()]
        return sorted(x for x in done if files.exists(self.spark, f"{self.path}/filters/{x}/_SUCCESS"))

    def stored(self) -> DataFrame:
        """All stored rows, in folders by time bucket; those of a batch that broke off are not read."""
        paths = [f"{self.path}/rows/{x}" for x in self._batches()]
        if not paths:
            return self.spark.createDataFrame([], _STORED)
        parts = [self.spark.read.schema(_STORED).parquet(p) for p in paths]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def filters(self) -> DataFrame:
        """(slice, bucket, bits): the filters, one per slice and time bucket."""
        last = self._batches()[-1:]
        return self.spark.read.parquet(f"{self.path}/filters/{last[0]}") if last else self.spark.createDataFrame([], "slice int, bucket string, bits binary")

    def add(self, rows: DataFrame) -> DataFrame:
        """(message_key, keep_key, copies, kept_before) of the batch's messages that have more than one copy by now; ``kept_before`` is the copy kept so far, if any."""
        n_bits = self.filter_bits
        before, number = self._batches(), (self._batches() or [-1])[-1] + 1
        sliced = F.pmod(F.xxhash64("message_key"), F.lit(self.slices)).cast("int")
        batch = materialize(bucket_storage(rows, self.slices).withColumn("slice", sliced).withColumn("h", F.xxhash64("message_key", F.lit(1))), "batch")

        def probe(mine: pa.Table, theirs: pa.Table) -> pa.Table:
            """The batch's identifiers with the time buckets that may hold them, of one slice."""
            h, keys, out = mine.column("h").to_numpy(), mine.column("message_key").to_pylist(), ([], [])
            for bucket, bits in zip(theirs.column("bucket").to_pylist(), theirs.column("bits").to_pylist()):
                held = may_hold(np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool), h)
                for i in np.flatnonzero(held):
                    out[0].append(keys[i])
                    out[1].append(bucket)
            return pa.table({"message_key": pa.array(out[0], pa.string()), "bucket": pa.array(out[1], pa.string())})

        def merge(mine: pa.Table, theirs: pa.Table) -> pa.Table:
            """The slice's filters with the batch's identifiers."""
            known = {b: np.unpackbits(np.frombuffer(x, np.uint8)).astype(bool) for b, x in zip(theirs.column("bucket").to_pylist(), theirs.column("bits").to_pylist())}
            slice_ = (mine if mine.num_rows else theirs).column("slice")[0].as_py()
            if mine.num_rows:
                h, (codes, names) = mine.column("h").to_numpy(), _codes(mine.column("bucket"))
                for k, b in enumerate(names):
                    known[b] = known.get(b, np.zeros(n_bits, dtype=bool)) | bloom(h[codes == k], n_bits)
            return pa.table({"slice": pa.array([slice_] * len(known), pa.int32()), "bucket": pa.array(list(known), pa.string()), "bits": pa.array([np.packbits(x).tobytes() for x in known.values()], pa.binary())})

        filters = self.filters()
        sides = batch.groupBy("slice").cogroup(filters.groupBy("slice"))
        maybe = materialize(sides.applyInArrow(probe, "message_key string, bucket string").distinct(), "maybe")
        # Only the time buckets that some filter names are read, and of these only the identifiers in question.
        named = [r.bucket for r in maybe.select("bucket").distinct().toLocalIterator()]
        old = _best(self.stored().filter(F.col("bucket").isin(named)).join(maybe, ["message_key", "bucket"], "left_semi"), "message_key") if before and named else self.spark.createDataFrame([], _STORED).drop("bucket")
        old = materialize(old, "stored-before")
        now = _best(batch.select("message_key", "rank", "row_key", "n").unionByName(old.select("message_key", "rank", "row_key", "n")), "message_key")
        touched = now.join(batch.select("message_key").distinct(), "message_key", "left_semi").filter("n > 1")
        out = materialize(touched.join(old.select("message_key", F.col("row_key").alias("kept_before")), "message_key", "left").select("message_key", F.col("row_key").alias("keep_key"), F.col("n").alias("copies"), "kept_before"), "winners")
        for part in ("rows", "filters"):
            files.delete(self.spark, f"{self.path}/{part}/{number}")
        batch.select("message_key", "bucket", "rank", "row_key", "n").write.partitionBy("bucket").parquet(f"{self.path}/rows/{number}")
        # The filters are written last: with them the batch counts.
        sides.applyInArrow(merge, "slice int, bucket string, bits binary").write.parquet(f"{self.path}/filters/{number}")
        return out


def surplus(rows: DataFrame) -> DataFrame:
    """(row_key) of every row that is not the one kept copy of its message."""
    rows = rows.select("message_key", "rank_at", "row_key", "bucket")
    return rows.join(winners(rows), "message_key").filter(F.col("row_key") != F.col("keep_key")).select("row_key").distinct()


def _bucket(c: Column) -> Column:
    return F.coalesce(F.date_format(F.date_trunc(BUCKET, c), "yyyy-MM"), F.lit("none"))


def raw_message_rows(raw: DataFrame) -> DataFrame:
    """The raw messages in the shape ``winners`` reads; the latest instant of ``updated_at`` wins."""
    return raw.select(
        F.col("id").cast("string").alias("message_key"),
        F.unix_micros(F.expr("try_cast(trim(updated_at) as timestamp)")).alias("rank_at"),
        F.col("delivery_id").alias("row_key"),
        _bucket(F.col("received_at")).alias("bucket"),
    )


def kept_message_rows(kept: DataFrame, raw: DataFrame) -> DataFrame:
    """The kept subset in the shape ``winners`` reads; the smallest row key wins."""
    slim = kept.select("id", F.col("delivery_id").alias("row_key"), _bucket(F.col("received_at")).alias("bucket"))
    return with_message_key(slim, "id", id_pairs(raw)).select("message_key", F.lit(None).cast("bigint").alias("rank_at"), "row_key", "bucket")


def surplus_messages(spark, sf_dir: str) -> DataFrame:
    """p4_found: the surplus rows of both message tables."""
    raw, kept = table(spark, sf_dir, "pull_review_comments"), table(spark, sf_dir, "review_comments")
    parts = [("pull_review_comments", raw_message_rows(raw)), ("review_comments", kept_message_rows(kept, raw))]
    found = [surplus(r).select(F.lit(name).alias("src_table"), F.col("row_key").alias("delivery_id")) for name, r in parts]
    return found[0].unionByName(found[1])


def copies_by_month(spark, sf_dir: str) -> DataFrame:
    """p4_copies: per table and month of arrival, the rows, the messages kept and the surplus rows."""
    raw, kept = table(spark, sf_dir, "pull_review_comments"), table(spark, sf_dir, "review_comments")
    all_rows = raw.select(F.lit("pull_review_comments").alias("src_table"), "delivery_id", _bucket(F.col("received_at")).alias("month")).unionByName(
        kept.select(F.lit("review_comments").alias("src_table"), "delivery_id", _bucket(F.col("received_at")).alias("month"))
    )
    extra = surplus_messages(spark, sf_dir).withColumn("extra", F.lit(1))
    return (
        all_rows.join(extra, ["src_table", "delivery_id"], "left")
        .groupBy("src_table", "month")
        .agg(F.count("*").alias("n_rows"), F.sum(F.when(F.col("extra").isNull(), 1).otherwise(0)).alias("n_kept"), F.sum(F.coalesce("extra", F.lit(0))).cast("bigint").alias("n_surplus"))
    )
