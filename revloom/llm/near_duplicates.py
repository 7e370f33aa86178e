"""Near-duplicate records with small edits (problem 3).

A record is the set of its tokens. One 64-bit hash function names the tokens, and one global order
over hash values ranks them: first by how crowded the value's slot is in a count table of fixed
size, then by the value. A record's *sketch* is the bottom-k of its values in that order, where k
follows from its size n and the threshold t = p/q so that nothing is lost: two sets with likeness
of at least t overlap in a = ceil(t/(1+t) (n1+n2)) values, hence their sketches of
n - ceil(t n) + L values (n - ceil(2t/(1+t) n) + L for the smaller set) have min(L, a) values in
common. Inverted lists of the retained values, built once over all records, generate those overlaps
with one equi-join; sizes that rule the threshold out never leave the join.

Per pair the union of both sketches then bounds the overlap: the common retained values plus the
smaller of the two remainders behind the last of them. Pairs whose bound or whose count of common
retained values is too low are dropped, and what is left is verified exactly on the full sets.

Records with exactly the same text are one class with one representative from the start, so a
group of copies costs one sketch however large it is. Classes of different texts are never merged.
Counting by slot keeps the table that is sent to all tasks at ``SLOTS`` integers at any data size;
the order only decides how short the lists are, never which pairs are found.

Defined cases: null texts are empty; records without any token have no likeness and pair with
nothing; rows repeated in full are one record; an id with several texts pairs through each of them,
never with itself; null ids are left out; empty tables give empty results.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from revloom.operators.components import connected
from revloom.session import materialize, table

#: Slots of the count table (4 bytes each); the bound of what is broadcast.
SLOTS = 1 << 18
#: Retained values that a pair must share (L above).
SHARED = 2


def token_classes(records: DataFrame) -> DataFrame:
    """(cls, toks, n): one row per distinct text of ``records`` (id, text); toks are hash values."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z0-9_]+"), lambda x: x != ""))
    return (
        records.select(F.md5("text").alias("cls"), F.transform(words, lambda w: F.xxhash64(w)).alias("toks"))
        .dropDuplicates(["cls"])
        .select("cls", F.array_distinct("toks").alias("toks"))
        .withColumn("n", F.size("toks"))
    )


def slot_counts(docs: DataFrame, slots: int) -> np.ndarray:
    """How many sets have a value in each slot; ``slots`` integers, whatever the data."""
    rows = docs.select(F.explode("toks").alias("t")).groupBy(F.pmod("t", F.lit(slots)).alias("s")).count().toPandas()
    out = np.zeros(slots, dtype=np.int64)
    out[rows["s"].to_numpy(dtype=np.int64)] = rows["count"].to_numpy(dtype=np.int64)
    return out


def sketch_postings(docs: DataFrame, counts: np.ndarray, t: Fraction, shared: int) -> DataFrame:
    """(tok, doc, n, behind, small): the inverted lists of the sketches.

    ``behind`` is the number of the record's values after this one; ``small`` marks the values that
    also count when the record is the smaller of a pair. Values whose slot holds one set are in no
    other set and are left out.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(counts.astype(np.int32 if counts.max(initial=0) < 2**31 else np.int64))
    p, q = t.numerator, t.denominator

    def run(batches):
        table_ = sent.value
        for b in batches:
            lists = b.column("toks")
            n = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(n)), n)
            crowd = table_[np.mod(flat, len(table_))]
            order = np.lexsort((flat, crowd, doc))
            pos = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
            flat, crowd = flat[order], crowd[order]
            size = n[doc]
            large = size + (-p * size) // q + shared
            small = size + (-2 * p * size) // (p + q) + shared
            use = (pos < large) & (crowd > 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat[use]), pa.array(b.column("doc").to_numpy(zero_copy_only=False)[doc[use]]), pa.array(size[use].astype(np.int32)), pa.array((size - pos - 1)[use].astype(np.int32)), pa.array((pos < small)[use])],
                names=["tok", "doc", "n", "behind", "small"],
            )

    return docs.select("doc", "toks").mapInArrow(run, "tok bigint, doc bigint, n int, behind int, small boolean")


def similar_classes(docs: DataFrame, threshold: str | Fraction = "0.7", shared: int = SHARED, slots: int = SLOTS) -> DataFrame:
    """(a, b, inter, either): all pairs of rows of ``docs`` (doc, toks, n; materialized) with likeness of at least ``threshold``."""
    t = Fraction(threshold)
    p, q = t.numerator, t.denominator
    posts = sketch_postings(docs, slot_counts(docs, slots), t, shared)
    larger = posts.select("tok", F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("behind").alias("behind_b"))
    smaller = posts.filter("small").select("tok", F.col("doc").alias("a"), F.col("n").alias("na"), F.col("behind").alias("behind_a"))
    need = F.expr(f"ceil({p} * (na + nb) / {p + q}D - 1e-9)")
    pairs = (
        smaller.join(larger, "tok")
        .filter(f"(na < nb or (na = nb and a < b)) and na * {q} >= nb * {p}")
        .groupBy("a", "b", "na", "nb")
        .agg(F.count("*").alias("common"), F.min("behind_a").alias("rest_a"), F.min("behind_b").alias("rest_b"))
        .filter((F.col("common") >= F.least(F.lit(shared), need)) & (F.col("common") + F.least("rest_a", "rest_b") >= need))
        .select("a", "b")
    )
    sides = docs.select("doc", "toks", "n")
    return (
        pairs.join(sides.select(F.col("doc").alias("a"), F.col("toks").alias("ta"), F.col("n").alias("na")), "a")
        .join(sides.select(F.col("doc").alias("b"), F.col("toks").alias("tb"), F.col("n").alias("nb")), "b")
        .withColumn("inter", F.size(F.array_intersect("ta", "tb")))
        .withColumn("either", F.col("na") + F.col("nb") - F.col("inter"))
        .filter(f"inter * {q} >= either * {p}")
        .select("a", "b", "inter", "either")
    )


def episode_records(episodes: DataFrame) -> DataFrame:
    """(id, text) of episodes: the normalised rejected and accepted code and the comment."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("rejected.normalized", "accepted.normalized", "comment_body")]
    return episodes.filter("id is not null").select("id", F.concat_ws("\n", *parts).alias("text"))


def _classes_and_members(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    docs = materialize(token_classes(records).filter("n > 0").withColumn("doc", F.monotonically_increasing_id()), "near-classes")
    members = records.select("id", F.md5("text").alias("cls")).distinct().join(docs.select("cls", "doc"), "cls").select("id", "doc")
    return docs, members


def similar_records(records: DataFrame, threshold: str = "0.7") -> DataFrame:
    """(id_a, id_b), id_a < id_b: every pair of different ids with likeness of at least ``threshold``."""
    docs, members = _classes_and_members(records)
    members = materialize(members, "near-members")
    links = similar_classes(docs.select("doc", "toks", "n"), threshold)
    a, b = members.select(F.col("doc").alias("a"), F.col("id").alias("x")), members.select(F.col("doc").alias("b"), F.col("id").alias("y"))
    across = links.join(a, "a").join(b, "b").filter("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    copies = a.join(b, F.col("a") == F.col("b")).filter("x < y").select(F.col("x").alias("id_a"), F.col("y").alias("id_b"))
    return across.unionByName(copies).distinct()


def similar_groups(records: DataFrame, threshold: str = "0.7") -> DataFrame:
    """(id, group_id, n_copies, n_links): one row per id that is like some other.

    The group is named by its smallest id; ``n_copies`` counts the other ids with exactly the same
    text, ``n_links`` the different texts linked to this one.
    """
    docs, members = _classes_and_members(records)
    members = materialize(members, "near-members")
    links = materialize(similar_classes(docs.select("doc", "toks", "n"), threshold).select("a", "b"), "near-links")
    roots = connected(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("doc")).groupBy("doc").agg(F.count("*").alias("n_links"))
    sizes = members.groupBy("doc").agg(F.count("*").alias("size"))
    placed = (
        members.join(sizes, "doc")
        .join(degree, "doc", "left")
        .join(roots.select(F.col("node").alias("doc"), "root"), "doc", "left")
        .filter("size > 1 or root is not null")
        .select("id", F.coalesce("root", "doc").alias("root"), (F.col("size") - 1).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
    names = placed.groupBy("root").agg(F.min("id").alias("group_id"))
    return placed.join(names, "root").groupBy("id").agg(F.min("group_id").alias("group_id"), F.max("n_copies").alias("n_copies"), F.max("n_links").alias("n_links"))


def p3_found(spark, sf_dir: str) -> DataFrame:
    return similar_records(episode_records(table(spark, sf_dir, "episodes")))


def p3_groups(spark, sf_dir: str) -> DataFrame:
    return similar_groups(episode_records(table(spark, sf_dir, "episodes")))
