"""Evaluation texts leaking into training text (problem 7).

A positional inverted index over the training texts: (term, document, position), written once per set
of items however many items there are. Terms are 64-bit hash values of words. Of every run of words of
an item the rarest term in the corpus, and the next rarest at another place, are its anchors; the
index stores the postings of anchor terms. Anchors meet their postings by an equi-join on the term,
positions are shifted by the place of the term in the item, and the lists are intersected: both
anchors of a run must fall on the same shift in the same document. A posting carries the terms around
it as payload, so the exact phrase is confirmed where the lists met, without reading the text again.

The two passes over the texts count the terms of the items and build the index; both are Arrow batches
over whole texts. What is sent to their tasks is of fixed size at any data: counts of ``SLOTS`` slots
of hash values, and one byte per slot that marks the terms to store. Terms that share a slot only
cost postings that meet nothing. Postings outside any run of words that all occur in items are
not stored, as no run of an item can stand there.

``phrase_matches`` returns exact phrases, ``proximity_matches`` passages that were edited: runs of
``SEED`` words that stand at nearly the same shift and cover ``RUN`` or more of the item's words, so
that every exact phrase is among them.

Words are maximal runs of letters or digits of any script, letter case ignored.

Defined cases: null or empty texts have no words; items with fewer words than a run match nothing;
repeated documents or items give one row per pair; null ids are left out; empty tables give an
empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from revloom.session import materialize, table

RUN, SEED, SLOP = 12, 6, 8
#: Slots of the tables that are sent to all tasks; a power of two.
SLOTS = 1 << 20
#: Words whose hash values a Python worker remembers.
REMEMBERED = 1 << 20
WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    if not text:
        return []
    return WORD.findall(text.lower()) if text.isascii() else [w.lower() for w in WORD.findall(text)]


def _encoder():
    """Texts to arrays of their words' hash values."""
    import xxhash

    known: dict[str, int] = {}

    def encode(text):
        if len(known) > REMEMBERED:
            known.clear()
        out = []
        for w in words(text):
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w) - (1 << 63)
            out.append(h)
        return np.array(out, dtype=np.int64)

    return encode


def _table(rows: DataFrame, value: str, dtype) -> np.ndarray:
    """An array over all slots from rows (slot, ``value``)."""
    out = np.zeros(SLOTS, dtype=dtype)
    found = rows.toPandas()
    out[found["slot"].to_numpy(dtype=np.int64)] = found[value].to_numpy(dtype=dtype)
    return out


def item_slots(items: DataFrame) -> np.ndarray:
    """Which slots hold a word of an item."""

    def run(batches):
        encode = _encoder()
        for b in batches:
            ids = [encode(t.as_py()) & (SLOTS - 1) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(ids)) if ids else np.zeros(0, np.int64))], names=["slot"])

    return _table(items.select("text").mapInArrow(run, "slot bigint").distinct().withColumn("there", F.lit(True)), "there", bool)


def term_counts(docs: DataFrame, asked: np.ndarray) -> np.ndarray:
    """How often the words of each of the ``asked`` slots occur in all texts."""
    sent = docs.sparkSession.sparkContext.broadcast(asked)

    def run(batches):
        encode, total = _encoder(), np.zeros(SLOTS, dtype=np.int64)
        for b in batches:
            parts = [encode(t.as_py()) & (SLOTS - 1) for t in b.column("text")]
            if parts:
                total += np.bincount(np.concatenate(parts), minlength=SLOTS)
        at = np.flatnonzero(total * sent.value)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "n"])

    return _table(docs.select("text").mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")), "n", np.int64)


def _rarest(weight: np.ndarray, run: int) -> np.ndarray:
    """Of each run of places the first place of the smallest weight, and of the next smallest."""
    windows = np.lib.stride_tricks.sliding_window_view(weight, run)
    return np.argsort(windows, axis=1, kind="stable")[:, :2] + np.arange(len(windows))[:, None]


def anchors(items: DataFrame, counts: np.ndarray, run: int) -> DataFrame:
    """(term, item_id, place, lead, terms): the anchors of all runs of ``items``; ``terms`` are those around a ``lead``, the rarest of a run."""
    sent = items.sparkSession.sparkContext.broadcast(counts)
    schema = pa.schema([("term", pa.int64()), ("item_id", pa.int64()), ("place", pa.int32()), ("lead", pa.bool_()), ("terms", pa.list_(pa.int64()))])

    def gather(batches):
        encode = _encoder()
        for b in batches:
            rows = []
            for i, t in zip(b.column("item_id").to_pylist(), b.column("text")):
                ids = encode(t.as_py())
                if len(ids) < run:
                    continue
                two = _rarest(sent.value[ids & (SLOTS - 1)], run)
                leads = set(two[:, 0].tolist())
                # Padded with what no payload holds there.
                wide = np.concatenate([np.full(run - 1, 1), ids, np.full(run - 1, 1)])
                rows += [(int(ids[p]), i, p, p in leads, wide[p : p + 2 * run - 1] if p in leads else None) for p in sorted(leads | set(two[:, 1].tolist()))]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return items.mapInArrow(gather, "term bigint, item_id bigint, place int, lead boolean, terms array<bigint>").distinct()


def positional_index(docs: DataFrame, asked: np.ndarray, wanted: np.ndarray, run: int) -> DataFrame:
    """(term, doc_id, pos, around): the stored postings of the terms in ``wanted`` slots (1; 2 for those with payload)."""
    sent = docs.sparkSession.sparkContext.broadcast((asked, wanted))
    schema = pa.schema([("term", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int32()), ("around", pa.list_(pa.int64()))])

    def gather(batches):
        asked_, wanted_ = sent.value
        encode = _encoder()
        for b in batches:
            cols = ([], [], [], [])
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text")):
                ids = encode(t.as_py())
                if len(ids) < run:
                    continue
                slots = ids & (SLOTS - 1)
                # Places within some run of words that are all asked for.
                sums = np.concatenate([[0], np.cumsum(asked_[slots])])
                starts = np.concatenate([[0], np.cumsum(sums[run:] - sums[:-run] == run), np.zeros(run - 1, np.int64)])
                starts[len(ids) - run + 2 :] = starts[len(ids) - run + 1]
                places = np.arange(len(ids))
                inside = starts[places + 1] > starts[np.maximum(places - run + 1, 0)]
                at = np.flatnonzero(inside & (wanted_[slots] > 0))
                if not len(at):
                    continue
                # Padded with what no item holds there.
                wide = np.concatenate([np.zeros(run - 1, np.int64), ids, np.zeros(run - 1, np.int64)])
                cols[0].append(ids[at])
                cols[1].append(np.full(len(at), d, np.int64))
                cols[2].append(at.astype(np.int32))
                cols[3].extend(wide[p : p + 2 * run - 1] if wanted_[slots[p]] > 1 else None for p in at)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cols[0])), pa.array(np.concatenate(cols[1])), pa.array(np.concatenate(cols[2])), pa.array(cols[3], schema.field("around").type)], schema=schema)

    return materialize(docs.mapInArrow(gather, "term bigint, doc_id bigint, pos int, around array<bigint>"), "positional-index")


def aligned(docs: DataFrame, items: DataFrame, run: int) -> DataFrame:
    """(doc_id, item_id, shift, place, around, terms): where anchors of runs of items meet their postings."""
    docs = docs.select("doc_id", "text").filter("doc_id is not null and text is not null")
    items = items.select("item_id", "text").filter("item_id is not null and text is not null")
    asked = item_slots(items)
    query = materialize(anchors(items, term_counts(docs, asked), run), "anchors")
    slot = F.col("term").bitwiseAND(F.lit(SLOTS - 1)).alias("slot")
    wanted = _table(query.groupBy(slot).agg(F.max(F.when(F.col("lead"), 2).otherwise(1)).alias("role")), "role", np.uint8)
    return positional_index(docs, asked, wanted, run).join(query, "term").withColumn("shift", F.col("pos") - F.col("place"))


def _agreement(run: int):
    """Text of 1 and 0: at which places a payload and the item agree around the anchor; null where there is no payload."""
    same = F.transform(F.arrays_zip("around", "terms"), lambda z: F.when(z["around"] == z["terms"], "1").otherwise("0"))
    return F.when(F.col("around").isNotNull() & F.col("terms").isNotNull(), F.array_join(same, ""))


def phrase_matches(docs: DataFrame, items: DataFrame, run: int = RUN) -> DataFrame:
    """(doc_id, item_id): documents with at least ``run`` consecutive words of an item. ``docs``: doc_id, text; ``items``: item_id, text."""
    exact = F.coalesce(_agreement(run).contains("1" * run), F.lit(False))
    return (
        aligned(docs, items, run)
        .groupBy("doc_id", "item_id", "shift")
        .agg(F.count_distinct("place").alias("lists"), F.max(exact).alias("exact"))
        .filter("lists > 1 and exact")
        .select("doc_id", "item_id")
        .distinct()
    )


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int = SLOP, least: int = RUN, seed: int = SEED) -> DataFrame:
    """(doc_id, item_id, near_words): documents in which runs of ``seed`` words of an item, with shifts less than ``slop`` apart, cover ``least`` or more of its words.

    Passages that were edited shift their words a little. Shifts are put into overlapping bands of
    twice ``slop``, so that any two shifts less than ``slop`` apart share a band; ``near_words`` is the
    most that a band covers.
    """
    agree = _agreement(seed)
    before = F.length(F.regexp_extract(F.reverse(F.substring(agree, 1, seed - 1)), "^1*", 0))
    after = F.length(F.regexp_extract(F.substring(agree, seed + 1, seed - 1), "^1*", 0))
    stretches = aligned(docs, items, seed).filter("terms is not null and around is not null").select("doc_id", "item_id", "shift", "place", before.alias("before"), after.alias("after")).filter(F.col("before") + F.col("after") + 1 >= seed)
    band = F.floor(F.col("shift") / F.lit(slop))
    return (
        stretches.withColumn("band", F.explode(F.array(band, band - 1)))
        .withColumn("word", F.explode(F.sequence(F.col("place") - F.col("before"), F.col("place") + F.col("after"))))
        .groupBy("doc_id", "item_id", "band")
        .agg(F.count_distinct("word").alias("near_words"))
        .groupBy("doc_id", "item_id")
        .agg(F.max("near_words").alias("near_words"))
        .filter(F.col("near_words") >= least)
    )


def p7_found(spark, sf_dir: str) -> DataFrame:
    return phrase_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_near(spark, sf_dir: str) -> DataFrame:
    return proximity_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
