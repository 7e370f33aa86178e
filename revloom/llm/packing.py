"""Filling fixed-capacity containers with items (problem 6).

All decisions are made on the histogram of lengths, which has at most ``capacity`` entries however
many items there are:

1. Items longer than a container are cut into full containers and one remainder; no other item is
   split.
2. Lengths are rounded up to ``UNITS`` units of capacity. All patterns of at most ``DEPTH`` rounded
   lengths that fill a container exactly are enumerated, and non-negative least squares fits how
   often each is repeated so that together they use up the histogram. The counts are rounded.
3. Pattern by pattern the units are turned back into exact lengths: the longest of each unit, and in
   the last slot the longest that still fits, so that every group of alike containers is as full as
   the lengths allow.
4. What the patterns left over is packed best fit, longest first, in bulk: all items of one length
   go at once into the groups with the smallest sufficient rest, or into new groups.
5. The share of the fitted repeats that is used is the largest that gives the fewest containers; best
   fit alone is among the choices, so the fit never costs a container.

The result is a list of groups (how many containers, which lengths in which order), of a size that
depends on the capacity and not on the data. An item then finds its place by arithmetic: its rank
among the items of its length falls into one slot segment. Ranks are counted within hashed shards
with the shards' offsets added, so a length that a third of all items share is spread over many tasks.

Defined cases: an item of length zero takes a place in the first container and no room; a null
length is counted from the text; null text and null length give length zero; null ids are left out;
repeated ids are one item (of the greatest length); null or non-positive capacities hold nothing
and give no rows; empty tables give an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from revloom.session import materialize, table

UNITS, DEPTH = 192, 3
#: Shares of the fitted repeats that are tried, in this order.
SHARES = (1.0, 0.9, 0.75, 0.5, 0.25, 0.0)
#: Items per rank shard, shards whose counts are added up in one task, and bits of a rank.
SHARD_ROWS, SHARDS_A_TIER, RANK_BITS = 200_000, 1024, 40
#: GPT-2's public pre-split pattern, in Java spelling (fixed value).
TOKEN_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, dtype=bool)
    grad = a.T @ b
    limit = 1e-9 * max(1.0, np.abs(grad).max(initial=0.0))
    for _ in range(rounds or 3 * a.shape[0]):
        open_ = np.where(passive, -np.inf, grad)
        j = int(open_.argmax())
        if open_[j] <= limit:
            break
        passive[j] = True
        while True:
            cols = np.flatnonzero(passive)
            s = np.linalg.lstsq(a[:, cols], b, rcond=None)[0]
            if s.min() > 0:
                break
            bad = s <= 0
            step = np.min(x[cols][bad] / np.maximum(x[cols][bad] - s[bad], 1e-300))
            x[cols] += step * (s - x[cols])
            passive[cols[x[cols] <= 1e-12]] = False
            x[~passive] = 0.0
        x[:] = 0.0
        x[cols] = s
        grad = a.T @ (b - a[:, cols] @ s)
    return x


def unit_patterns(units: int, depth: int) -> np.ndarray:
    """(patterns, depth): all non-increasing tuples of 1..depth units that add up to ``units``; 0 fills up."""
    found = [(units,) + (0,) * (depth - 1)]
    if depth > 1:
        found += [(a, units - a) + (0,) * (depth - 2) for a in range((units + 1) // 2, units)]
    if depth > 2:
        found += [(a, b, units - a - b) + (0,) * (depth - 3) for a in range(1, units) for b in range(1, a + 1) if 1 <= units - a - b <= b]
    return np.array(found, dtype=np.int64)


def fitted_patterns(histogram: dict[int, int], capacity: int, units: int = UNITS, depth: int = DEPTH) -> list[tuple[int, list[int]]]:
    """(how often, units in falling order): the patterns whose repeats use up the histogram, most frequent first."""
    units = min(units, capacity)
    stock = np.zeros(units + 1)
    for l, c in histogram.items():
        stock[-(-l * units // capacity)] += max(c, 0)
    patterns = unit_patterns(units, depth)
    patterns = patterns[np.all((patterns == 0) | (stock[patterns] > 0), axis=1)]
    if not len(patterns):
        return []
    a = np.zeros((units + 1, len(patterns)))
    for d in range(patterns.shape[1]):
        np.add.at(a, (patterns[:, d], np.arange(len(patterns))), 1.0)
    times = np.floor(nnls(a[1:], stock[1:]) + 0.5)
    return [(int(times[p]), [int(u) for u in patterns[p] if u]) for p in np.argsort(-times, kind="stable") if times[p] > 0]


def fill_patterns(left: dict[int, int], patterns: list[tuple[int, list[int]]], capacity: int, units: int) -> list[tuple[int, list[int]]]:
    """Groups made of the patterns; takes their items out of ``left``.

    Every slot but the last takes the longest length left of its unit, the last one the longest length
    that still fits, so that rounding wastes no room.
    """
    groups: list[tuple[int, list[int]]] = []
    of_unit: dict[int, list[int]] = {}
    alive = sorted(l for l, c in left.items() if c > 0)
    for l in reversed(alive):
        of_unit.setdefault(-(-l * units // capacity), []).append(l)

    def longest(ls, picked):
        return next((l for l in ls if left.get(l, 0) > picked.count(l)), None)

    for want, slots in patterns:
        while want:
            pick: list[int] = []
            for u in slots[:-1]:
                l = longest(of_unit.get(u, ()), pick)
                if l is None:
                    break
                pick.append(l)
            if len(pick) < len(slots) - 1:
                break
            i = bisect_right(alive, capacity - sum(pick))
            # A last item much shorter than its unit would spend what other patterns need.
            last = longest((alive[j] for j in range(i - 1, -1, -1) if alive[j] * units > (slots[-1] - 2) * capacity), pick)
            if last is None:
                break
            pick.append(last)
            k = min([want, *(left[l] // pick.count(l) for l in pick)])
            for l in pick:
                left[l] -= k
            for l in set(pick):
                if not left[l]:
                    alive.remove(l)
                    of_unit[-(-l * units // capacity)].remove(l)
            groups.append((k, pick))
            want -= k
    return groups


def best_fit(left: dict[int, int], groups: list[tuple[int, list[int]]], capacity: int) -> list[tuple[int, list[int]]]:
    """``groups`` and new ones with all of ``left``: longest first, each length at once into the smallest sufficient rests."""
    rests: list[int] = []
    by_rest: dict[int, list[tuple[int, list[int]]]] = {}

    def keep(k: int, lengths: list[int], rest: int) -> None:
        if rest not in by_rest:
            by_rest[rest] = []
            insort(rests, rest)
        by_rest[rest].append((k, lengths))

    for k, lengths in groups:
        keep(k, lengths, capacity - sum(lengths))
    for l in sorted((x for x, c in left.items() if c > 0), reverse=True):
        n = left[l]
        while n:
            i = bisect_left(rests, l)
            if i == len(rests):
                per = capacity // l
                if n >= per:
                    k = n // per
                    keep(k, [l] * per, capacity - per * l)
                    n -= k * per
                else:
                    keep(1, [l] * n, capacity - n * l)
                    n = 0
                continue
            rest = rests[i]
            k, lengths = by_rest[rest].pop()
            per = rest // l
            if n >= k * per:
                n -= k * per
                keep(k, lengths + [l] * per, rest - per * l)
            elif n >= per:
                full = n // per
                n -= full * per
                keep(full, lengths + [l] * per, rest - per * l)
                keep(k - full, lengths, rest)
            else:
                keep(1, lengths + [l] * n, rest - n * l)
                if k > 1:
                    keep(k - 1, lengths, rest)
                n = 0
            if not by_rest[rest]:
                del by_rest[rest]
                rests.remove(rest)
    return [g for rest in sorted(by_rest) for g in by_rest[rest]]


def pack_histogram(histogram: dict[int, int], capacity: int, units: int = UNITS, depth: int = DEPTH) -> list[tuple[int, list[int]]]:
    """Groups of alike containers, (how many, lengths in order), that hold every item of the histogram once.

    ``histogram`` maps lengths from 1 to ``capacity`` to their counts. The patterns are used as often
    as the fit says, or for each of ``SHARES`` of that; the packing with the fewest containers counts, and
    of equals the one with the most patterns. The share of zero is best fit alone, so the fit
    never costs a container.
    """
    histogram = {l: c for l, c in histogram.items() if c > 0}
    patterns = fitted_patterns(histogram, capacity, units, depth)
    least = -(-sum(l * c for l, c in histogram.items()) // capacity)
    best = None
    for share in SHARES if patterns else (0.0,):
        left = dict(histogram)
        groups = fill_patterns(left, [(int(k * share), p) for k, p in patterns], capacity, min(units, capacity))
        groups = best_fit(left, groups, capacity)
        n = sum(k for k, _ in groups)
        if best is None or n < best[0]:
            best = n, groups
        if n <= least:
            break
    return best[1]


def slot_segments(groups: list[tuple[int, list[int]]], first: int) -> pa.Table:
    """(len, rank_from, rank_to, window_from, place, at): which ranks of a length go to which containers."""
    taken: dict[int, int] = {}
    cols: tuple[list, ...] = ([], [], [], [], [], [])
    window = first
    for k, lengths in groups:
        at = 0
        for place, l in enumerate(lengths):
            r = taken.get(l, 0)
            taken[l] = r + k
            for c, v in zip(cols, (l, r, r + k - 1, window, place + 1, at)):
                c.append(v)
            at += l
        window += k
    return pa.table([pa.array(c, pa.int64()) for c in cols], names=["len", "rank_from", "rank_to", "window_from", "place", "at"])


def document_lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, n): the tokens of each document."""
    n = F.coalesce("n_tokens", F.when(F.col("n_tokens").isNull(), F.regexp_count("text", F.lit(TOKEN_PATTERN))), F.lit(0))
    return docs.filter("doc_id is not null").select("doc_id", F.greatest(n.cast("bigint"), F.lit(0)).alias("n")).groupBy("doc_id").agg(F.max("n").alias("n"))


def _placed(ranked: DataFrame, groups: list[tuple[int, list[int]]], capacity: int) -> DataFrame:
    """(window_no, place, doc_id, piece, start_token, n_tokens, at_token) of items with ``len``, ``rank`` and ``full``.

    A rank's segment is looked up in the sorted segments, of which there are as many as the groups of
    alike containers have slots, whatever the number of items.
    """
    segments = slot_segments(groups, 1).sort_by([("len", "ascending"), ("rank_from", "ascending")])
    arrays = {n: segments[n].to_numpy() for n in segments.column_names}
    sent = ranked.sparkSession.sparkContext.broadcast(arrays)
    names = ["window_no", "place", "doc_id", "piece", "start_token", "n_tokens", "at_token"]

    def look_up(batches):
        seg = sent.value
        keys = (seg["len"] << RANK_BITS) + seg["rank_from"]
        for b in batches:
            length, rank, full, doc = (b.column(c).to_numpy(zero_copy_only=False) for c in ("len", "rank", "full", "doc_id"))
            i = np.searchsorted(keys, (length << RANK_BITS) + rank, side="right") - 1
            cols = [seg["window_from"][i] + rank - seg["rank_from"][i], seg["place"][i], doc, full + 1, full * capacity, length, seg["at"][i]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)

    return ranked.select("doc_id", "len", "rank", "full").mapInArrow(look_up, ", ".join(f"{n} bigint" for n in names))


def _before(sums: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, shard, before): per shard the sum of ``value`` over the shards before it, in two levels, so that no task sees all shards."""
    upto = lambda *cols: W.partitionBy(*cols[:-1]).orderBy(cols[-1]).rowsBetween(W.unboundedPreceding, -1)
    tier = sums.withColumn("tier", F.floor(F.col("shard") / SHARDS_A_TIER))
    tiers = tier.groupBy(*by, "tier").agg(F.sum(value).alias("t")).withColumn("below", F.coalesce(F.sum("t").over(upto(*by, "tier")), F.lit(0))).drop("t")
    return tier.withColumn("within", F.coalesce(F.sum(value).over(upto(*by, "tier", "shard")), F.lit(0))).join(tiers, [*by, "tier"]).select(*by, "shard", (F.col("below") + F.col("within")).alias("before"))


def pack(items: DataFrame, name: str, capacity: int) -> DataFrame:
    """(window_name, window_no, place, doc_id, piece, start_token, n_tokens, at_token) for ``items`` (doc_id, n; materialized)."""
    whole = F.when(F.col("n") > capacity, F.floor(F.col("n") / F.lit(capacity))).otherwise(0)
    cut = items.withColumn("full", whole.cast("bigint")).withColumn("len", F.col("n") - F.col("full") * capacity)
    packed = cut.filter("len > 0")
    histogram = {r["len"]: r["count"] for r in packed.groupBy("len").count().toLocalIterator()}
    groups = pack_histogram(histogram, capacity)
    n_packed = sum(k for k, _ in groups)
    shards = max(1, sum(histogram.values()) // SHARD_ROWS)
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(shards))
    sharded = packed.withColumn("shard", shard)
    ranked = (
        sharded.withColumn("in_shard", F.row_number().over(W.partitionBy("len", "shard").orderBy("doc_id")) - 1)
        .join(_before(sharded.groupBy("len", "shard").agg(F.count("*").alias("c")), ["len"], "c"), ["len", "shard"])
        .withColumn("rank", F.col("before") + F.col("in_shard"))
    )
    cols = ["window_no", "place", "doc_id", "piece", "start_token", "n_tokens", "at_token"]
    parts = [_placed(ranked, groups, capacity)] if groups else []
    # Full containers are numbered behind the others, in the order of the items' shards and ids.
    fulls = cut.filter("full > 0").withColumn("shard", shard)
    parts.append(
        fulls.withColumn("so_far", F.coalesce(F.sum("full").over(W.partitionBy("shard").orderBy("doc_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .join(_before(fulls.groupBy("shard").agg(F.sum("full").alias("f")), [], "f"), "shard")
        .withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1)))
        .select((F.lit(n_packed + 1) + F.col("before") + F.col("so_far") + F.col("k")).alias("window_no"), F.lit(1).cast("bigint").alias("place"), "doc_id", (F.col("k") + 1).alias("piece"), (F.col("k") * capacity).alias("start_token"), F.lit(capacity).cast("bigint").alias("n_tokens"), F.lit(0).cast("bigint").alias("at_token"))
    )
    parts.append(cut.filter("n = 0").select(F.lit(1).cast("bigint").alias("window_no"), F.lit(0).cast("bigint").alias("place"), "doc_id", F.lit(1).cast("bigint").alias("piece"), *(F.lit(0).cast("bigint").alias(c) for c in cols[4:])))
    return reduce(DataFrame.unionByName, [p.select(*cols) for p in parts]).select(F.lit(name).alias("window_name"), *cols)


def pack_all(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """``pack`` for every row of ``windows`` (window_name, capacity_tokens); a fixed handful."""
    items = materialize(document_lengths(docs), "lengths")
    parts = [pack(items, r.window_name, r.capacity_tokens) for r in windows.select("window_name", "capacity_tokens").distinct().orderBy("window_name", "capacity_tokens").toLocalIterator() if r.capacity_tokens and r.capacity_tokens > 0]
    if not parts:
        return items.sparkSession.createDataFrame([], "window_name string, window_no bigint, place bigint, doc_id bigint, piece bigint, start_token bigint, n_tokens bigint, at_token bigint")
    return reduce(DataFrame.unionByName, parts)


def p6_packed(spark, sf_dir: str) -> DataFrame:
    return pack_all(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_windows"))


def p6_usage(spark, sf_dir: str) -> DataFrame:
    """Containers, room used and the least number of containers possible, per kind of container."""
    windows = table(spark, sf_dir, "pack_windows").groupBy("window_name").agg(F.max("capacity_tokens").alias("capacity_tokens"))
    used = p6_packed(spark, sf_dir).groupBy("window_name").agg(F.max("window_no").alias("n_windows"), F.sum("n_tokens").alias("n_tokens"), F.count_distinct("doc_id").alias("n_docs"))
    share = F.col("n_tokens") / (F.col("n_windows") * F.col("capacity_tokens"))
    return used.join(windows, "window_name").select("window_name", "n_docs", "n_windows", "n_tokens", F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).alias("least_windows"), F.round(share, 6).alias("share_used"))


def p6_checks(spark, sf_dir: str) -> DataFrame:
    """Per kind of container: documents and tokens placed, documents not placed whole and once, and containers over their room."""
    docs, windows = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_windows").select("window_name", "capacity_tokens").distinct()
    placed = materialize(p6_packed(spark, sf_dir), "packed")
    whole = document_lengths(docs).join(docs.filter("n_tokens is not null").select("doc_id").distinct().withColumn("given", F.lit(True)), "doc_id", "left")
    per_doc = placed.groupBy("window_name", "doc_id").agg(F.sum("n_tokens").alias("got"), F.count("*").alias("pieces")).join(whole, "doc_id").join(windows, "window_name")
    wrong = (F.col("got") != F.col("n")) | (F.col("pieces") != F.greatest(F.lit(1), F.ceil(F.col("n") / F.col("capacity_tokens"))))
    told = per_doc.groupBy("window_name").agg(F.count("*").alias("n_docs"), F.sum(F.when(F.col("given"), F.col("got")).otherwise(0)).alias("n_tokens"), F.sum(wrong.cast("bigint")).alias("n_wrong_docs"))
    # In order of their places, pieces must follow each other without a gap.
    by_place = W.partitionBy("window_name", "window_no").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    rooms = placed.filter("n_tokens > 0").withColumn("so_far", F.coalesce(F.sum("n_tokens").over(by_place), F.lit(0))).join(windows, "window_name")
    bad = rooms.groupBy("window_name").agg(F.sum(((F.col("so_far") != F.col("at_token")) | (F.col("so_far") + F.col("n_tokens") > F.col("capacity_tokens"))).cast("bigint")).alias("n_bad_places"))
    return told.join(bad, "window_name", "left")
