"""Similarity edges and leader clusters of before/after pairs.

Greedy clustering by first members is the same as taking the items of a bucket in order and giving
each to the earliest leader it is similar to, or making it a leader. That needs no sequential task:

* items with the same normal form are one *form*, led by its earliest item, since they have the
  same neighbours;
* edges between forms of a bucket come from an exact prefix-filter join: with similarity
  (J + L) / 2 >= t neither J nor L is below 2t - 1, so the rarest names of both forms must meet, and
  lengths must lie within that band;
* leaders are settled over the sparse edges. In rounds, a form without an open earlier neighbour joins
  its earliest leader or becomes one, and what is settled leaves; as soon as the open edges, or those
  of a connected component, are few enough for one task, they are walked through in order there.

So a bucket that holds a third of all items is spread over as many tasks as its forms need.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from revloom.functions import text as T
from revloom.operators.components import connected
from revloom.session import materialize

THRESHOLD = 0.72
#: Edges that one task walks through; every so many rounds over the open edges their components are looked at.
LOCAL_EDGES, ROUNDS = 200_000, 3
#: Forms of a cluster that one task compares with each other; candidates of a larger one that a round compares with all.
LOCAL_FORMS, CANDIDATES = 1500, 48


def forms(items: DataFrame) -> DataFrame:
    """(bucket, form, first, names, n, len): the distinct normal forms of a bucket's ``items``.

    ``items`` has bucket, pos (an order without ties within the bucket) and form (text).
    """
    return (
        items.groupBy("bucket", "form")
        .agg(F.min("pos").alias("first"))
        .withColumn("names", T.name_set(F.col("form")))
        .withColumn("n", F.size("names"))
        .withColumn("len", F.length("form"))
    )


def similar_forms(fs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(bucket, a, b): pairs of forms, by their first positions with a < b, with similarity of at least ``threshold``.

    ``fs`` as from ``forms``, materialized. Forms without names overlap fully with each other and
    not at all with the rest; they meet by length alone.
    """
    least = 2 * threshold - 1
    if least <= 0:
        raise ValueError("the threshold must be above one half")
    names = fs.select("bucket", "first", "n", F.explode("names").alias("name"))
    often = names.groupBy("bucket", "name").agg(F.count("*").alias("often")).filter("often > 1")
    ranked = names.join(often, ["bucket", "name"], "left").withColumn("at", F.row_number().over(W.partitionBy("bucket", "first").orderBy(F.coalesce("often", F.lit(1)), "name")))
    # The rarest n - ceil(least n) + 1 names of each form; names that occur once meet nothing.
    prefix = ranked.filter(F.expr(f"at <= n - ceil({least}D * n - 1e-9) + 1 and often is not null")).select("bucket", "name", "first")
    met = (
        prefix.withColumnRenamed("first", "a")
        .join(prefix.withColumnRenamed("first", "b"), ["bucket", "name"])
        .filter("a < b")
        .select("bucket", "a", "b")
        .distinct()
    )
    side = fs.select("bucket", "first", "names", "n", "len")
    one, two = (side.select("bucket", *(F.col(c).alias(x if c == "first" else f"{c}_{x}") for c in ("first", "names", "n", "len"))) for x in "ab")
    alike = (
        met.join(one, ["bucket", "a"])
        .join(two, ["bucket", "b"])
        .filter(F.least("len_a", "len_b") >= F.lit(least) * F.greatest("len_a", "len_b") - 1e-9)
        .filter(T.similarity(F.col("names_a"), F.col("names_b"), F.col("len_a"), F.col("len_b")) >= threshold)
        .select("bucket", "a", "b")
    )
    # No names on either side: similar if the lengths are. Lengths meet in bands of ratio ``least``.
    band = F.floor(F.log(F.greatest(F.col("len"), F.lit(1))) / F.lit(-__import__("math").log(least))).cast("int")
    bare = side.filter("n = 0").select("bucket", "first", "len", band.alias("band"))
    left = bare.select("bucket", F.col("first").alias("a"), F.col("len").alias("len_a"), F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    nameless = left.join(bare.select("bucket", F.col("first").alias("b"), F.col("len").alias("len_b"), "band"), ["bucket", "band"]).filter("a < b").filter(F.lit(0.5) + F.lit(0.5) * T.length_ratio(F.col("len_a"), F.col("len_b")) >= threshold)
    return alike.unionByName(nameless.select("bucket", "a", "b"))


_LED = "bucket string, first bigint, leader bigint"


def _walk(edges: pd.DataFrame) -> pd.DataFrame:
    """(bucket, first, leader) of the open forms b of ``edges`` (bucket, a, b, led), in order; a null a stands for a form without edges."""
    out = []
    for bucket, f in edges.groupby("bucket"):
        leading = set(f.loc[f["led"].fillna(False).astype(bool), "a"])
        before: dict[int, list] = {}
        for a, b in zip(f["a"], f["b"]):
            before.setdefault(b, []).append(a)
        for b in sorted(before):
            leader = min((a for a in before[b] if a in leading), default=b)
            if leader == b:
                leading.add(b)
            out.append((bucket, int(b), int(leader)))
    return pd.DataFrame(out, columns=["bucket", "first", "leader"])


def _walk_parts(open_: DataFrame, forms_: DataFrame) -> DataFrame:
    """(bucket, first, leader) of the first open forms of every connected component, as many as one task walks through."""
    node = lambda c: F.xxhash64("bucket", c)
    roots = connected(open_.filter("not led").select(node("a").alias("a"), node("b").alias("b")))
    degree = open_.groupBy("bucket", F.col("b").alias("first")).agg(F.count("*").alias("n"))
    placed = forms_.join(degree, ["bucket", "first"], "left").withColumn("node", node("first")).join(roots, "node", "left").select("bucket", "first", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("root", "node").alias("root"))
    # All edges of a form come from earlier ones, so the beginning of a component can be settled by itself.
    upto = F.coalesce(F.sum("n").over(W.partitionBy("root").orderBy("first").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    first = materialize(placed.withColumn("upto", upto).filter(F.col("upto") < LOCAL_EDGES).select("root", "bucket", F.col("first").alias("b")), "walked")
    near = open_.join(first, ["bucket", "b"]).select("root", "bucket", "a", "b", "led")
    alone = first.select("root", "bucket", F.lit(None).cast("bigint").alias("a"), "b", F.lit(False).alias("led"))
    return near.unionByName(alone).groupBy("root").applyInPandas(_walk, _LED)


def leaders(fs: DataFrame, edges: DataFrame) -> DataFrame:
    """(bucket, first, leader): the leader of every form, both by first position."""
    edges = materialize(edges.select("bucket", "a", "b"), "edges")
    forms_ = materialize(edges.select("bucket", F.col("b").alias("first")).distinct(), "open-forms")
    out = fs.select("bucket", "first", F.col("first").alias("leader")).join(forms_, ["bucket", "first"], "left_anti")
    # ``led`` marks edges from a leader; all others come from open forms.
    waiting = forms_.select("bucket", F.col("first").alias("a"), F.lit(False).alias("led"))
    open_ = materialize(edges.join(waiting, ["bucket", "a"], "left").withColumn("led", F.coalesce("led", F.lit(True))), "open-edges")
    rounds = 0
    while open_.count() > LOCAL_EDGES:
        rounds += 1
        if rounds % ROUNDS:
            # Of each open form: its earliest leading neighbour, and its earliest open neighbour before it.
            seen = open_.groupBy("bucket", F.col("b").alias("first")).agg(F.min(F.when(F.col("led"), F.col("a"))).alias("to"), F.min(F.when(~F.col("led"), F.col("a"))).alias("waits"))
            decided = F.when(F.col("to").isNotNull() & (F.col("waits").isNull() | (F.col("waits") > F.col("to"))), F.col("to")).when(F.col("to").isNull() & F.col("waits").isNull(), F.col("first"))
            told = forms_.join(seen, ["bucket", "first"], "left").select("bucket", "first", decided.alias("leader")).filter("leader is not null")
        else:
            told = _walk_parts(open_, forms_)
        told = materialize(told, "led")
        out = out.unionByName(told)
        forms_ = materialize(forms_.join(told.select("bucket", "first"), ["bucket", "first"], "left_anti"), "open-forms")
        side = told.select("bucket", F.col("first").alias("a"), "leader")
        left = open_.join(forms_.withColumnRenamed("first", "b"), ["bucket", "b"], "left_semi").join(side, ["bucket", "a"], "left")
        # Edges from what has just joined a leader go; those from a new leader stay as such.
        leads = F.col("leader") == F.col("a")
        open_ = materialize(left.filter(F.col("leader").isNull() | leads).select("bucket", "a", "b", (F.col("led") | F.coalesce(leads, F.lit(False))).alias("led")), "open-edges")
    alone = forms_.select("bucket", F.lit(None).cast("bigint").alias("a"), F.col("first").alias("b"), F.lit(False).alias("led"))
    return materialize(out.unionByName(open_.unionByName(alone).groupBy("bucket").applyInPandas(_walk, _LED)), "leaders")


def clusters(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``items`` with ``leader``, the position of the first member of each one's cluster.

    ``items`` has bucket, pos and form among its columns. An item with a null bucket is in a bucket
    of its own kind; a null form counts as empty.
    """
    keyed = items.withColumn("bucket", F.coalesce("bucket", F.lit(""))).withColumn("form", F.coalesce("form", F.lit("")))
    fs = materialize(forms(keyed.select("bucket", "pos", "form")), "forms")
    led = leaders(fs, similar_forms(fs, threshold))
    of_form = fs.select("bucket", "form", "first").join(led, ["bucket", "first"]).select("bucket", "form", "leader")
    return keyed.join(of_form, ["bucket", "form"])


def medoids(members: DataFrame) -> DataFrame:
    """(bucket, leader, medoid, support): per cluster the position of its most central member.

    The mean similarity of a member to all others decides, then the earlier position. Members of
    one form have the same mean, so sums run over the forms of a cluster, weighted by how many
    members have them: a cluster of copies is one row, whatever its size. The forms of a cluster
    with up to ``LOCAL_FORMS`` of them are compared in one task. Of a larger one, only candidates are
    compared with all forms: one minus the similarity is a metric, so the exact sums of some
    candidates bound those of all other forms, and most are never compared.
    """
    sized = members.groupBy("bucket", "leader", "form").agg(F.min("pos").alias("pos"), F.count("*").alias("w")).withColumn("names", T.name_set(F.col("form"))).withColumn("len", F.length("form")).drop("form")
    total = sized.groupBy("bucket", "leader").agg(F.sum("w").alias("support"), F.count("*").alias("n_forms"), F.min("pos").alias("only"))
    sized, total = materialize(sized, "cluster-forms"), materialize(total, "cluster-sizes")
    some = total.filter((F.col("n_forms") > 1) & (F.col("n_forms") <= LOCAL_FORMS)).select("bucket", "leader", "support")
    near = sized.join(some, ["bucket", "leader"]).groupBy("bucket", "leader").applyInPandas(_central, "bucket string, leader bigint, medoid bigint, support bigint")
    one = total.filter("n_forms = 1").select("bucket", "leader", F.col("only").alias("medoid"), "support")
    large = total.filter(F.col("n_forms") > LOCAL_FORMS).select("bucket", "leader", "support")
    return one.unionByName(near) if large.isEmpty() else one.unionByName(near).unionByName(_large_medoids(sized, large))


def _central(f: pd.DataFrame) -> pd.DataFrame:
    """The medoid of one cluster's forms."""
    import numpy as np

    having: dict[str, list[int]] = {}
    for i, names in enumerate(f["names"]):
        for x in names:
            having.setdefault(x, []).append(i)
    n, length, w = (np.array(x, dtype=float) for x in (f["names"].map(len), f["len"], f["w"]))
    common = np.diag(n)
    for rows in having.values():
        if len(rows) > 1:
            common[np.ix_(rows, rows)] += 1
    np.fill_diagonal(common, n)
    either = n[:, None] + n[None, :] - common
    jaccard = np.where(either > 0, common / np.maximum(either, 1), 1.0)
    low, high = np.minimum(length[:, None], length[None, :]), np.maximum(length[:, None], length[None, :])
    sim = 0.5 * jaccard + 0.5 * np.where(high > 0, low / np.maximum(high, 1), 1.0)
    sums = np.round(sim @ w - np.diag(sim), 9)
    best = min(zip(-sums, f["pos"]))
    return pd.DataFrame({"bucket": [f["bucket"].iloc[0]], "leader": [f["leader"].iloc[0]], "medoid": [best[1]], "support": [f["support"].iloc[0]]})


def _large_medoids(sized: DataFrame, large: DataFrame) -> DataFrame:
    """The medoids of clusters with many forms, by rounds of candidates."""
    key = ["bucket", "leader"]
    forms_ = materialize(sized.join(large, key), "large-clusters")
    # ``low`` bounds the sum of distances from below; ``best`` is the least exact sum (its 9 decimals) and its position.
    open_ = forms_.select(*key, "pos", F.lit(0.0).alias("low"))
    best = None
    while not open_.isEmpty():
        turn = W.partitionBy(*key, "shard").orderBy("low", F.xxhash64("pos"))
        # The lowest bounds of each shard of a cluster, then of these: no task sees a whole cluster.
        shards = open_.withColumn("shard", F.pmod(F.xxhash64("pos", F.lit(7)), F.lit(64))).withColumn("r", F.row_number().over(turn)).filter(F.col("r") <= CANDIDATES)
        picked = shards.withColumn("r", F.row_number().over(W.partitionBy(*key).orderBy("low", F.xxhash64("pos")))).filter(F.col("r") <= CANDIDATES).select(*key, "pos")
        picked = materialize(picked.join(forms_, [*key, "pos"]).select(*key, F.col("pos").alias("c"), F.col("names").alias("cn"), F.col("len").alias("cl")), "candidates")
        spread = picked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(63))))
        away = F.lit(1.0) - T.similarity(F.col("names"), F.col("cn"), F.col("len"), F.col("cl"))
        apart = materialize(forms_.withColumn("salt", F.pmod(F.xxhash64("pos"), F.lit(64)).cast("int")).join(spread, [*key, "salt"]).select(*key, "c", "pos", "w", "support", away.alias("d")), "distances")
        sums = materialize(apart.groupBy(*key, "c").agg(F.sum(F.col("w") * F.col("d")).alias("s"), F.first("support").alias("support")), "sums")
        told = sums.groupBy(*key).agg(F.min(F.struct((-F.round(F.col("support") - 1 - F.col("s"), 9)).alias("neg"), F.col("c").alias("pos"))).alias("best"))
        best = told if best is None else best.unionByName(told).groupBy(*key).agg(F.min("best").alias("best"))
        best = materialize(best, "best")
        bounds = apart.join(sums.select(*key, "c", "s"), [*key, "c"]).groupBy(*key, "pos").agg(F.max(F.abs(F.col("support") * F.col("d") - F.col("s"))).alias("bound"))
        kept = open_.join(picked.select(*key, F.col("c").alias("pos")), [*key, "pos"], "left_anti").join(bounds, [*key, "pos"]).join(best, key).join(large, key)
        # A bound beyond the best sum, with room for rounding, rules a form out.
        open_ = materialize(kept.withColumn("low", F.greatest("low", "bound")).filter(F.col("low") <= F.col("best.neg") + F.col("support") - 1 + 1e-6).select(*key, "pos", "low"), "open-medoids")
    return best.join(large, key).select(*key, F.col("best.pos").alias("medoid"), "support")


def bucket_of(language: Column, path: Column) -> Column:
    return F.concat(F.coalesce(language, F.lit("unknown")), F.lit("\x00"), T.top_segment(path))
