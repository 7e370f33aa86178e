import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from revloom.llm import near_duplicates as N


def brute(rows, t=Fraction(7, 10)):
    sets = {(i, x): frozenset(re.findall("[a-z0-9_]+", (x or "").lower())) for i, x in rows if i is not None}
    out = set()
    keys = list(sets)
    for a in range(len(keys)):
        for b in range(a + 1, len(keys)):
            (i, x), (j, y) = keys[a], keys[b]
            p, q = sets[keys[a]], sets[keys[b]]
            if i != j and p | q and Fraction(len(p & q), len(p | q)) >= t:
                out.add((min(i, j), max(i, j)))
    return out


def corpus(seed, n=150):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["if", "return", "the"] * 4
    rows = []
    for i in range(n):
        if rows and rnd.random() < 0.6:
            toks = rnd.choice(rows)[1].split()
            for _ in range(rnd.randint(0, 3)):
                if toks and rnd.random() < 0.5:
                    toks.pop(rnd.randrange(len(toks)))
                else:
                    toks.insert(rnd.randint(0, len(toks)), rnd.choice(words))
        else:
            toks = rnd.choices(words, k=rnd.randint(0, 25))
        rows.append((f"e{i:03d}", " ".join(toks)))
    return rows


@pytest.mark.parametrize("seed", range(5))
def test_pairs_against_brute_force(spark, seed):
    rows = corpus(seed) + [("e000", corpus(seed)[0][1]), ("dup", "A, b; C"), ("dup2", "c B a"), ("dup3", "c B a"), ("none", ""), ("none2", "??"), (None, "a b c"), ("null", None)]
    df = spark.createDataFrame([(i, x or "") for i, x in rows], "id string, text string").withColumn("doc", F.lit(1)).withColumn("tok", F.lit(2)).withColumn("n", F.lit(3))
    df = df.filter("id is not null")
    assert {tuple(r) for r in N.similar_records(df).collect()} == brute(rows)
    assert {tuple(r) for r in N.similar_records(df, "0.8").collect()} == brute(rows, Fraction(8, 10))


@pytest.mark.parametrize("slots, shared", [(1, 1), (4, 3), (1 << 10, 6)])
def test_order_and_overlap_only_change_the_work(spark, slots, shared):
    rows = corpus(9, 80)
    docs = N.materialize(N.token_classes(spark.createDataFrame(rows, "id string, text string")).withColumn("doc", F.monotonically_increasing_id()), "t")
    base = N.similar_classes(docs).count()
    assert N.similar_classes(docs, shared=shared, slots=slots).count() == base > 0


def test_a_hot_copy_is_one_class(spark):
    rows = [(f"h{i:03d}", "same text in many rows") for i in range(60)] + [("x", "same text in many row s")]
    df = spark.createDataFrame(rows, "id string, text string")
    assert N.token_classes(df).count() == 2
    groups = N.similar_groups(df).collect()
    assert {(r.group_id, r.n_copies, r.n_links) for r in groups} == {("h000", 59, 0)}
    assert N.similar_records(df).count() == 60 * 59 // 2


def test_groups_against_union_find(spark):
    rows = corpus(3)
    pairs = brute(rows)
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = {i: find(i) for p in pairs for i in p}
    got = {r.id: r.group_id for r in N.similar_groups(spark.createDataFrame(rows, "id string, text string")).collect()}
    assert got == want


def test_long_chains_and_empty_tables(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {r.root for r in N.connected(edges).collect()} == {0}
    empty = spark.createDataFrame([], "id string, text string")
    assert N.similar_records(empty).count() == 0 and N.similar_groups(empty).count() == 0


def test_very_long_record(spark):
    long = " ".join(f"t{i}" for i in range(50_000))
    df = spark.createDataFrame([("a", long), ("b", long + " x"), ("c", "t1 t2")], "id string, text string")
    assert [tuple(r) for r in N.similar_records(df).collect()] == [("a", "b")]


def test_episode_text(spark):
    df = spark.createDataFrame([("a", ("N1",), None, None), (None, None, None, "x"), ("b", None, ("n1",), "")], "id string, rejected struct<normalized: string>, accepted struct<normalized: string>, comment_body string")
    assert [tuple(r) for r in N.similar_records(N.episode_records(df)).collect()] == [("a", "b")]
