import random
import re

import pytest
from pyspark.sql import functions as F

from revloom.llm import contamination as C


def ws(t):
    return [w.lower() for w in re.findall(r"[^\W_]+", t or "")]


def brute(docs, items, run=12):
    out = set()
    for i, t in items:
        w = ws(t)
        grams = {tuple(w[k : k + run]) for k in range(len(w) - run + 1)}
        for d, x in docs:
            v = ws(x)
            if d is not None and any(tuple(v[k : k + run]) in grams for k in range(len(v) - run + 1)):
                out.add((d, i))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    words = ["the", "a", "is"] * 5 + [f"w{i}" for i in range(50)] + ["Straße", "ÉTÉ", "x9"]
    items = [(i, " ".join(rnd.choices(words, k=rnd.randint(5, 60)))) for i in range(25)]
    docs = []
    for d in range(120):
        v = rnd.choices(words, k=rnd.randint(0, 80))
        if rnd.random() < 0.5:
            w = ws(rnd.choice(items)[1])
            s = rnd.randint(0, max(0, len(w) - 8))
            cut = w[s : s + rnd.choice([8, 11, 12, 13, 40])]
            at = rnd.randint(0, len(v))
            v[at:at] = [x.upper() if rnd.random() < 0.3 else x for x in cut]
        docs.append((d, rnd.choice([" ", ", ", "_", "\n-- "]).join(v)))
    docs += [docs[0], (500, None), (501, ""), (None, docs[0][1]), (502, items[0][1] * 400)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("term", F.lit(1)).withColumn("k", F.lit("x")).withColumn("pos", F.lit(0))
    it = spark.createDataFrame(items + [(900, None), (901, "too short"), items[0]], "item_id long, text string")
    assert {tuple(r) for r in C.phrase_matches(df, it).collect()} == brute(docs, items)


def test_many_items_share_slots(spark, monkeypatch):
    monkeypatch.setattr(C, "SLOTS", 64)
    items = [(i, " ".join(f"i{i}x{k}" for k in range(20))) for i in range(6000)]
    docs = [(i, "before " + t + " after") for i, t in items[::60]]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(k, k) for k, _ in docs}
    assert {tuple(r) for r in C.phrase_matches(d, i).collect()} == want
    assert {tuple(r)[:2] for r in C.proximity_matches(d, i).collect()} == want


def test_words_outside_the_vocabulary_are_no_match(spark):
    item = " ".join(f"a{k}" for k in range(14))
    doc = "a0 a1 a2 zzz yyy xxx a6 a7 a8 a9 a10 a11 qqq rrr"
    it = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert C.phrase_matches(spark.createDataFrame([(1, doc)], "doc_id long, text string"), it).count() == 0
    near = C.proximity_matches(spark.createDataFrame([(1, item.replace("a6", "a6 inserted")), (2, "a0 b"), (3, doc)], "doc_id long, text string"), it).collect()
    assert {tuple(r) for r in near} == {(1, 1, 14)}
    assert C.phrase_matches(spark.createDataFrame([(1, item.replace("a6", "a6 inserted"))], "doc_id long, text string"), it).count() == 0


def brute_near(docs, items, slop=8, least=12, seed=6):
    out = {}
    for i, t in items:
        w = ws(t)
        for d, x in docs:
            v, bands = ws(x), {}
            for p in range(len(w) - seed + 1):
                for k in range(len(v) - seed + 1):
                    if v[k : k + seed] == w[p : p + seed]:
                        for band in ((k - p) // slop, (k - p) // slop - 1):
                            bands.setdefault(band, set()).update(range(p, p + seed))
            n = max((len(s) for s in bands.values()), default=0)
            if n >= least:
                out[(d, i)] = n
    return out


def test_edited_passages(spark):
    rnd = random.Random(4)
    words = ["the", "a", "is"] * 5 + [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rnd.choices(words, k=rnd.randint(20, 60)))) for i in range(15)]
    docs, planted = [], set()
    for d in range(150):
        v = rnd.choices(words, k=rnd.randint(0, 60))
        i, t = rnd.choice(items)
        w = ws(t)
        # One word in twelve is replaced, dropped or doubled.
        for k in range(rnd.randint(5, 11), len(w), 12):
            w[k : k + 1] = rnd.choice([["other"], [], w[k : k + 1] * 2])
        at = rnd.randint(0, len(v))
        docs.append((d, " ".join(v[:at] + w + v[at:])))
        planted.add((d, i))
    got = {(r.doc_id, r.item_id): r.near_words for r in C.proximity_matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute_near(docs, items)
    assert len(planted & set(got)) >= 0.9 * len(planted)
    assert set(got) >= brute(docs, items)


def test_empty(spark):
    d, i = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "x " * 30)], "item_id long, text string")
    assert C.phrase_matches(d, i).count() == 0 and C.phrase_matches(d, one).count() == 0 and C.proximity_matches(d, i).count() == 0
