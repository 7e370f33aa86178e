import random

import pytest
from pyspark.sql import functions as F

from revloom.llm import truncation as T


@pytest.mark.parametrize(
    "text, cls",
    [
        ("All done.", "stop"), ("Really?", "stop"), ("Same here :)", "stop"), ("Approved 👍", "stop"), ('He said "no."', "stop"),
        ("code:\n```\nx\n```", "fence"), ("text\n```ts\nconst a = f(x", "in code"),
        ("Text.\n\n-- ann_x", "trailer"), ("Text.\nRefs: LED-12", "trailer"), ("See\nhttps://forge.example/a/b/pull/3", "trailer"),
        ("The first [message clipped]", "mark"), ("The fal (truncated)", "mark"),
        ("a part of&#8", "scrap"), ("a part of&am", "scrap"), ("a sector%2", "scrap"), ("numb\\u00", "scrap"), ("a race b<b", "scrap"), ("gone �", "scrap"),
        ("we saw 100%", "line?"), ("To be continued...", "dots?"), ("If the sink is...", "dots?"), ("The window keeps the", "line?"),
        ("10:00:01 INFO a\n10:00:02 DEB", "open"), ("10:00:01 INFO a\nProcess finished with exit code 3", "log?"), ("", "blank"), (" \n ", "blank"),
    ],
)
def test_endings(text, cls):
    assert T.ending(text)[0] == cls


def sentence(rnd):
    return " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "window", "sensor"]) for _ in range(rnd.randint(4, 12))).capitalize() + "."


def make(seed=0, n=1500):
    rnd = random.Random(seed)
    rows, cut = [], set()
    for i in range(n):
        source, importer = rnd.choice([("note", "hook"), ("note", "rest"), ("log", "bulk")])
        text = " ".join(sentence(rnd) for _ in range(max(1, int(rnd.lognormvariate(1.8, 0.7)))))
        if source == "log":
            text = "\n".join(f"10:00:{k % 60:02d} INFO step {rnd.randint(1, 99)} of {rnd.choice('abc')} done" for k in range(max(2, int(rnd.lognormvariate(2.0, 0.6))))) + f"\nProcess finished with exit code {rnd.randint(0, 9)}"
        elif rnd.random() < 0.3:
            text += "\n\n" + rnd.choice(["Alpha beta gamma (#12)", "fix(window): delta sensor", "To be continued..."])
        elif rnd.random() < 0.2:
            text = "Alpha beta gamma (#7)\n\nfix(sensor): beta alpha\n\n" + text
        limit = {"hook": 400, "bulk": 500}.get(importer)
        if limit and len(text) > limit:
            text = text[:limit]
            cut.add(i)
        elif rnd.random() < 0.02 and len(text) > 60:
            text = text[: rnd.randint(30, len(text) - 20)].rstrip(". ")
            cut.add(i)
        rows.append((i, source, importer, text))
    return rows, cut


def test_limits_and_posteriors(spark):
    rows, cut = make()
    df = spark.createDataFrame(rows, "doc_id long, source string, importer string, text string").withColumn("cls", F.lit("x")).withColumn("length", F.lit(1)).withColumn("key", F.lit(2))
    got = T.cut_posteriors(df).collect()
    assert len(got) == len(rows)
    found = {r.doc_id for r in got if r.p_cut >= 0.5}
    assert len(found & cut) >= 0.95 * len(cut) and len(found & cut) >= 0.95 * len(found)
    assert {r.length_limit for r in got if r.length_limit} >= {"chars:400", "chars:500"}


def test_odd_rows(spark):
    rows, _ = make(1, 60)
    rows += [(100, None, None, "No source here"), (101, "note", None, None), (102, "note", None, ""), (None, "note", None, "x"), (103, "note", "rest", "long word " * 50_000), rows[0], (104, "note", "rest", "Ends well.")]
    got = {r.doc_id: r for r in T.cut_posteriors(spark.createDataFrame(rows, "doc_id long, source string, importer string, text string")).collect()}
    assert 101 not in got and None not in got and got[102].p_cut < 0.5 and got[104].p_cut < 0.5 and got[103].p_cut > 0.5
    empty = spark.createDataFrame([], "doc_id long, source string, importer string, text string")
    assert T.cut_posteriors(empty).count() == 0


def test_censored_fit():
    import math

    rnd = random.Random(3)
    lens = [max(1, round(rnd.lognormvariate(6, 0.5))) for _ in range(5000)]
    for limit, n_at, least, most in ((500, None, 0.95, 1), (900, 8, 0.001, 0.9)):
        below = [x for x in lens if x < limit]
        at = sum(x >= limit for x in lens) if n_at is None else n_at
        heap = {"below": len(below), "n": at, "above": 0 if n_at is None else sum(x > limit for x in lens), "length": limit, "s1": sum(map(math.log, below)), "s2": sum(math.log(x) ** 2 for x in below)}
        assert least <= T.censoring_posterior(heap) <= most


def test_beginnings_of_sentences_are_no_habit(spark):
    rnd = random.Random(5)
    texts = [sentence(rnd) + " The " + sentence(rnd).lower() for _ in range(600)]
    texts += [sentence(rnd) + " Hmm, not sure yet..." for _ in range(20)]
    short = [sentence(rnd) + end for end in (" The...", " The alpha...", " Al…") for _ in range(4)]
    log = "10:00:01 INFO a\n10:00:02 INFO b\n"
    logs = [log + f"Process finished with exit code {i % 3}" for i in range(300)] + [log + "Process fini"] * 4
    rows = [(i, "note", "rest", t) for i, t in enumerate(texts + short + logs)]
    got = {r.doc_id: r.cls for r in T.cut_posteriors(spark.createDataFrame(rows, "doc_id long, source string, importer string, text string")).collect()}
    at = len(texts)
    assert {got[i] for i in range(600, at)} == {"formula"}
    assert {got[at + i] for i in range(len(short))} == {"dots"}
    at += len(short)
    assert {got[at + i] for i in range(300)} == {"stop"} and {got[at + 300 + i] for i in range(4)} == {"open"}
    assert T.going_on("The sum. To be continued...", {4: {"gthe"}, 16: {"gto be continued"}}) == {"gthe"}


def chat(rnd, n):
    """Lines that mostly end without a full stop, cut at 300 characters where they are longer."""
    rows, cut = [], set()
    for i in range(n):
        words = [rnd.choice(["alpha", "beta", "gamma", "delta", "window", "sensor"]) + rnd.choice(["", "s", "x%d" % rnd.randint(0, 999)]) for _ in range(max(4, int(rnd.lognormvariate(3.3, 0.5))))]
        text = " ".join(words) + (" then." if rnd.random() < 0.2 else "")
        if len(text) > 300:
            text = text[:300]
            cut.add(i)
        rows.append((i, "chat", "hook", text))
    return rows, cut


def test_the_fit_decides(spark):
    # Open endings are a habit of this source, so only the limit tells its cut texts; beside them an ordinary source.
    rows, cut = chat(random.Random(2), 3000)
    more, more_cut = make(4, 800)
    rows += [(10_000 + i, *r) for i, *r in more]
    df = spark.createDataFrame(rows, "doc_id long, source string, importer string, text string")
    with_fit = {r.doc_id for r in T.cut_posteriors(df).filter("p_cut >= 0.5").collect()}
    without = {r.doc_id for r in T.cut_posteriors(df, limits=False).filter("p_cut >= 0.5").collect()}
    chat_found = {i for i in with_fit if i < 10_000}
    assert len(cut) > 50 and len(chat_found & cut) >= 0.9 * len(cut) and len(chat_found & cut) >= 0.9 * len(chat_found)
    assert not {i for i in without if i < 10_000}
    rest = {i - 10_000 for i in with_fit if i >= 10_000}
    assert len(rest & more_cut) >= 0.95 * len(more_cut) and len(rest & more_cut) >= 0.95 * len(rest)


def test_complete_looking_endings_at_a_limit(spark):
    # Lists of lines without full stops: a cut mostly leaves what looks like one more whole line.
    rnd = random.Random(8)
    rows, cut = [], set()
    for i in range(2000):
        text = "\n".join("- " + " ".join(rnd.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rnd.randint(2, 7))) for _ in range(max(1, int(rnd.lognormvariate(2.0, 0.6)))))
        if len(text) > 500:
            text = text[:500]
            cut.add(i)
        rows.append((i, "list", "rest", text))
    df = spark.createDataFrame(rows, "doc_id long, source string, importer string, text string")
    with_fit, without = ({r.doc_id: r for r in T.cut_posteriors(df, limits=x).collect()} for x in (True, False))
    lines = [i for i in cut if with_fit[i].cls == "line"]
    assert len(lines) > 20 and {with_fit[i].length_limit for i in lines} == {"chars:500"}
    assert all(with_fit[i].p_cut >= 0.5 > without[i].p_cut for i in lines)
    assert not {i for i, r in with_fit.items() if r.p_cut >= 0.5} - cut


def test_unrelated_texts_change_nothing(spark):
    rows, _ = make(6, 500)
    other = [(100_000 + i, "elsewhere", "bulk", sentence(random.Random(i)) * 3) for i in range(3000)]
    schema = "doc_id long, source string, importer string, text string"
    alone, beside = ({r.doc_id: r.cls for r in T.cut_posteriors(spark.createDataFrame(x, schema)).collect()} for x in (rows, rows + other))
    assert all(beside[i] == c for i, c in alone.items())
