import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from revloom.operators import clustering
from revloom.operators.ordering import with_positions
from revloom.operators.validation import answer_of, validate_medium
from revloom.plans import compile as compiling, retrieve
from revloom.errors import InvalidDiff, NotFound


def py_sim(a, b):
    import re

    x, y = (set(re.findall(r"[A-Za-z_][A-Za-z0-9_]*", t)) for t in (a, b))
    j = 1.0 if not x and not y else 0.0 if not x or not y else len(x & y) / len(x | y)
    r = 1.0 if not a and not b else min(len(a), len(b)) / max(len(a), len(b))
    return 0.5 * j + 0.5 * r


def py_leaders(forms, t=0.72):
    leaders, out = [], []
    for i, f in enumerate(forms):
        lead = next((k for k in leaders if py_sim(forms[k], f) >= t), None)
        if lead is None:
            leaders.append(i)
            lead = i
        out.append(lead)
    return out


@pytest.mark.parametrize("seed, local", [(0, None), (1, None), (2, 3), (3, 0)])
def test_leaders_match_the_sequential_walk(spark, monkeypatch, seed, local):
    rnd = random.Random(seed)
    if local is not None:
        monkeypatch.setattr(clustering, "LOCAL_EDGES", local)
        monkeypatch.setattr(clustering, "LOCAL_FORMS", 2)
        monkeypatch.setattr(clustering, "CANDIDATES", 2)
    words = [f"name{i}" for i in range(9)]
    data = []
    for b in ("x", "y"):
        for i in range(40):
            form = rnd.choice(["", "++", "+ - *", None] + [" ".join(rnd.choices(words, k=rnd.randint(1, 7))) for _ in range(20)])
            data.append((b, i, form))
    items = spark.createDataFrame(data, "bucket string, pos long, form string")
    got = {(r.bucket, r.pos): r.leader for r in clustering.clusters(items).collect()}
    for b in ("x", "y"):
        forms = [f or "" for bb, _, f in data if bb == b]
        want = py_leaders(forms)
        assert [got[(b, i)] for i in range(40)] == want
    members = clustering.clusters(items)
    for r in clustering.medoids(members.select("bucket", "leader", "form", "pos")).collect():
        pos = sorted(p for (b, p), l in got.items() if b == r.bucket and l == r.leader)
        forms = {i: (f or "") for bb, i, f in data if bb == r.bucket}
        mean = lambda p: sum(py_sim(forms[p], forms[o]) for o in pos if o != p)
        assert r.support == len(pos)
        assert mean(r.medoid) == pytest.approx(max(map(mean, pos)))


def test_a_long_chain(spark):
    chain = [("x", i, i + 1) for i in range(1500)] + [("y", 0, 5)]
    fs = spark.createDataFrame([("x", i) for i in range(1501)] + [("y", 0), ("y", 5), ("y", 7)], "bucket string, first long")
    got = {(r.bucket, r.first): r.leader for r in clustering.leaders(fs, spark.createDataFrame(chain, "bucket string, a long, b long")).collect()}
    assert got == {("x", i): i - i % 2 for i in range(1501)} | {("y", 0): 0, ("y", 5): 0, ("y", 7): 7}


def test_clusters_of_nothing(spark):
    empty = spark.createDataFrame([], "bucket string, pos long, form string")
    assert clustering.clusters(empty).count() == 0


SPAN = "struct<path: string, start_line: int, end_line: int, sha: string, text: string, normalized: string>"
EPISODE = f"id string, repo string, pr_number int, comment_id string, path string, file_language string, comment_body string, rejected {SPAN}, accepted {SPAN}, link_confidence string, link_reason string, reviewer string, merged_at timestamp"


def span(text):
    return ("p", 1, 1, "s", text, text)


@pytest.fixture
def episodes(spark):
    rows = [
        ("e1", "a/b", 1, "c1", "src/api/x.ts", "typescript", "Avoid fetch here, prefer client", span("const result = fetch(url, options);"), span("const result = client.get(url, options);"), "high", "", "ann", datetime(2025, 1, 1)),
        ("e2", "a/b", 2, "c2", "src/api/y.ts", "typescript", "client instead of fetch", span("const result = fetch(url, options2);"), span("const result = client.get(url, options2);"), "medium", "", "bob", datetime(2025, 3, 1)),
        ("e3", "a/b", 3, "c3", "src/z.ts", "typescript", "unlike", span("while (true) { runEverything(); }"), span("schedule(runEverything);"), "high", "", None, datetime(2025, 2, 1)),
        ("e4", "a/b", 3, "c4", "src/z.ts", None, "gone", span("x"), None, "medium", "", None, None),
        ("e5", "a/b", 3, "c5", "src/z.ts", None, "low", span("x"), span("y"), "low", "", None, None),
        ("e6", "a/b", 3, "c6", None, None, None, None, span("y"), "none", "", None, None),
    ]
    return with_positions(spark.createDataFrame(rows, EPISODE), ["id"])


def test_compile(spark, episodes):
    got = compiling.compile_recipes(episodes, as_of=datetime(2025, 4, 1)).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.support, r.episode_ids, r.reviewers, r.languages, r.path_prefixes) == (2, ["e1", "e2"], ["ann", "bob"], ["typescript"], ["src/api/"])
    assert r.avg_link_confidence == pytest.approx(0.85) and r.title == "Client: src/api rewrite (2 reviews)" and not r.suppressed
    assert r.before == "const result = fetch(url, options);" and r.created_at == "2025-04-01T00:00:00.000Z"
    single = compiling.compile_recipes(episodes, allow_single_high=True)
    assert sorted(x.support for x in single.collect()) == [1, 2]
    assert compiling.drop_histogram(episodes).first().asDict() == {"no_accepted": 1, "low_confidence": 1, "none_confidence": 1}
    meta = compiling.compile_meta(episodes, compiling.cluster_members(episodes)).first()
    assert (meta.episodes, meta.eligible_episodes, meta.clusters, meta.below_min_support, meta.min_support) == (6, 3, 2, 1, 2)
    assert compiling.compile_recipes(episodes.limit(0)).count() == 0
    # The order of rows does not matter, only their positions.
    assert compiling.compile_recipes(episodes.orderBy(F.desc("id"))).first().recipe_id == r.recipe_id


DIFF = "--- a/src/api/q.ts\n+++ b/src/api/q.ts\n@@ -1,1 +10,1 @@\n+{}\n"


def test_rejected_code_finds_its_recipe_and_accepted_code_does_not(spark, episodes):
    recipes = compiling.compile_recipes(episodes, as_of=datetime(2025, 4, 1))
    ask = lambda code: retrieve.suggest(retrieve.hunks_of(spark, DIFF.format(code)), recipes, episodes, datetime(2025, 4, 1)).collect()
    got = ask("const result = fetch(url, options);")
    assert [(r.rank, r.path, r.start_line, r.confidence, len(r.evidence)) for r in got] == [(1, "src/api/q.ts", 10, "high", 2)]
    assert got[0].patch.startswith("--- a/src/api/q.ts\n+++ b/src/api/q.ts\n@@ -10,1 +10,1 @@\n-const result = fetch")
    assert got[0].evidence[0].comment_url == "https://github.com/a/b/pull/1#discussion_c1"
    days = (datetime(2025, 4, 1) - datetime(2025, 3, 1)).days
    assert got[0].score == pytest.approx(0.35 + 0.25 * 0.85 + 0.2 * 0.5 + 0.1 * (1 - days / 365) + 0.1)
    assert ask("const result = client.get(url, options);") == []
    assert ask("import zebra from 'zoo';") == []
    other = retrieve.hunks_of(spark, files=[("lib/q.ts", "const result = fetch(url, options);")])
    assert retrieve.suggest(other, recipes, episodes, datetime(2025, 4, 1)).count() == 0
    with pytest.raises(InvalidDiff):
        retrieve.hunks_of(spark, " ")


def test_browse_explain_suppress(spark, episodes):
    recipes = compiling.compile_recipes(episodes, allow_single_high=True)
    assert [r.total_matched for r in retrieve.list_recipes(recipes).collect()] == [2, 2]
    assert [(r.total_matched, r.truncated) for r in retrieve.list_recipes(recipes, limit=1).collect()] == [(2, True)]
    assert retrieve.list_recipes(recipes, path="src/api").count() == 2 and retrieve.list_recipes(recipes, path="lib").count() == 0
    assert retrieve.list_recipes(recipes, language="TypeScript").count() == 2 and retrieve.list_recipes(recipes, language="go").count() == 0
    assert retrieve.list_recipes(recipes, words="CLIENT.get").count() == 1
    rid = retrieve.list_recipes(recipes, limit=1).first().recipe_id
    assert [r.episode_id for r in retrieve.explain(recipes, episodes, rid).collect()] == ["e1", "e2"]
    with pytest.raises(NotFound):
        retrieve.explain(recipes, episodes, "rcp_none")
    none = spark.createDataFrame([], "recipe_id string")
    some = retrieve.set_suppressed(none, rid)
    assert retrieve.visible(recipes, some).count() == 1 and retrieve.visible(recipes, retrieve.set_suppressed(some, rid, False)).count() == 2
    assert retrieve.high_support(retrieve.suggest(retrieve.hunks_of(spark, DIFF.format("const result = fetch(url, options);")), recipes, episodes, datetime(2025, 4, 1))).count() == 1


def test_budget(spark):
    df = spark.createDataFrame([(i, "é" * 10_000) for i in range(5)], "recipe_order long, text string")
    kept = retrieve.within_budget(df, [F.col("recipe_order")])
    assert kept.count() == 1
    assert retrieve.within_budget(df, [F.col("recipe_order")], 2).count() == 0


def test_freshness(spark, episodes):
    d = lambda n: datetime(2025, 1, n)
    c = spark.createDataFrame([("a", None, d(2), None), ("b", None, d(3), d(2)), ("c", d(4), d(1), d(2)), ("d", d(1), d(1), d(2)), ("e", None, None, None)], "repo string, ingest_at timestamp, link_at timestamp, compile_at timestamp")
    got = {r.repo: (r.stale, (r.reason or "")[:4], r.banner is None) for r in retrieve.freshness(c, episodes, spark.createDataFrame([], "repo string")).collect()}
    assert got == {"a": (True, "Epis", False), "b": (True, "Link", False), "c": (True, "New ", False), "d": (False, "", True), "e": (False, "", True)}


def test_positions(spark):
    df = spark.createDataFrame([(i * 7919 % 1000, "x") for i in range(1000)], "a int, b string").repartition(7)
    got = with_positions(df, ["a"]).orderBy("a").collect()
    assert [r.pos for r in got] == list(range(1000))


def test_second_opinion(spark, episodes):
    calls = spark.sparkContext.accumulator(0)

    def scorer(comment, rejected, accepted):
        calls.add(1)
        return 'sure: {"addresses": true}' if "client" in accepted else None

    got = {r.id: (r.link_confidence, r.link_reason) for r in validate_medium(episodes, scorer).collect()}
    assert got["e2"] == ("high", "+validated") and got["e4"] == ("medium", "") and len(got) == 6 and calls.value == 1
    assert {r.id: r.link_confidence for r in validate_medium(episodes, lambda *a: False).collect()}["e2"] == "low"
    assert {r.id: r.link_confidence for r in validate_medium(episodes, lambda *a: 1 / 0).collect()}["e2"] == "medium"
    assert [answer_of(x) for x in ('{"addresses": false}', "none", "{bad}", '{"addresses": 1}', None)] == [False, None, None, None, None]
