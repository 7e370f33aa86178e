import base64
import io
import json
import os
import urllib.error
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from revloom import config as C, session
from revloom.__main__ import parser, run
from revloom.api import Engine
from revloom.errors import AccessFailed, Forbidden, InvalidInput, NoData, NotFound
from revloom.plans import ingest
from revloom.sources import rest, store
from revloom.streaming import merges


def pull(n, **over):
    return {"id": n, "node_id": f"PR_{n}", "number": n, "state": "closed", "title": f"t{n}", "html_url": f"https://forge.example/a/b/pull/{n}", "merged_at": f"2025-01-{n % 28 + 1:02d}T00:00:00Z", "merge_commit_sha": f"sha{n}", "draft": False, "base": {"ref": "main"}, "head": {"ref": "x"}, "updated_at": "2025-02-01T00:00:00Z"} | over


def comment(i, n, **over):
    return {"id": i, "node_id": f"C_{i}", "body": "please use the client here", "path": "src/api/x.ts", "diff_hunk": "@@ -1,1 +1,2 @@\n ctx\n+const result = fetch(url, options);", "line": 2, "original_line": 2, "side": "RIGHT", "commit_id": "c", "user": {"login": "ann"}, "created_at": "2025-01-01T00:00:00Z", "html_url": "u", "pull_request_url": f"https://api.forge.example/repos/a/b/pulls/{n}"} | over


@pytest.fixture
def pages(tmp_path):
    os.makedirs(tmp_path / "pulls")
    os.makedirs(tmp_path / "comments")
    first = [pull(n) for n in range(1, 96)] + [pull(96, draft=True), pull(97, merged_at=None), pull(98, merge_commit_sha=""), pull(99), pull(100)]
    (tmp_path / "pulls" / "page-1.json").write_text(json.dumps(first))
    (tmp_path / "pulls" / "page-2.json").write_text(json.dumps([pull(101)]))
    (tmp_path / "comments" / "1.json").write_text(json.dumps([comment(1, 1), comment(2, 1, user=None, body="token = abcdefgh1234", side=1)]))
    return str(tmp_path)


def test_pages(spark, pages):
    spark.dataSource.register(rest.ForgePages)
    read = lambda **o: spark.read.format("forge_pages").options(path=pages, repo="a/b", **o).load()
    assert read().count() == 101
    assert ingest.pull_rows(read()).count() == 98
    assert ingest.pull_rows(read(max_prs="3")).count() == 3
    assert ingest.pull_rows(read(), datetime(2025, 1, 27)).agg(F.min("merged_at")).first()[0] == datetime(2025, 1, 28)
    assert ingest.watermark(ingest.pull_rows(read())).first().number == 83
    got = ingest.comment_rows(read(kind="comments", numbers="1,2")).orderBy("id").collect()
    assert [(r.id, r.pr_number, r.author, r.side, r.body[:8]) for r in got] == [("C_1", 1, "ann", "RIGHT", "please u"), ("C_2", 1, "ghost", "1", "token = ")]
    assert got[1].body == "token = [REDACTED]"


def test_retries():
    waits = []

    def opener(codes, headers=None):
        left = list(codes)

        def call(request):
            code = left.pop(0)
            if code == 200:
                return io.BytesIO(b'{"ok": 1}')
            raise urllib.error.HTTPError(request.full_url, code, "rate limit" if code == 403 else "x", headers or {}, None)

        return call

    get = lambda codes, headers=None: rest.fetch("http://x", None, 2, 100, opener(codes, headers), waits.append)
    assert get([502, 503, 200]) == {"ok": 1} and waits == [0.1, 0.2]
    assert get([404]) is None
    with pytest.raises(AccessFailed) as e:
        get([401])
    assert e.value.kind == "unauthorized" and e.value.exit_code == 3
    with pytest.raises(AccessFailed) as e:
        get([429, 429, 429], {"Retry-After": "3"})
    assert e.value.kind == "exhausted" and waits[-2:] == [3.0, 3.0]
    assert rest.delay_ms({"x-ratelimit-remaining": "0", "x-ratelimit-reset": "110"}, 0, now=100) == 10_000
    assert rest.is_retryable(403, {}, "API rate limit exceeded") and not rest.is_retryable(403, {}, "forbidden") and not rest.is_retryable(500, {})


def test_folders(spark, tmp_path):
    assert store.read_json_folder(spark, str(tmp_path / "none"), store.PR_JSON).count() == 0
    d = tmp_path / "prs"
    d.mkdir()
    (d / "1.json").write_text(json.dumps({"id": "p", "number": 1, "mergedAt": "2025-01-01T00:00:00Z", "unknown": 5}))
    (d / "2.json").write_text("{not json")
    with pytest.raises(Exception, match="2.json|[Mm]alformed"):
        store.read_json_folder(spark, str(d), store.PR_JSON).collect()
    assert {(r.file, r.problem) for r in store.violations(spark, str(d), store.PR_JSON, ["id", "title"]).collect()} == {("1.json", "title is missing"), ("2.json", "not readable")}
    (d / "2.json").unlink()
    assert [(r.id, r.number, r.merged_at) for r in store.read_json_folder(spark, str(d), store.PR_JSON).collect()] == [("p", 1, datetime(2025, 1, 1))]
    (tmp_path / "blobs").mkdir()
    (tmp_path / "blobs" / "abc.txt").write_text("l1\nl2\n")
    assert [tuple(r) for r in store.read_blobs(spark, str(tmp_path / "blobs")).collect()] == [("abc", "l1\nl2\n")]
    assert [tuple(r) for r in store.blob_shas(spark, str(tmp_path / "blobs")).collect()] == [("abc",)]
    (tmp_path / "i.json").write_text(json.dumps({"files": [{"ref": " r ", "path": "p", "sha": "s"}, {"ref": "", "path": "p", "sha": "s"}, 5]}))
    assert [tuple(r) for r in store.read_blob_index(spark, str(tmp_path / "i.json")).collect()] == [("r", "p", "s", 0)]
    (tmp_path / "i.json").write_text("nonsense")
    assert store.read_blob_index(spark, str(tmp_path / "i.json")).count() == 0


def test_stages_end_to_end(spark, pages, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("data"))
    e = Engine(spark, root, now=lambda: datetime(2025, 4, 1))
    first = e.ingest("a/b", path=pages)
    assert first["prs"] == first["prs_new"] == 98 and first["comments_new"] == 2
    again = e.ingest("a/b", path=pages)
    assert again["prs_new"] == 0 and e.store("a/b").read("prs").count() == 98
    done = e.link("a/b")
    assert done == {"episodes": 1, "medium_or_higher": 0, "discards": 1}  # the ghost counts as a bot
    assert e.freshness("a/b").first().reason.startswith("Episodes linked")
    assert e.compile("a/b")["recipes"] == 0
    assert not e.freshness("a/b").first().stale
    assert e.repos() == ["a/b"]
    with pytest.raises(NoData):
        e.recipes("c/d")
    with pytest.raises(InvalidInput):
        e.suggest("a/b")
    assert run(parser().parse_args(["--data", root, "list"]), e) == ["a/b"]
    assert run(parser().parse_args(["recipes", "a/b", "--limit", "3"]), e).count() == 0
    Engine(spark, root).store("c/d").set_cursors(ingest_at="x")
    assert e.purge("a/b") and not e.purge("a/b") and e.repos() == ["c/d"]
    with pytest.raises(Forbidden):
        Engine(spark, root, "c/d").link("a/b")


def test_config(tmp_path):
    assert C.repo_slug(" a/b ") == ("a", "b")
    for bad in ("a", "a/b/c", "../b", "a/..", "a/b c", ""):
        with pytest.raises(InvalidInput):
            C.repo_slug(bad)
    for bad in (["..", "x"], ["/etc"], ["a\x00"]):
        with pytest.raises(InvalidInput):
            C.scoped_path(str(tmp_path), "a/b", *bad)
    assert C.allow_list(" a/b , c/d") == {"a/b", "c/d"} and C.allow_list("") is None
    assert C.as_bool("Yes") and not C.as_bool("off") and C.as_positive("N", None, 4) == 4
    with pytest.raises(InvalidInput):
        C.as_positive("N", "0", 4)
    assert C.resolve(C.RepoConfig("a", "b"), {"REVLOOM_MIN_SUPPORT": "5"}).min_support == 5


def body(**over):
    return json.dumps({"action": "closed", "pull_request": {"merged": True, "number": 4}, "repository": {"full_name": "a/b", "name": "b", "owner": {"login": "a"}}} | over)


def test_merge_events(spark, tmp_path):
    bodies = [body(), body(repository={"name": "z", "owner": {"login": "a"}}), body(action="opened"), body(pull_request={"merged": False, "number": 1}), body(repository={"full_name": "bad slug"}), "nonsense", None]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string")
    assert [r.status for r in merges.statuses(df).orderBy("i").collect()] == [202, 202, 200, 200, 200, 400, 400]
    assert merges.signature_holds(b"x", None, None) and not merges.signature_holds(b"x", "sha256=0", "s")
    src, calls = str(tmp_path / "in"), []
    df.filter("body is not null").select("body").write.parquet(src)

    def broken(spark_, repo):
        calls.append(("link", repo))
        if repo == "a/z":
            raise ValueError("no")

    stages = [("ingest", lambda s, r: calls.append(("ingest", r))), ("link", broken), ("compile", lambda s, r: calls.append(("compile", r)))]
    stream = lambda: spark.readStream.schema("body string").parquet(src)
    merges.run_merges(stream(), str(tmp_path / "mark"), stages, str(tmp_path / "dead"))
    assert calls == [("ingest", "a/b"), ("link", "a/b"), ("compile", "a/b"), ("ingest", "a/z"), ("link", "a/z")]
    assert [(r.repo, r.stage) for r in spark.read.parquet(str(tmp_path / "dead")).collect()] == [("a/z", "link")]
    merges.run_merges(stream(), str(tmp_path / "mark"), stages, str(tmp_path / "dead"))
    assert len(calls) == 5


def test_scratch_tables_can_be_released(spark):
    kept = session.materialize(spark.range(5), "x")
    assert kept.count() == 5
    session.release(spark)
    assert not os.path.exists(kept.inputFiles()[0].removeprefix("file://"))


def contents(text, sha, **over):
    return {"type": "file", "encoding": "base64", "size": len(text), "name": "x.ts", "path": "src/api/x.ts", "content": base64.encodebytes(text.encode()).decode(), "sha": sha, "url": "u"} | over


def test_ingest_fetches_the_files_comments_are_on(spark, pages, tmp_path_factory):
    at = lambda ref: os.path.join(pages, "contents", ref, "src%2Fapi%2Fx.ts.json")
    for ref, answer in (("sha1", contents("ctx\nconst result = client.get(url, options);\n", "B2")), ("c", contents('ctx\nconst result = fetch(url, options);\ntoken = "abcdefgh1234"\n', "b1"))):
        os.makedirs(os.path.dirname(at(ref)))
        with open(at(ref), "w") as f:
            json.dump(answer, f)
    e = Engine(spark, str(tmp_path_factory.mktemp("data")), now=lambda: datetime(2025, 4, 1))
    done = e.ingest("a/b", path=pages)
    assert done["blobs"] == done["blobs_new"] == 2 and done["blob_index_new"] == 2
    stored = {r.sha: r.text for r in e.store("a/b").read("blobs").collect()}
    assert set(stored) == {"b1", "b2"} and "abcdefgh1234" not in stored["b1"]
    assert {(r.commit_ref, r.path, r.sha) for r in e.store("a/b").read("blob_index").collect()} == {("sha1", "src/api/x.ts", "b2"), ("c", "src/api/x.ts", "b1")}
    assert e.link("a/b") == {"episodes": 1, "medium_or_higher": 1, "discards": 1}
    assert e.store("a/b").read("episodes").first().accepted.text == "const result = client.get(url, options);"
    assert e.compile("a/b", min_support=1)["recipes"] == 1


def test_what_is_no_file_stops_ingest(spark, pages, tmp_path_factory):
    os.makedirs(os.path.join(pages, "contents", "sha1"))
    with open(os.path.join(pages, "contents", "sha1", "src%2Fapi%2Fx.ts.json"), "w") as f:
        json.dump([contents("x", "s")], f)
    e = Engine(spark, str(tmp_path_factory.mktemp("data")))
    with pytest.raises(Exception, match="a file was asked for"):
        e.ingest("a/b", path=pages)
    assert not e.store("a/b").exists("prs") and not e.store("a/b").cursors()
    asked = {"path": pages}
    assert rest.file_at(asked, "gone", "src/api/x.ts") is None
    os.makedirs(os.path.join(pages, "contents", "r"))
    with open(os.path.join(pages, "contents", "r", "a.json"), "w") as f:
        json.dump(contents("x", "s", encoding="none"), f)
    with pytest.raises(AccessFailed):
        rest.file_at(asked, "r", "a")


def test_shared_folder_is_needed_on_a_cluster(spark):
    class Unset:
        class conf:
            get = staticmethod(lambda k, d: d)

        class sparkContext:
            master = "spark://host:7077"

            class _jsc:
                sc = staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(lambda: type("N", (), {"isDefined": staticmethod(lambda: False)}))}))

    with pytest.raises(InvalidInput, match="spark.checkpoint.dir"):
        session.shared_dir(Unset)
    assert session.is_local("local[4]") and session.is_local("local") and not session.is_local("local-cluster[2,1,1024]")


def test_versions(spark, tmp_path):
    s = store.Store(spark, str(tmp_path), "a/b")
    for n in range(3):
        s.write("t", spark.range(n))
    assert s.read("t").count() == 2 and len(os.listdir(s.path("t"))) == 2
    os.makedirs(s.path("t", "3"))  # a write that broke off
    assert s.read("t").count() == 2
    s.write("t", s.read("t").limit(1))
    assert s.read("t").count() == 1
    s.set_cursors(a=1)
    s.set_cursors(b=2)
    assert s.cursors() == {"a": 1, "b": 2}
    with open(s.path("config.json"), "w") as f:
        json.dump({"compile": {"minSupport": 3, "allowSingleHighConfidence": True}, "backfill": {"maxPrs": 7, "since": None}, "paths": 4}, f)
    got = s.config()
    assert (got.min_support, got.allow_single_high_confidence, got.max_prs, got.since, got.include) == (3, True, 7, None, ["**/*"])


def put_contents(pages):
    for ref, answer in (("sha1", contents("ctx\nconst result = client.get(url, options);\n", "B2")), ("c", contents("ctx\nconst result = fetch(url, options);\n", "b1"))):
        at = os.path.join(pages, "contents", ref)
        os.makedirs(at)
        with open(os.path.join(at, "src%2Fapi%2Fx.ts.json"), "w") as f:
            json.dump(answer, f)


def test_events_run_the_stages_with_the_settings_of_a_repository(spark, pages, tmp_path_factory, tmp_path):
    put_contents(pages)
    root, came = str(tmp_path_factory.mktemp("data")), str(tmp_path / "in")
    os.makedirs(os.path.join(root, "repos", "a", "b"))
    with open(os.path.join(root, "repos", "a", "b", "config.json"), "w") as f:
        json.dump({"compile": {"minSupport": 1}, "backfill": {"maxPrs": 150}}, f)
    e = Engine(spark, root, "a/b", now=lambda: datetime(2025, 4, 1))
    spark.createDataFrame([(body(),), (body(repository={"full_name": "x/y"}),)], "body string").write.parquet(came)
    e.run_merge_events(spark.readStream.schema("body string").parquet(came), str(tmp_path / "mark"), str(tmp_path / "dead"), path=pages)
    assert [(r.repo, r.stage) for r in spark.read.parquet(str(tmp_path / "dead")).collect()] == [("x/y", "ingest")]
    assert e.store("a/b").read("recipe_index").count() == 1 and e.store("a/b").read("episode_index").count() == 1
    one = e.recipes("a/b").first()
    assert [r.id for r in e.episodes("a/b", [*one.episode_ids, "none"]).collect()] == one.episode_ids
    diff = "--- a/src/api/z.ts\n+++ b/src/api/z.ts\n@@ -4,1 +4,2 @@\n ctx\n+const result = fetch(url, options);\n"
    found = e.suggest("a/b", diff=diff, limit=0)
    assert [(r.recipe_id, r.path) for r in found.collect()] == [(one.recipe_id, "src/api/z.ts")]
    assert e.suggestion_warnings("a/b", found) == []
    assert e.preview_suggestion("a/b", one.recipe_id, diff=diff).first().patch.startswith("--- a/src/api/z.ts")
    nothing = e.suggest("a/b", code="pass", path="docs/readme.md")
    e.store("a/b").set_cursors(link_at="2025-05-01T00:00:00")
    assert e.suggestion_warnings("a/b", nothing) == ["⚠ STALE: Link watermark is newer than last compile; compile again.", "No recipe fits this code."]
    with pytest.raises(NotFound):
        e.preview_suggestion("a/b", "rcp_none", diff=diff)


def test_the_cursor_moves_pull_request_by_pull_request(spark, pages, tmp_path_factory):
    e, heard = Engine(spark, str(tmp_path_factory.mktemp("data"))), []
    e.ingest("a/b", max_prs=5, on_ingested=heard.append, path=pages)
    assert heard == sorted(heard, key=lambda n: (n % 28, n)) and len(heard) == 5
    assert e.store("a/b").cursors()["ingest_number"] == heard[-1]
