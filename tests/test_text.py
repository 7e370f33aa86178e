import re

import pytest
from pyspark.sql import functions as F

from revloom.functions import comments as C, text as T


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


CASES = [
    ("LGTM!", "a", "lgtm"),
    ("Looks good to me 👍", "a", "lgtm"),
    ("thx", "a", "thanks"),
    ("nice work 🎉", "a", "praise"),
    ("👍 🎉", "a", "emoji_only"),
    (":tada:", "a", "emoji_only"),
    ("???", "a", "emoji_only"),
    ("nit", "a", "non_actionable_nit"),
    ("nit: typo", "a", "non_actionable_nit"),
    ("nit: please extract this helper", "a", None),
    ("nitpicking aside, move this", "a", None),
    ("", "a", "too_short"),
    (None, "a", "too_short"),
    ("   ", "a", "too_short"),
    ("use map", "a", "too_short"),
    ("```\nx\n```", "a", None),
    ("please move this into the helper", "dependabot[bot]", "bot_author"),
    ("please move this into the helper", "Renovate-Bot", "bot_author"),
    ("please move this into the helper", "abbott", None),
    ("please move this into the helper", "", None),
    ("please move this into the helper", None, None),
]


def test_discard_reasons(spark):
    df = spark.createDataFrame([(i, b, a) for i, (b, a, _) in enumerate(CASES)], "i int, b string, a string")
    got = {r.i: r.r for r in df.select("i", C.discard_reason(F.col("b"), F.col("a")).alias("r")).collect()}
    assert [got[i] for i in range(len(CASES))] == [c[2] for c in CASES]


@pytest.mark.parametrize(
    "text, want",
    [
        ("a ghp_" + "A" * 24 + " b", "a ghp_[REDACTED] b"),
        ("AKIA" + "B" * 16, "AKIA[REDACTED]"),
        ("api_key = 'abcdefgh12'", "api_key = '[REDACTED]'"),
        ("-----BEGIN RSA PRIVATE KEY-----\nxx\n-----END RSA PRIVATE KEY-----!", "[REDACTED_PRIVATE_KEY]!"),
        ("token=short", "token=short"),
        ("", ""),
    ],
)
def test_redact(spark, text, want):
    assert one(spark, text, T.redact) == want
    assert one(spark, want, T.redact) == want
    assert one(spark, text, T.is_redactable) == (text != want)


def test_redact_null(spark):
    assert one(spark, None, T.redact) is None


def python_cluster(text):
    out = []
    for line in text.split("\n"):
        x = re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`", "S", line.strip())
        x = re.sub(r"\b\d+(?:\.\d+)?\b", "N", x, flags=re.A)
        x = re.sub(r"\b[a-z_][a-z0-9_]{0,2}\b", lambda m: m[0] if m[0] in ("for", "if", "in", "let", "new", "try", "var") else "V", x, flags=re.A)
        out.append(re.sub(r"\s+", " ", x, flags=re.A).strip())
    return "\n".join(out).strip()


@pytest.mark.parametrize("text", ["let a = 'x' + 12.5;\n  for (abc in é5) { }", "x.y(1,  2)", "", "`a ${b}` \"q\\\"r\"", "a1 22 3.5 é5 12.5a", "if new try var foo fo f_1 _"])
def test_normalize_cluster(spark, text):
    assert one(spark, text, T.normalize_cluster) == python_cluster(text)


def test_normalize_span(spark):
    assert one(spark, '  a = "x y" + 12\n b ', T.normalize_span) == "a=S+N\nb"


@pytest.mark.parametrize("path, lang, seg", [("a/b.d/x.Test.TSX", "typescript", "a"), (".env", None, ".env"), ("/x//y.py", "python", "x"), ("noext", None, "noext"), ("d\\e.CPP", "cpp", "d\\e.CPP"), ("", None, "")])
def test_paths(spark, path, lang, seg):
    assert (one(spark, path, T.language_of), one(spark, path, T.top_segment)) == (lang, seg)


@pytest.mark.parametrize(
    "paths, want",
    [(["a/b/x.py", "a/b/y.py"], ["a/b/"]), (["a/b/x.py", "a/c/x.py"], ["a/"]), (["a/x.py", "b/x.py"], ["a"]), (["x.py"], ["x.py"]), (["a/b/c.py", "a/b.py"], ["a/"]), (["a/b/c.py"], ["a/b/"])],
)
def test_common_folder(spark, paths, want):
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    s = F.split("p", "/")
    a = df.agg(F.min(s).alias("a"), F.max(s).alias("b"), F.first("p").alias("f"))
    assert a.select(T.common_folder(F.col("a"), F.col("b"), F.lit(paths[0])).alias("y")).first().y == want


def test_signals_and_keywords(spark):
    assert one(spark, "  foo.bar(x);\nab\n____\n", T.before_signals) == ["foo.bar(x);", "foo.bar"]
    assert one(spark, "\n".join(f"line{i}" for i in range(30)), lambda c: F.size(T.before_signals(c))) == 12
    assert one(spark, "Please use foo_bar over BAZ here ```code word```", T.comment_keywords) == ["foo_bar", "baz"]
    assert one(spark, "", T.before_signals) == []


@pytest.mark.parametrize("text, want", [("x ```suggestion\na\nb\n``` y", "a\nb"), ("```Suggestion extra\r\na\r\n```", "a"), ("```suggestion\n```", ""), ("```js\na\n```", None), ("", None)])
def test_suggestion(spark, text, want):
    assert one(spark, text, T.suggestion_block) == want


@pytest.mark.parametrize("a, b, want", [([], [], 1.0), (["x"], [], 0.0), (["x", "y"], ["y", "z"], 1 / 3)])
def test_jaccard(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    assert df.select(T.jaccard(F.col("a"), F.col("b")).alias("y")).first().y == pytest.approx(want)


def test_ids_and_labels(spark):
    assert spark.range(1).select(T.episode_id(F.lit(" acme/w "), F.lit("c1 "))).first()[0] == spark.range(1).select(T.episode_id(F.lit("acme/w"), F.lit("c1"))).first()[0]
    ids = spark.createDataFrame([(["b", "a"],), (["a", "b"],)], "x array<string>").select(T.recipe_id(F.lit("r"), F.col("x")).alias("y"))
    assert ids.distinct().count() == 1 and ids.first().y.startswith("rcp_")
    assert [one(spark, v, T.confidence_label, "double") for v in (0.85, 0.6, 0.59)] == ["high", "medium", "low"]
    assert one(spark, "a\nb\nc", lambda c: T.truncated_code(c, 2)) == "a\nb\n… (1 more lines)"
    assert one(spark, "x " * 100, lambda c: F.length(T.body_preview(c, 20))) == 20
    assert one(spark, "a\n", T.blob_lines) == ["a"] and one(spark, "", T.blob_lines) == [] and one(spark, "a\n\n", T.blob_lines) == ["a", ""]
