import pytest
from pyspark.sql import functions as F

from revloom.llm import handwritten as H

GENERATED = ["yarn.lock", "a/package-lock.json", "go.sum", "x/app.min.js", "public/a.3f2a9c1d.chunk.js", "a/b.pb.go", "x_pb2.py", "m/x.g.dart", "f/A.Designer.cs", "vendor/x/y.go", "./third-party/a/b.c", "Vendor\\a\\b.cs", "node_modules/x/i.js", "a/dist/x.js", "src/generated/a.ts", "zz_generated.deepcopy.go", "a/lex.yy.c", "p/x_generated.go", "a/__snapshots__/b.snap", "js/a.js.map"]
WRITTEN = ["src/generator/a.ts", "src/vendors/vendor_list.py", "lib/min/a.js", "src/distribution/x.go", "src/lockfile/lock_ttl.py", "tools/codegen-lint/generated_at.py", "app/min_max.ts", "lib/unlock.py", "packages/bundle/src/bundle.ts", "src/clock.ts", "vendor.ts", None, ""]


def test_paths(spark):
    df = spark.createDataFrame([(p,) for p in GENERATED + WRITTEN], "p string")
    got = {r.p for r in df.filter(H.path_is_conventional(F.col("p"))).collect()}
    assert got == set(GENERATED)


@pytest.mark.parametrize(
    "glob, yes, no",
    [
        ("**/*.lock", ["a.lock", "x/y/b.lock"], ["a.lock.ts"]),
        ("./web/baked/**", ["web/baked/a.ts", "./web/baked/x/y.js"], ["src/web/baked/a.ts", "web/baked"]),
        (" /sdk/imported/ ", ["sdk/imported/a"], ["sdk/imported.ts"]),
        ("**/ui/kit/**", ["ui/kit/a", "p/ui/kit/b"], ["ui/kits/a"]),
        ("*.rpc.java", ["a.rpc.java"], ["x/a.rpc.java", "axrpc.java"]),
        ("a(b)+[c]?.ts", ["a(b)+[c]x.ts"], ["abc.ts"]),
    ],
)
def test_globs(spark, glob, yes, no):
    df = spark.createDataFrame([(glob, p) for p in yes + no], "g string, p string")
    match = F.rlike(H.clean_path(F.col("p")), F.concat(F.lit("^(?:"), H.glob_regex(F.col("g")), F.lit(")$")))
    assert [r.p for r in df.filter(match).collect()] == yes


MINI = "!function(e,t){" + "var a=t.x(1,2);e.y?b():void 0;" * 30
BLOB = "const t = [\n" + "\n".join("  0x12345678, 0x9abcdef0, 0x11223344, 0x55667788," for _ in range(6))
CODE = {
    "// Code generated by routegen v1. DO NOT EDIT.\nx": True,
    "+# <auto-generated> tool=x </auto-generated>": True,
    "// @generated from a.idl": True,
    "// This file was automatically produced by x; manual changes will be lost.": True,
    'x = "do not edit, generated by hand"': False,
    "# the report is generated weekly": False,
    MINI: True,
    "-" + MINI: True,
    BLOB: True,
    "b = (\n" + "\n".join('+  "' + "aB3/" * 18 + '"' for _ in range(5)): True,
    "k = (\n-----BEGIN PRIVATE KEY-----\nMIIEaaaa\n-----END PRIVATE KEY-----\n)\nd = [\n" + "\n".join('"' + "aB3/" * 18 + '",' for _ in range(9)) + "\n]": True,
    "k = (\n-----BEGIN PRIVATE KEY-----\n" + "\n".join('"' + "aB3/" * 18 + '"' for _ in range(5)): False,
    "f(1, 2, 3, 4)\nf(1, 2, 3, 4)\nf(1, 2, 3, 4)\nf(1, 2, 3, 4)": False,
    "x = [" + "1, " * 200_000 + "]": False,
    "": False,
    "a " * 300_000: False,
}


def test_code(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate([*CODE, None])], "i int, c string")
    got = [r.y for r in df.select("i", H.code_shows_it(F.col("c")).alias("y")).orderBy("i").collect()]
    assert got == [*CODE.values(), False]


def file_of(n, base):
    return "\n".join(f"{base}_{i}({base}_{i + 1}, {n if i == 0 else i}, 'text {n}')" for i in range(30))


ROW = "src_table string, src_key string, repo string, path string, code string"
CONFIG = "repo string, paths struct<include: array<string>, exclude: array<string>>"


def test_vendored_copies(spark):
    rows = []
    for o in range(12):
        rows.append(("t", f"copy{o}", f"owner{o}/r", f"lib{o}/left_pad.js", file_of(0, "pad")))
        rows.append(("t", f"snippet{o}", f"owner{o}/r", f"src/own{o}.js", file_of(0, "shared")))
        rows.append(("t", f"own{o}", f"owner{o}/r", "src/index.js", file_of(o, f"n{o}")))
        rows.append(("t", f"forks{o}", f"one/r{o}", "src/fork.js", file_of(0, "fork")))
    rows += rows[:3] + [("t", "nulls", None, None, None), ("t", None, "owner1/r", "yarn.lock", "x"), ("t", "short", "a/b", "c.ts", "x"), ("t", "empty", "a/b", "c.ts", "")]
    config = spark.createDataFrame([("a/b", (None, ["", None, " "])), ("c/d", None), (None, (None, ["**"]))], CONFIG)
    df = spark.createDataFrame(rows, ROW).withColumn("glob", F.lit("x")).withColumn("file", F.lit(1)).withColumn("reason", F.lit(2))
    got = H.set_aside(df, config).collect()
    assert {r.src_key for r in got} == {f"copy{o}" for o in range(12)} and len(got) == 12
    assert {r.reason for r in got} == {"vendored copy"}
    assert H.set_aside(df.limit(0), config.limit(0)).count() == 0


def test_reasons(spark):
    rows = [("t", "g", "a/b", "web/x.ts", "y"), ("t", "n", "c/d", "web/x.ts", "y"), ("t", "p", None, "yarn.lock", None), ("t", "c", None, None, "// @generated")]
    config = spark.createDataFrame([("a/b", (None, ["./web/**"]))], CONFIG)
    assert {(r.src_key, r.reason) for r in H.set_aside(spark.createDataFrame(rows, ROW), config).collect()} == {("g", "glob"), ("p", "path"), ("c", "code")}


def test_renamed_copies_are_an_option(spark):
    code = "\n".join(f"function part{i}(a, b) {{ return helper{i}(a + {i}, b * left{i}); }}" for i in range(12))
    rows = spark.createDataFrame([(f"own{i}/r", f"src/name{i}.ts", code) for i in range(6)] + [("own9/r", "src/other.ts", code.replace("function", "export const"))], "repo string, path string, code string")
    assert H.vendored_files(rows).count() == 0
    assert H.vendored_files(rows, named=False).count() >= 6
