"""Generated, minified or vendored source files (problem 1).

Four kinds of evidence set a row aside:

* its path, by common convention (lock files, minified bundles, code-generator suffixes, vendor and
  build folders) -- whole path segments and file-name endings, so ``src/generator`` or ``vendor_list.py``
  stay;
* a glob of its repository's ``paths.exclude``;
* its code: a generator's notice in a comment, a minified line, or a literal data blob;
* vendored copies: the code's token stream, with strings, numbers and white space normalised, is
  hashed in k-grams and winnowed (the smallest hash of every window is kept). A fingerprint counts
  for the owners in whose files *of the same name* it occurs; a file most of whose fingerprints
  recur like that among many unrelated owners is a vendored copy, and all its rows are set aside.
  The name is part of the key because the same few lines under different names are a repeated
  snippet that people wrote, not a copied file.

Fingerprints go through two aggregations with map-side combine -- (fingerprint, owner), then
owners per fingerprint -- so a repository that holds a third of all rows adds one owner, and no
list of files is ever collected.

Defined cases: a null path gives only code evidence, null code only path evidence, a null
repository has no globs; blank or null globs match nothing; rows with a null key are left out; rows
repeated in full give one result; empty tables give an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from revloom.session import materialize, table

#: Path segments whose content nobody writes by hand.
FOLDERS = "vendor third_party third-party thirdparty node_modules bower_components jspm_packages pods carthage godeps site-packages dist generated __generated__ autogenerated generated-sources __snapshots__ deriveddata".split()
#: File names of lock files.
LOCK_FILES = "package-lock.json npm-shrinkwrap.json packages.lock.json pnpm-lock.yaml go.sum go.work.sum bun.lockb gradle.lockfile package.resolved cartfile.resolved".split()
#: Endings that code generators, bundlers and minifiers give their files (Java regular expressions).
ENDINGS = [
    r"\.lock",
    r"[.-]min\.(?:js|mjs|cjs|css|html)",
    r"\.(?:bundle|chunk|packed|prod)\.(?:js|mjs|css)",
    r"[.-][0-9a-f]{8,32}(?:\.chunk|\.bundle)?\.(?:js|css)",
    r"\.(?:js|css|ts|mjs|cjs)\.map",
    r"\.pb\.(?:go|cc|h|swift|dart|gw\.go)",
    r"\.pb\.gw\.go",
    r"_pb2(?:_grpc)?\.pyi?",
    r"_pb\.(?:js|d\.ts|rb)",
    r"\.(?:g|freezed|gr|mocks|config)\.dart",
    r"\.designer\.(?:cs|vb)",
    r"\.g(?:\.i)?\.cs",
    r"[._-](?:generated|autogen|gen)\.[a-z]+",
    r"\.graphql\.ts",
    r"\.(?:tab|yy)\.(?:c|cc|cpp|h|hpp)",
    r"\.snap",
]
#: Whole file names or beginnings of them.
NAMES = [r"zz_generated[._].+", r"moc_.+\.(?:cpp|cc)", r"qrc_.+\.cpp", r"ui_.+\.h", r"lex\.yy\.c", r"bindata\.go"]

PATH_PATTERN = (
    r"(?:^|/)(?:" + "|".join(re.escape(x) for x in FOLDERS) + r")/.+"
    + r"|(?:^|/)(?:" + "|".join(re.escape(x) for x in LOCK_FILES) + r")$"
    + r"|(?:" + "|".join(ENDINGS) + r")$"
    + r"|(?:^|/)(?:" + "|".join(NAMES) + r")$"
)

#: A generator's notice in a comment.
NOTICE = (
    r"(?im)^[+\- ]?\s*(?:/[/*]+|#+|\*+|--+|;+|<!--|\"\"\"|'''|%+)[^\n]*?"
    r"(?:@generated\b|<auto-?generated|\bauto-?generated\b|\bautomatically (?:generated|produced|created)\b|\b(?:code|file|source) (?:is |was )?generated (?:by|from|with)\b"
    r"|\bgenerated by\b[^\n]*\bdo not (?:edit|modify|change)\b|\bdo not (?:edit|modify|change)\b[^\n]*\b(?:generated|by hand|manually)\b|\bmanual (?:changes|edits) will be (?:lost|overwritten)\b)"
)
#: A line that is nothing but literal data: numbers with commas between, or one long base64 or hex string.
NUMBER_LINE = r"^[+\- ]?[ \t]*-?(?:0x|\d)[-0-9a-fA-FxX., \t]{8,}[\])};]*\s*$"
STRING_LINE = r"^[+\- ]?[ \t]*[rbu]?[\"'][A-Za-z0-9+/=]{60,}[\"']\s*[+,;.)\\\]]*\s*$"
DATA_LINES = 4
MINIFIED_LINE = 400
#: Winnowing: tokens per k-gram, k-grams per window.
K, WINDOW = 8, 12
#: Unrelated owners that make a fingerprint widely copied; share of a file's fingerprints that must be; fingerprints a file must have.
OWNERS, SHARE, LEAST = 5, 0.8, 4

_TOKEN = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`|[A-Za-z_$][\w$]*|\d[\w.]*|[^\s\w]")


def clean_path(path: Column) -> Column:
    """``path`` with forward slashes and without a leading ``./`` or ``/``."""
    return F.regexp_replace(F.translate(F.trim(path), "\\", "/"), r"^(?:\./|/)+", "")


def path_is_conventional(path: Column) -> Column:
    return F.coalesce(F.lower(clean_path(path)).rlike(PATH_PATTERN), F.lit(False))


def glob_regex(glob: Column) -> Column:
    """An anchored regular expression for one glob; null for blank ones.

    ``**/`` is any number of folders, ``**`` anything, ``*`` and ``?`` stay within a segment, and a
    glob that ends in ``/`` covers the folder.
    """
    g = F.regexp_replace(F.translate(F.trim(glob), "\\", "/"), r"^(?:\./|/)+", "")
    g = F.regexp_replace(g, r"/$", "/**")
    e = F.regexp_replace(g, r"([.+^$()|\[\]{}])", r"\\$1")
    e = F.regexp_replace(e, r"\*\*/", "\u0001")
    e = F.regexp_replace(e, r"\*\*", "\u0002")
    e = F.regexp_replace(e, r"\*", "[^/]*")
    e = F.regexp_replace(e, r"\?", "[^/]")
    e = F.regexp_replace(F.regexp_replace(e, "\u0001", "(?:[^/]+/)*"), "\u0002", ".*")
    return F.when(g != "", e)


def repo_globs(config: DataFrame) -> DataFrame:
    """(repo, glob): one regular expression for all exclude globs of each repository."""
    return (
        config.select("repo", F.explode("paths.exclude").alias("g"))
        .select("repo", glob_regex(F.col("g")).alias("g"))
        .filter("repo is not null and g is not null")
        .groupBy("repo")
        .agg(F.concat(F.lit("^(?:"), F.array_join(F.array_sort(F.collect_set("g")), "|"), F.lit(")$")).alias("glob"))
    )


def is_data_line(line: Column) -> Column:
    return line.rlike(STRING_LINE) | (line.rlike(NUMBER_LINE) & (F.size(F.split(line, ",")) >= 4))


def is_minified_line(line: Column) -> Column:
    n = F.length(line)
    return (n >= MINIFIED_LINE) & (F.length(F.regexp_replace(line, r"[\s\w]", "")) > 0.12 * n) & (F.length(F.regexp_replace(line, r"\s", "")) > 0.9 * n)


def code_shows_it(code: Column) -> Column:
    """Whether code bears a generator's notice, a minified line or a block of literal data."""
    lines = F.split(code, "\n")
    # The body of a key or certificate is no data blob; what stands around it may be one.
    free = F.when(code.contains("-----BEGIN "), F.regexp_replace(code, r"(?s)-----BEGIN [^-\n]+-----.*?(?:-----END [^-\n]+-----|\z)", "")).otherwise(code)
    blob = F.size(F.filter(F.split(free, "\n"), is_data_line)) >= DATA_LINES
    return F.coalesce(code.rlike(NOTICE) | F.exists(lines, is_minified_line) | blob, F.lit(False))


def fingerprints(rows: DataFrame, named: bool = True) -> DataFrame:
    """(fp, owner, file): the distinct winnowed fingerprints of each row's code, keyed with the file's name.

    ``rows`` has repo, path and code. ``fp`` combines the hash of a k-gram with that of the file name,
    if it is ``named``.
    """

    def run(batches):
        import xxhash

        h64 = xxhash.xxh3_64_intdigest
        salt = np.array([pow(0x9E3779B97F4A7C15, j, 2**64) for j in range(K)], dtype=np.uint64)
        for b in batches:
            cache: dict[str, int] = {}
            ids, lens = [], []
            for code in b.column("code").to_pylist():
                toks = _TOKEN.findall("\n".join(x[1:] if x[:1] in "+-" else x for x in code.split("\n") if not x.startswith("@@"))) if code else []
                for t in toks:
                    v = cache.get(t)
                    if v is None:
                        c = t[0]
                        v = cache[t] = h64("S" if c in "\"'`" else "N" if c.isdigit() else t)
                    ids.append(v)
                lens.append(len(toks))
            n = len(ids)
            if n < K:
                continue
            tok = np.array(ids, dtype=np.uint64)
            row = np.repeat(np.arange(len(lens)), lens)
            grams = n - K + 1
            h = np.zeros(grams, dtype=np.uint64)
            for j in range(K):
                h = h + tok[j : j + grams] * salt[j]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
            whole = row[:grams] == row[K - 1 :]
            h[~whole] = np.iinfo(np.uint64).max
            # The smallest gram of every window; short codes have one window.
            low = h.copy()
            for j in range(1, WINDOW):
                low[: grams - j] = np.where(row[: grams - j] == row[j:grams], np.minimum(low[: grams - j], h[j:grams]), low[: grams - j])
            pairs = np.unique(np.stack([row[:grams][whole].astype(np.uint64), low[whole]]), axis=1)
            r = pairs[0].astype(np.int64)
            cols = [b.column(c).to_numpy(zero_copy_only=False) for c in ("name", "owner", "file")]
            fp = pairs[1].view(np.int64) ^ (cols[0][r] if named else 0)
            yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array(cols[1][r]), pa.array(cols[2][r])], names=["fp", "owner", "file"])

    p = F.lower(clean_path(F.col("path")))
    keyed = rows.filter("code is not null and path is not null and repo is not null").select(
        "code", F.xxhash64(F.element_at(F.split(p, "/"), -1)).alias("name"), F.xxhash64(F.split("repo", "/")[0]).alias("owner"), file_key().alias("file")
    )
    return keyed.mapInArrow(run, "fp bigint, owner bigint, file bigint")


def file_key() -> Column:
    return F.xxhash64("repo", F.lower(clean_path(F.col("path"))))


def vendored_files(rows: DataFrame, owners: int = OWNERS, share: float = SHARE, least: int = LEAST, named: bool = True) -> DataFrame:
    """(file) of the files most of whose fingerprints recur among ``owners`` or more owners; under the same name, unless ``named`` is off."""
    prints = materialize(fingerprints(rows, named).distinct(), "prints")
    wide = prints.select("fp", "owner").distinct().groupBy("fp").agg(F.count("*").alias("owners")).filter(F.col("owners") >= owners).select("fp")
    hits = prints.join(wide, "fp").groupBy("file").agg(F.count("*").alias("wide"))
    totals = prints.join(hits.select("file"), "file", "left_semi").groupBy("file").agg(F.count("*").alias("total"))
    return totals.join(hits, "file").filter((F.col("total") >= least) & (F.col("wide") >= share * F.col("total"))).select("file")


def set_aside(rows: DataFrame, config: DataFrame) -> DataFrame:
    """(src_table, src_key, reason) of the rows of ``rows`` (src_table, src_key, repo, path, code) to leave aside."""
    rows = rows.select("src_table", "src_key", "repo", "path", "code").filter("src_key is not null")
    globbed = rows.join(repo_globs(config), "repo", "left")
    reason = (
        F.when(path_is_conventional(F.col("path")), "path")
        .when(F.coalesce(F.rlike(clean_path(F.col("path")), F.col("glob")), F.lit(False)), "glob")
        .when(code_shows_it(F.col("code")), "code")
    )
    told = globbed.select("src_table", "src_key", reason.alias("reason")).filter("reason is not null")
    copies = rows.withColumn("file", file_key()).join(vendored_files(rows), "file", "left_semi").select("src_table", "src_key", F.lit("vendored copy").alias("reason"))
    return told.unionByName(copies).groupBy("src_table", "src_key").agg(F.min("reason").alias("reason"))


def source_rows(spark, sf_dir: str) -> DataFrame:
    episodes, raw = table(spark, sf_dir, "episodes"), table(spark, sf_dir, "pull_review_comments")
    return episodes.select(F.lit("episodes").alias("src_table"), F.col("id").alias("src_key"), "repo", "path", F.col("rejected.text").alias("code")).unionByName(
        raw.select(F.lit("pull_review_comments").alias("src_table"), F.col("delivery_id").cast("string").alias("src_key"), "repo", "path", F.col("diff_hunk").alias("code"))
    )


def p1_found(spark, sf_dir: str) -> DataFrame:
    return set_aside(source_rows(spark, sf_dir), table(spark, sf_dir, "config")).select("src_table", "src_key")


def p1_reasons(spark, sf_dir: str) -> DataFrame:
    """Rows set aside per table and kind of evidence."""
    return set_aside(source_rows(spark, sf_dir), table(spark, sf_dir, "config")).groupBy("src_table", "reason").agg(F.count("*").alias("n_rows"))
