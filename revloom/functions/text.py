"""Column functions over code and comment text.

Patterns use explicit ASCII boundaries, because Java's word boundary follows Unicode and the
results must not depend on accents around a match.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_LEFT, _RIGHT = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"

# What is masked before text is stored, in this order.
REDACTIONS = [
    (r"ghp_[A-Za-z0-9]{20,}", "ghp_[REDACTED]"),
    (r"gho_[A-Za-z0-9]{20,}", "gho_[REDACTED]"),
    (r"github_pat_[A-Za-z0-9_]{20,}", "github_pat_[REDACTED]"),
    (r"sk-[A-Za-z0-9]{20,}", "sk-[REDACTED]"),
    (r"AKIA[0-9A-Z]{16}", "AKIA[REDACTED]"),
    (r"(?s)-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----.*?-----END (?:RSA |EC |OPENSSH )?PRIVATE KEY-----", "[REDACTED_PRIVATE_KEY]"),
    (r"(?i)((?:api[_-]?key|token|secret|password|passwd|auth)\s*[=:]\s*['\"]?)[A-Za-z0-9_\-./+=]{8,}", "$1[REDACTED]"),
]

# Words that say nothing about the code a comment is about.
COMMENT_STOP_WORDS = "the a an to of and or in on for is be this that please use here over with from should would could we you it as at by not do does did if then than into our your can will just also more some any all no yes ok nit nits".split()
# Words that are no title.
TITLE_STOP_WORDS = "a an and are as at be before by for from has have in is it its of on or please the this to use with you your we should can instead rather just also that these those not no do does did was were will would could may might must need needs add make sure".split()
# Languages by file extension.
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "py": "python", "go": "go", "rs": "rust", "java": "java", "kt": "kotlin", "rb": "ruby", "php": "php", "cs": "csharp",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "c": "c", "h": "c", "hpp": "cpp", "swift": "swift", "scala": "scala",
    "sh": "shell", "bash": "shell", "zsh": "shell", "sql": "sql", "md": "markdown", "json": "json", "yml": "yaml", "yaml": "yaml",
}

#: String literals; the loops run over whole stretches between escapes, so long literals need no deep stack.
STRINGS = r"\"[^\"\\]*+(?:\\.[^\"\\]*+)*+\"|'[^'\\]*+(?:\\.[^'\\]*+)*+'|`[^`\\]*+(?:\\.[^`\\]*+)*+`"
NUMBERS = _LEFT + r"\d+(?:\.\d+)?" + _RIGHT
#: Short lower-case names that are no keyword of three letters or fewer.
LOCALS = _LEFT + r"(?!(?:for|if|in|let|new|try|var)" + _RIGHT + r")[a-z_][a-z0-9_]{0,2}" + _RIGHT
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*"


def trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _per_line(text: Column, f) -> Column:
    return F.array_join(F.transform(F.split(text, "\n"), f), "\n")


def redact(text: Column) -> Column:
    """``text`` with everything that looks like a secret replaced; null stays null."""
    for pattern, by in REDACTIONS:
        text = F.regexp_replace(text, pattern, by)
    return text


def is_redactable(text: Column) -> Column:
    found = F.lit(False)
    for pattern, _ in REDACTIONS:
        found = found | text.rlike(pattern)
    return found


def normalize_span(text: Column) -> Column:
    """Code with strings as S and numbers as N and no white space, line by line."""
    return _per_line(text, lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(trim(x), STRINGS, "S"), NUMBERS, "N"), r"\s+", ""))


def normalize_cluster(text: Column, mask_locals: bool = True) -> Column:
    """Code with strings as S, numbers as N, short local names as V and single spaces, line by line."""

    def line(x):
        x = F.regexp_replace(F.regexp_replace(trim(x), STRINGS, "S"), NUMBERS, "N")
        if mask_locals:
            x = F.regexp_replace(x, LOCALS, "V")
        return trim(F.regexp_replace(x, r"\s+", " "))

    return trim(_per_line(text, line))


def normal_hash(text: Column) -> Column:
    return F.sha2(normalize_cluster(text), 256)


def name_set(text: Column) -> Column:
    """The distinct names in a text, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets: 1 if both are empty, 0 if one is."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def length_ratio(a: Column, b: Column) -> Column:
    """Of two lengths: the smaller by the larger; 1 if both are zero."""
    return F.when((a == 0) & (b == 0), 1.0).otherwise(F.least(a, b) / F.greatest(a, b))


def similarity(names_a: Column, names_b: Column, len_a: Column, len_b: Column) -> Column:
    """Half the overlap of names and half the ratio of lengths."""
    return F.lit(0.5) * jaccard(names_a, names_b) + F.lit(0.5) * length_ratio(len_a, len_b)


def before_signals(text: Column, limit: int = 12) -> Column:
    """What tells rejected code: its lines, then its dotted names, each at least four long."""
    lines = F.filter(F.transform(F.split(text, "\n"), trim), lambda x: (F.length(x) >= 4) & x.rlike("[A-Za-z0-9]"))
    names = F.filter(F.regexp_extract_all(text, F.lit(r"[A-Za-z_][A-Za-z0-9_.]*"), F.lit(0)), lambda x: (F.length(x) >= 4) & ~x.rlike("^_+$"))
    return F.slice(F.array_distinct(F.concat(lines, names)), 1, limit)


def top_segment(path: Column) -> Column:
    return F.coalesce(F.get(F.filter(F.split(path, "/"), lambda x: x != ""), F.lit(0)), F.lit(""))


def language_of(path: Column) -> Column:
    """A coarse language by the extension; null for none, unknown ones and files that begin with their only dot."""
    base = F.element_at(F.split(path, r"[/\\]"), -1)
    ext = F.lower(F.regexp_extract(base, r"^.+\.([^.]*)$", 1))
    pairs = [F.lit(x) for kv in LANGUAGES.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), ext)


def comment_keywords(body: Column) -> Column:
    """The words of a comment outside code fences, without stop words, in order of appearance."""
    plain = F.lower(F.regexp_replace(body, r"(?s)```.*?```", " "))
    words = F.array_distinct(F.regexp_extract_all(plain, F.lit(r"[a-z][a-z0-9_]{2,}"), F.lit(0)))
    return F.array_except(words, F.array(*map(F.lit, COMMENT_STOP_WORDS)))


def title_words(body: Column) -> Column:
    """The words of a comment that may make a title, repeats kept."""
    words = F.split(F.regexp_replace(F.lower(body), r"[^a-z0-9\s_-]", " "), r"\s+")
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*TITLE_STOP_WORDS))


def suggestion_block(body: Column) -> Column:
    """The first suggested change in a comment, without one last line break; null for none."""
    pattern = r"(?is)```suggestion[^\n]*\r?\n(.*?)```"
    return F.when(body.rlike(pattern), F.regexp_replace(F.regexp_extract(body, pattern, 1), r"\r?\n\z", ""))


def blob_lines(text: Column) -> Column:
    """The lines of a file: none for an empty text, and no last line behind a final line break."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, r"\n\z", ""), "\n"))


def comment_side(side: Column) -> Column:
    s = F.upper(trim(side.cast("string")))
    return F.when(s.isin("LEFT", "L"), "LEFT").when(s.isin("RIGHT", "R"), "RIGHT")


def body_preview(body: Column, most: int = 160) -> Column:
    s = trim(F.regexp_replace(body, r"\s+", " "))
    return F.when(F.length(s) <= most, s).otherwise(F.concat(F.substring(s, 1, most - 1), F.lit("…")))


def truncated_code(text: Column, most: int = 40) -> Column:
    lines = F.split(text, "\n")
    return F.when(F.size(lines) <= most, text).otherwise(F.concat(F.array_join(F.slice(lines, 1, most), "\n"), F.lit("\n… ("), (F.size(lines) - most).cast("string"), F.lit(" more lines)")))


def confidence_score(label: Column) -> Column:
    return F.when(label == "high", 1.0).when(label == "medium", 0.7).when(label == "low", 0.3).otherwise(0.0)


def confidence_label(avg: Column) -> Column:
    return F.when(avg >= 0.85, "high").when(avg >= 0.6, "medium").otherwise("low")


def episode_id(repo: Column, comment_id: Column) -> Column:
    return F.concat(F.lit("ep_"), F.substring(F.sha2(F.concat(trim(repo), F.lit("\x00"), trim(comment_id)), 256), 1, 16))


def recipe_id(repo: Column, episode_ids: Column) -> Column:
    return F.concat(F.lit("rcp_"), F.substring(F.sha2(F.concat(repo, F.lit("\x00"), F.array_join(F.array_sort(episode_ids), "\x00")), 256), 1, 16))


def run_id(repo: Column, iso_time: Column) -> Column:
    return F.concat(F.lit("compile_"), F.substring(F.sha2(F.concat(repo, F.lit("\x00"), iso_time), 256), 1, 12))


def evidence_url(repo: Column, pr_number: Column, comment_id: Column) -> Column:
    return F.concat(F.lit("https://github.com/"), repo, F.lit("/pull/"), pr_number.cast("string"), F.lit("#discussion_"), comment_id)


def common_folder(min_path: Column, max_path: Column, first_path: Column) -> Column:
    """The folders all paths share, as one prefix with a slash; else the top segment of the first path; none for none.

    The least and the greatest of the paths' segment arrays (file names dropped) share what all share.
    """
    a, b = (F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))) for p in (min_path, max_path))
    alike = F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda z: z["a"].eqNullSafe(z["b"]))
    n = F.when(F.array_position(alike, F.lit(False)) > 0, F.array_position(alike, F.lit(False)) - 1).otherwise(F.size(alike)).cast("int")
    shared = F.slice(a, 1, n)
    top = top_segment(first_path)
    return F.when(F.size(shared) > 0, F.array(F.concat(F.array_join(shared, "/"), F.lit("/")))).when(top != "", F.array(top)).otherwise(F.array().cast("array<string>"))
