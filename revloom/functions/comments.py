"""Which review comments ask for something."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from revloom.functions.text import trim

# Logins of automatic reviewers.
BOTS = "dependabot[bot] renovate[bot] github-actions[bot] codecov[bot] sonarcloud[bot] coderabbitai[bot] copilot-pull-request-reviewer[bot] imgbot[bot] greenkeeper[bot] snyk-bot vercel[bot] netlify[bot] ghost".split()
# Whole comments that approve, thank or praise.
APPROVALS = ["lgtm", "looks good", "looks good to me", "lg tm", "ship it", "shipit", "approved", "approve", "sg", "sounds good", "+1", "plus one", "r+"]
THANKS = ["thanks", "thank you", "thanks a lot", "thanks so much", "thx", "ty"]
PRAISE = ["nice", "nice work", "nice one", "great", "great work", "great job", "awesome", "awesome work", "perfect", "well done", "good job", "good work", "excellent", "excellent work", "love it", "beautiful", "clean", "clean pr", "solid", "solid work", "fantastic", "amazing"]
# What may follow "nit" without asking for anything.
EMPTY_NITS = "typo spacing whitespace style formatting nit nits lol lgtm ok okay fine np sg".split()

#: Pictographs as code-point ranges, which every engine reads alike.
PICTOGRAPHS = r"[\x{00A9}\x{00AE}\x{203C}\x{2049}\x{2122}\x{2139}\x{2194}-\x{21AA}\x{231A}-\x{23FF}\x{24C2}\x{25AA}-\x{25FE}\x{2600}-\x{27BF}\x{2934}\x{2935}\x{2B05}-\x{2B55}\x{3030}\x{303D}\x{3297}\x{3299}\x{1F000}-\x{1FAFF}]"
SHORTCODE = r"(?i):[a-z0-9_+-]+:"


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def is_bot(author: Column, extra: list[str] | None = None) -> Column:
    login = F.lower(trim(author))
    known = [*BOTS, *(x.strip().lower() for x in extra or [])]
    return F.coalesce((login != "") & (login.endswith("[bot]") | login.isin(*known) | login.rlike(r"^[a-z0-9_-]+-bot$")), F.lit(False))


def plain_body(body: Column) -> Column:
    """Lower-case words of a comment, without code, emoji and punctuation."""
    x = F.lower(body)
    for pattern in (r"(?s)```.*?```", r"`[^`]+`", SHORTCODE, PICTOGRAPHS):
        x = F.regexp_replace(x, pattern, " ")
    x = F.regexp_replace(F.regexp_replace(x, r"[\x{FE0F}\x{200D}]", ""), r"[^a-z0-9+\s]", " ")
    return trim(F.regexp_replace(x, r"\s+", " "))


def without_emoji(body: Column) -> Column:
    x = F.regexp_replace(F.regexp_replace(body, SHORTCODE, ""), PICTOGRAPHS, "")
    return trim(F.regexp_replace(x, r"[\x{FE0F}\x{200D}]", ""))


def is_emoji_only(body: Column) -> Column:
    """Nothing but emoji, shortcodes and light punctuation; blank bodies need to have had some."""
    rest = without_emoji(body)
    return F.when(rest == "", body.rlike(PICTOGRAPHS) | body.rlike(SHORTCODE)).otherwise(rest.rlike(r"^[\s\p{P}\p{S}]*$"))


def is_empty_nit(body: Column, plain: Column) -> Column:
    rest = trim(F.regexp_replace(plain, r"^(?:nits|nit)\s*", ""))
    bare = trim(F.regexp_replace(F.regexp_replace(F.lower(without_emoji(body)), r"[^a-z0-9\s]", " "), r"\s+", " "))
    return plain.rlike(r"^nits?(?![a-z0-9_])") & ((rest == "") | rest.isin(*EMPTY_NITS) | bare.isin("nit", "nits"))


def discard_reason(body: Column, author: Column, least: int = 12, extra_bots: list[str] | None = None, nfkc: bool = True) -> Column:
    """Why a comment asks for nothing; null for comments that do. The first reason that holds is told.

    ``nfkc`` normalises bodies first (an Arrow function that passes ASCII through).
    """
    b = trim(F.coalesce(body, F.lit("")))
    if nfkc:
        b = _nfkc(b)
    plain = plain_body(b)
    return (
        F.when(is_bot(author, extra_bots), "bot_author")
        .when(b == "", "too_short")
        .when(is_emoji_only(b), "emoji_only")
        .when(plain.isin(*APPROVALS), "lgtm")
        .when(plain.isin(*THANKS), "thanks")
        .when(plain.isin(*PRAISE), "praise")
        .when(is_empty_nit(b, plain), "non_actionable_nit")
        .when(~b.contains("```") & (F.length(b) < least), "too_short")
    )
