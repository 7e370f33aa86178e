"""Credentials embedded in source code (problem 2).

1. Every text is cut into literals -- strings, unquoted configuration values, URL parts, headers and
   key blocks; literals written in pieces are joined first. The ones that could be a credential by
   structure or by the name they are bound to are indexed corpus-wide by value.
2. The index counts the unrelated owners of each value, in two aggregations with map-side combine.
   A value that ``SHARED_BY`` or more owners have is a placeholder or sample and is suppressed.
3. The rare structured values left are the confirmed secrets.
4. Every text is then scanned again for confirmed secrets, also where nothing around them gives them
   away. The secrets are taken in blocks of about ``SCAN_BLOCK``, and each block is one Aho-Corasick
   automaton that runs over all texts, so that a secret is found wherever it stands, also amid other
   letters. The lines of a key block are looked for one by one. Secrets of under ``WHOLE_FROM``
   characters must stand apart from letters and digits; inside longer words they are coincidences.

Masking replaces each piece of a credential by ``MASK`` and leaves all else, quotes included.

Defined cases: null and empty texts hold nothing; ``base64`` contents are decoded first, with
undecodable bytes replaced; rows with a null key are left out; a repeated row gives one result;
empty tables give empty results. Placeholders, variable references, masked values, public keys,
hashes, checksums and plain identifiers are no credentials.
"""

from __future__ import annotations

import base64
import re
import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from revloom.session import materialize, table

#: Unrelated owners from which on a value is a shared placeholder.
SHARED_BY = 5
MASK = "[MASKED]"
#: Length under which a piece is masked only at its place.
SHORT = 6
#: Secrets that one pass over the texts looks for, and how many of their last characters the automaton holds.
SCAN_BLOCK, SUFFIX = 200_000, 8
#: Length from which on a secret is looked for inside longer words too.
WHOLE_FROM = 8

#: Tokens that their issuer's prefix and length tell.
TOKENS = re.compile(
    r"(?<![A-Za-z0-9_])(?:"
    r"(?:AKIA|ASIA|ABIA|ACCA)[A-Z0-9]{16}(?![A-Za-z0-9])"
    r"|gh[pousr]_[A-Za-z0-9]{30,}"
    r"|github_pat_[A-Za-z0-9]{20,}_[A-Za-z0-9]{20,}"
    r"|glpat-[A-Za-z0-9_-]{18,}"
    r"|xox[abeoprs]-[A-Za-z0-9-]{10,}"
    r"|xapp-[A-Za-z0-9-]{10,}"
    r"|sk_(?:live|test)_[A-Za-z0-9]{14,}|rk_(?:live|test)_[A-Za-z0-9]{14,}"
    r"|sk-(?:proj-|ant-|svcacct-)?[A-Za-z0-9_-]{20,}"
    r"|AIza[A-Za-z0-9_-]{30,}"
    r"|ya29\.[A-Za-z0-9_-]{20,}"
    r"|npm_[A-Za-z0-9]{30,}"
    r"|pypi-[A-Za-z0-9_-]{16,}"
    r"|hf_[A-Za-z0-9]{20,}"
    r"|SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}"
    r"|dop_v1_[a-f0-9]{40,}"
    r"|shp(?:at|ca|pa|ss)_[A-Fa-f0-9]{24,}"
    r"|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
    r")"
)
KEY_BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(.*?)(?:-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----|\Z)", re.S)
URL_USER = re.compile(r"\b[a-z][a-z0-9+.-]{1,20}://[^\s/:@\"'<>]*+:([^\s/@\"'<>]{3,})@", re.I)
URL_QUERY = re.compile(r"[?&][\w.-]*(?:token|sig|signature|secret|api_?key|apikey|access_?key|password|auth|key)=([^\s&#\"'<>;,)`]{8,})", re.I)
HEADER = re.compile(r"\b(Basic|Bearer|Token)\s+([A-Za-z0-9+/_.~=-]{8,})")
CURL_USER = re.compile(r"(?:(?<![\w-])-u|--user|--proxy-user)[ =]+[\"']?([^\s:\"']++):([^\s\"']{4,})")
FLAG = re.compile(r"(?<![\w-])--(?:password|passwd|token|api-key|secret)[ =]+[\"']?([^\s\"']{6,})")
_STRING = r"[rbfu]?(?:\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)')"
STRING = re.compile(_STRING)
#: Beginnings of the tokens above, to pass over texts without any.
TOKEN_STARTS = ("AKIA", "ASIA", "ABIA", "ACCA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xox", "xapp-", "sk_", "rk_", "sk-", "AIza", "ya29.", "npm_", "pypi-", "hf_", "SG.", "dop_v1_", "shp", "eyJ")
#: What follows a name's telling word up to the value: the rest of the name, then the sign that binds.
BINDING = re.compile(r"([\w.\-]{0,24})[\"'\]]{0,2}[ \t]*(:=|=>|[:=,])[ \t]*\(?[ \t]*")
#: A quoted value with the pieces that are added on.
QUOTED = re.compile(r"(?:\\?\r?\n[+\- ]?[ \t]*)?(" + _STRING + r"(?:[ \t]*(?:\+|\.\.?|\\)?[ \t]*(?:\r?\n[+\- ]?[ \t]*)?(?:\+|\.\.?)?[ \t]*" + _STRING + r")*)")
#: A value without quotes, alone on its line or folded onto the next.
BARE = re.compile(r"(?:[>|][+-]?[ \t]*\r?\n[+\- ]?[ \t]*)?([^\s\"'`,;(){}\[\]<>$#*][^\s\"'`,;(){}\[\]<>]{7,})[;,]?[ \t]*(?:\r?\n|\Z)")
#: What may stand before a name that is bound without quotes.
LINE_START = re.compile(r"(?:^|\n)[+\- ]?[ \t]*(?:(?://|#|;|--)[ \t]*)?(?:export[ \t]+|set[ \t]+|-[ \t]+|ENV[ \t]+)?[\w.\-]*\Z")
#: Literals joined by a sign, over lines or side by side, whatever they are bound to.
JOINED = re.compile(_STRING + r"(?:[ \t]*(?:(?:\+|\.\.?|\\)[ \t]*(?:\r?\n[+\- ]?[ \t]*)?|\r?\n[+\- ]?[ \t]*(?:\+|\.\.?)?[ \t]*)?" + _STRING + r")+")

_SIDE_BY_SIDE = re.compile(r"(?:\"[ \t]*[rbfu]?[\"'])|(?:'[ \t]*[rbfu]?[\"'])")
#: What stands between two pieces of a credential.
_BETWEEN = r"(?:[\"'](?:[ \t\r\n+\-.]|\\(?![\"']))*[rbfu]?[\"'])+"

#: Parts of words that make a name worth a look.
TELLING = ("passw", "passphrase", "pass", "pwd", "secret", "token", "key", "credential", "auth", "bearer", "pat", "pin", "cookie", "jwt")
_SECRET_WORDS = {"password", "passwd", "pwd", "pass", "passphrase", "secret", "secrets", "token", "apikey", "credential", "credentials", "auth", "bearer", "pat", "pin", "cookie", "jwt", "authorization", "authtoken", "accesskey", "secretkey", "privatekey"}
_PASSWORD_WORDS = {"password", "passwd", "pwd", "pass", "passphrase"}
_KEY_BEFORE = {"api", "access", "secret", "private", "auth", "signing", "sign", "encryption", "master", "client", "account", "storage", "shared", "service", "hmac", "deploy", "webhook", "license", "jwt", "crypt", "aes", "encrypt"}
_NEUTRAL = {"value", "val", "str", "string", "text", "raw", "plain", "b64", "base64", "enc", "new", "old", "prod", "dev", "live", "default"}
_PLACEHOLDER = re.compile(
    r"^(?:[x*.#?•_\-]+|0+|1234\w*|(?:your|my|the|some|any|enter|insert|put|set|add|replace|change|fill|sample|example|dummy|fake|test|todo|fixme|none|null|nil|true|false|undefined|redacted|masked|hidden|removed|placeholder|default|changeme|secret|password|passwd|pass|token|user|admin|foo|bar|abc|value|string)(?:[-_ .]?(?:me|it|here|this|your|with|in|by|a|an|the|real|own|some|api|access|auth|secret|private|key|token|password|pass|passwd|pwd|value|string|credential|credentials|example|sample|test|placeholder|goes|from|env|vault|123|1234|12345))*)$",
    re.I,
)
_REFERENCE = re.compile(r"\$\{|\$\(|^\$\w|\{\{|\}\}|^%\w+%?$|%\(|^<.*>$|\[REDACTED|\[MASKED|process\.env|os\.environ|getenv|^\{\w+\}$|\{\w*\}|^(?:env|vault|ssm|secret|arn|file|ref)[:/]|xxxx|\*\*\*|\.\.\.|…|(?i:redacted|example$|EXAMPLE|your[-_]|changeme|placeholder|dummy)", 0)
_HEX = re.compile(r"^[0-9a-f]+$|^[0-9A-F]+$")
_UUID = re.compile(r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$")
_HASHED = re.compile(r"^(?:sha\d+|md5|blake2\w*)[-:$]|^\$(?:2[aby]|argon2\w*|5|6|1)\$|^\{SSHA", re.I)
_SUBWORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_NAME = re.compile(r"^(?:[A-Za-z]+(?:[._/\-]+[A-Za-z]+)*)(?:_?[0-9a-f]{1,2})?$")
#: Names of lower-case words and a short mark; the signs between their words make them look drawn.
_MARKED_NAME = re.compile(r"^[a-z]+(?:[._/\-][a-z]+)+[._/\-]?[0-9a-f]{1,2}$")
_BLOCK_LINE = re.compile(r"[A-Za-z0-9+/=]{16,}")


def subwords(name: str) -> list[str]:
    return [w.lower() for w in _SUBWORD.findall(name)]


def name_role(name: str) -> str:
    """``password``, ``secret`` or nothing, by what a name says it is bound to."""
    ws = subwords(name)
    while len(ws) > 1 and (ws[-1].isdigit() or ws[-1] in _NEUTRAL):
        ws = ws[:-1]
    if not ws:
        return ""
    if ws[-1] in _PASSWORD_WORDS:
        return "password"
    if ws[-1] in _SECRET_WORDS or (ws[-1] == "key" and len(ws) > 1 and ws[-2] in _KEY_BEFORE):
        return "secret"
    return ""


def kinds(v: str) -> int:
    """Changes between lower case, upper case, digits and other characters."""
    k = ["l" if c.islower() else "u" if c.isupper() else "d" if c.isdigit() else "o" for c in v]
    return sum(a != b for a, b in zip(k, k[1:]))


def is_random(v: str) -> bool:
    """Whether the character kinds change as they do in drawn strings and not in names."""
    return len(v) >= 8 and any(c.isdigit() for c in v) and any(c.isalpha() for c in v) and kinds(v) >= 0.3 * len(v)


def is_placeholder(v: str) -> bool:
    return bool(_PLACEHOLDER.match(v) or _REFERENCE.search(v)) or len(set(v)) < 5


def is_identifier(v: str) -> bool:
    """Words joined as in a name, a path or a host, with at most a short number at the end of a word."""
    return bool(_NAME.match(v)) or (bool(re.fullmatch(r"[A-Za-z_][\w.]*", v)) and not is_random(v))


def bound_value(role: str, v: str, quoted: bool) -> bool:
    """Whether a literal bound to a name of that role is a credential."""
    if len(v) < 6 or any(c.isspace() for c in v) or is_placeholder(v) or _HASHED.match(v) or _UUID.match(v) or "://" in v:
        return False
    if _HEX.match(v):
        return len(v) >= 16 and any(c.isdigit() for c in v) and any(c.isalpha() for c in v)
    if role == "password" and quoted:
        return not is_identifier(v) or is_random(v)
    if _MARKED_NAME.match(v):
        return False
    if is_identifier(v) and not is_random(v):
        return False
    return len(v) >= 8 and any(c.isdigit() for c in v) and any(c.isalpha() for c in v) and (quoted or is_random(v))


def _unescape(v: str) -> str:
    return v.replace("\\n", "\n").replace("\\/", "/")


def _touched(pieces: list[str], start: int, end: int) -> list[str]:
    """The parts of ``pieces`` that the joined text holds from ``start`` to ``end``."""
    out, at = [], 0
    for p in pieces:
        part = p[max(0, start - at) : max(0, end - at)]
        if part:
            out.append(part)
        at += len(p)
    return out


def credentials(text: str) -> list[tuple[str, str, list[str]]]:
    """(kind, value, pieces as written) of each literal in ``text`` that may be a credential."""
    if not text:
        return []
    out: list[tuple[str, str, list[str]]] = []
    seen: set[str] = set()

    def add(kind: str, value: str, pieces: list[str]) -> None:
        if value not in seen:
            seen.add(value)
            out.append((kind, value, pieces))

    def token_ok(v: str) -> bool:
        body = v[4:]
        return not is_placeholder(v) and not is_placeholder(body) and len(set(body)) > 6 and (any(c.isdigit() for c in body) or any(c.isupper() for c in body)) and any(c.isalpha() for c in body)

    if "PRIVATE KEY" in text:
        for m in KEY_BLOCK.finditer(text):
            pieces = _BLOCK_LINE.findall(m.group(1).replace("\\n", " "))
            body = "".join(pieces)
            if len(body) >= 40 and not is_placeholder(body) and len(set(body)) > 12:
                add("private key", body, pieces)
    starts = any(p in text for p in TOKEN_STARTS)
    if starts:
        for m in TOKENS.finditer(text):
            if token_ok(m.group()):
                add("token", m.group(), [m.group()])
    if '"' in text or "'" in text:
        for m in JOINED.finditer(text):
            pieces = [a or b for a, b in STRING.findall(m.group())]
            value = _unescape("".join(pieces))
            for t in TOKENS.finditer(value):
                parts = _touched(pieces, t.start(), t.end())
                # Literals side by side may be two values: a token that is whole in the first ends there.
                if token_ok(t.group()) and not (len(parts) > 1 and _SIDE_BY_SIDE.search(m.group()) and TOKENS.search(parts[0])):
                    add("token", t.group(), parts)
    if "://" in text:
        if "@" in text:
            for m in URL_USER.finditer(text):
                v = m.group(1)
                if not is_placeholder(v) and (any(c.isdigit() for c in v) or kinds(v) > 2):
                    add("url password", v, [v])
        if "=" in text:
            for m in URL_QUERY.finditer(text):
                v = m.group(1)
                if not is_placeholder(v) and is_random(v):
                    add("url parameter", v, [v])
    if "Basic " in text or "Bearer " in text or "Token " in text:
        for m in HEADER.finditer(text):
            kind, v = m.groups()
            if kind == "Basic":
                try:
                    said = base64.b64decode(v + "=" * (-len(v) % 4), validate=True).decode("utf-8")
                except ValueError:
                    continue
                user, sep, word = said.partition(":")
                if sep and word and said.isprintable() and not is_placeholder(word) and len(word) >= 4:
                    add("basic", v, [v])
            elif is_random(v) and not is_placeholder(v):
                add("bearer", v, [v])
    if "curl" in text or "--" in text:
        for m in CURL_USER.finditer(text):
            v = m.group(2)
            if not is_placeholder(v) and not is_identifier(v):
                add("basic", v, [v])
        for m in FLAG.finditer(text):
            v = m.group(1)
            if not is_placeholder(v) and is_random(v):
                add("flag", v, [v])
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    looked = set()
    for word in TELLING:
        at = low.find(word)
        while at >= 0:
            end = at + len(word)
            m = BINDING.match(text, end)
            if m and m.end() not in looked:
                looked.add(m.end())
                start = at
                while start and (text[start - 1].isalnum() or text[start - 1] in "_.-") and at - start < 80:
                    start -= 1
                role = name_role(text[start:end] + m.group(1))
                if role:
                    q = QUOTED.match(text, m.end())
                    if q:
                        pieces = [a or b for a, b in STRING.findall(q.group(1))]
                        v = _unescape("".join(pieces))
                        if bound_value(role, v, True):
                            add(role, v, [p for p in pieces if p])
                    elif m.group(2) in ("=", ":") and LINE_START.match(text, max(0, text.rfind("\n", 0, start)), end):
                        u = BARE.match(text, m.end())
                        if u and bound_value(role, u.group(1), False):
                            add(role, u.group(1), [u.group(1)])
            at = low.find(word, end)
    # A value inside a longer one (a token in a header or parameter) is told once.
    return [c for c in out if not any(c[1] != d[1] and c[1] in d[1] and d[0] != "private key" for d in out)]


def _decode(text, encoding):
    if text is None or encoding == "none":
        return None
    if encoding != "base64":
        return text
    try:
        return base64.b64decode(text).decode("utf-8", "replace")
    except ValueError:
        return None


def text_fields(spark, sf_dir: str) -> DataFrame:
    """(src_table, src_key, field_name, owner, encoding, text): the four fields that may hold credentials."""
    contents, raw, episodes = (table(spark, sf_dir, n) for n in ("contents", "pull_review_comments", "episodes"))
    owner = F.split(F.coalesce("repo", F.lit("")), "/")[0].alias("owner")

    def part(df, name, key, field, text, encoding=None):
        return df.select(F.lit(name).alias("src_table"), F.col(key).cast("string").alias("src_key"), F.lit(field).alias("field_name"), owner, (F.col(encoding) if encoding else F.lit("utf-8")).alias("encoding"), F.col(text).alias("text"))

    return reduce(
        DataFrame.unionByName,
        [
            part(contents, "contents", "content_id", "content", "content", "encoding"),
            part(raw, "pull_review_comments", "delivery_id", "diff_hunk", "diff_hunk"),
            part(episodes, "episodes", "id", "rejected.text", "rejected.text"),
            part(episodes, "episodes", "id", "accepted.text", "accepted.text"),
        ],
    ).filter("src_key is not null and text is not null")


_KEYS = "src_table string, src_key string, field_name string"


def literal_index(fields: DataFrame) -> DataFrame:
    """(src_table, src_key, field_name, owner, kind, value, pieces): the candidate literals of each text."""

    def run(batches):
        for b in batches:
            cols = {n: [] for n in ("src_table", "src_key", "field_name", "owner", "kind", "value", "pieces")}
            for t, k, f, o, e, x in zip(*(b.column(n).to_pylist() for n in ("src_table", "src_key", "field_name", "owner", "encoding", "text"))):
                x = _decode(x, e)
                if not x:
                    continue
                for r in credentials(x):
                    for n, v in zip(cols, (t, k, f, o, *r)):
                        cols[n].append(v)
            types = {"pieces": pa.list_(pa.string())}
            yield pa.RecordBatch.from_arrays([pa.array(v, types.get(n, pa.string())) for n, v in cols.items()], names=list(cols))

    return fields.mapInArrow(run, _KEYS + ", owner string, kind string, value string, pieces array<string>")


def confirmed(index: DataFrame, shared_by: int = SHARED_BY) -> DataFrame:
    """(value): candidate values of fewer than ``shared_by`` owners."""
    return index.groupBy("value", "owner").agg(F.count("*").alias("n")).groupBy("value").agg(F.count("*").alias("owners")).filter(F.col("owners") < shared_by).select("value")


def held_in(text: str, automaton, by_end: dict[str, list[str]]) -> set[str]:
    """The values that stand in ``text``, told by their last characters and then compared whole."""
    found = set()
    for at, end in automaton.iter(text):
        for v in by_end[end]:
            start = at + 1 - len(v)
            if start < 0 or v in found or not text.startswith(v, start):
                continue
            if len(v) >= WHOLE_FROM or not ((start and text[start - 1].isalnum()) or text[at + 1 : at + 2].isalnum()):
                found.add(v)
    return found


def _scan(fields: DataFrame, index: DataFrame, shared_by: int) -> DataFrame:
    """(src_table, src_key, field_name, pieces): confirmed secrets found again by automaton."""
    keys = ["src_table", "src_key", "field_name"]
    # The lines of a key block are secrets of their own, as no text holds them joined.
    sought = index.select(*keys, "owner", F.explode(F.when(F.col("kind") == "private key", F.col("pieces")).otherwise(F.array("value"))).alias("value"))
    secrets = materialize(confirmed(sought, shared_by), "sought")
    blocks = -(-secrets.count() // SCAN_BLOCK)

    def scan_block(values: list[str], name: str):
        def scan(batches):
            import ahocorasick

            # Built once per Python worker, not once per task; the last block's is let go.
            kept = ahocorasick.__dict__.setdefault("_revloom", {})
            if name not in kept:
                kept.clear()
                by_end: dict[str, list[str]] = {}
                for v in values:
                    if len(set(v)) >= 5:
                        by_end.setdefault(v[-SUFFIX:], []).append(v)
                automaton = ahocorasick.Automaton()
                for end in by_end:
                    automaton.add_word(end, end)
                automaton.make_automaton()
                kept[name] = automaton, by_end
            automaton, by_end = kept[name]
            for b in batches:
                out = []
                for t, k, f, e, x in zip(*(b.column(n).to_pylist() for n in (*keys, "encoding", "text"))) if by_end else ():
                    x = _decode(x, e)
                    if x:
                        out += [(t, k, f, v) for v in held_in(x, automaton, by_end)]
                cols = list(zip(*out)) if out else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=[*keys, "value"])

        return scan

    met = None
    for k in range(blocks):
        values = [r.value for r in secrets.filter(F.pmod(F.xxhash64("value"), F.lit(blocks)) == k).toLocalIterator()]
        part = fields.select(*keys, "encoding", "text").mapInArrow(scan_block(values, uuid.uuid4().hex), _KEYS + ", value string")
        # Written at once where there are several, so that no more than one block is held.
        part = materialize(part, "met") if blocks > 1 else part
        met = part if met is None else met.unionByName(part)
    if met is None:
        met = sought.select(*keys, "value").limit(0)
    # What is told by its context is in the index already.
    return met.join(sought.select(*keys, "value").distinct(), [*keys, "value"], "left_anti").select(*keys, F.array("value").alias("pieces"))


def held_credentials(fields: DataFrame, shared_by: int = SHARED_BY) -> DataFrame:
    """(src_table, src_key, field_name, pieces): one row per credential and field."""
    index = materialize(literal_index(fields), "literals")
    secrets = materialize(confirmed(index, shared_by), "secrets")
    direct = index.join(secrets, "value", "left_semi").select("src_table", "src_key", "field_name", "pieces")
    return direct.unionByName(_scan(fields, index, shared_by))


def mask(text: str, held: list[list[str]]) -> tuple[str, int]:
    """``text`` without the credentials of which it holds the pieces, and how many places were masked.

    Pieces of ``SHORT`` characters and more are masked everywhere, shorter ones where they stand
    beside the other pieces of their credential or, if it is not written so, as whole words.
    """
    everywhere, words, spans = set(), set(), []
    for pieces in held:
        everywhere.update(re.escape(p) for p in pieces if len(p) >= SHORT)
        short = [p for p in pieces if len(p) < SHORT]
        if not short:
            continue
        chain = list(re.finditer(_BETWEEN.join(f"({re.escape(p)})" for p in pieces), text)) if len(pieces) > 1 else []
        spans += [m.span(i + 1) for m in chain for i in range(len(pieces))]
        if not chain:
            words.update(rf"(?<![A-Za-z0-9]){re.escape(p)}(?![A-Za-z0-9])" for p in short)
    for those in (everywhere, words):
        if those:
            spans += [m.span() for m in re.finditer("|".join(sorted(those, key=len, reverse=True)), text)]
    out, at, count = [], 0, 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], MASK]
            count += 1
        at = max(at, end)
    return "".join(out) + text[at:], count


def masked_texts(fields: DataFrame, shared_by: int = SHARED_BY) -> DataFrame:
    """(src_table, src_key, field_name, n_masked, masked): the texts that hold credentials, with every piece masked."""
    keys = ["src_table", "src_key", "field_name"]
    pieces = held_credentials(fields, shared_by).groupBy(*keys).agg(F.collect_set("pieces").alias("pieces"))

    def run(batches):
        for b in batches:
            n, texts = [], []
            for e, x, ps in zip(*(b.column(c).to_pylist() for c in ("encoding", "text", "pieces"))):
                masked, count = mask(_decode(x, e) or "", ps)
                n.append(count)
                texts.append(masked)
            yield pa.RecordBatch.from_arrays([b.column(k) for k in keys] + [pa.array(n, pa.int64()), pa.array(texts, pa.string())], names=[*keys, "n_masked", "masked"])

    # Only the few texts that hold something meet, so only these are compared for repeated rows.
    joined = fields.select(*keys, "encoding", "text").join(pieces, keys).distinct()
    return joined.mapInArrow(run, _KEYS + ", n_masked bigint, masked string")


def p2_found(spark, sf_dir: str) -> DataFrame:
    return held_credentials(text_fields(spark, sf_dir)).select("src_table", "src_key", "field_name").distinct()


def p2_masked(spark, sf_dir: str) -> DataFrame:
    return masked_texts(text_fields(spark, sf_dir))
