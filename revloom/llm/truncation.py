"""Text cut off by field limits (problem 8).

*Limits.* Lengths, in code points and in UTF-8 bytes, are counted per source and channel. A length
that far more texts have than the lengths around it, by a likelihood-ratio test, is a candidate
limit. For each, a log-normal length distribution, right-censored at the limit, is fitted by
maximum likelihood (expectation maximisation on sums); the natural number of texts of just that
length under the fit against the number found gives the posterior that a text of that length was
censored.

*Endings.* Each text's ending is put into one of the classes ``CLASSES`` and ``TRACES``. What the
ending alone cannot tell is looked up in counts over the whole corpus: an unpunctuated last line is
complete if lines of that shape also stand, whole, inside a share of the texts of some source and its
last word is a whole word elsewhere; a log is complete if its last line is of a shape that ends logs and does
not go on; dots are a turn of phrase if the same words end a share of all dotted texts and rarely go
on elsewhere, as the beginnings do that cuts leave.

*Likelihoods of the endings.* Both are estimated per source. How cut texts end is seen by cutting:
every text is also read up to one place inside it, drawn by its hash. How whole texts end is what is
left of the texts away from limits when the endings of broken transfers are taken off; every unfinished
ending there counts as broken, up to ``MOST_BROKEN`` of a source's texts, beyond that as the source's
habit. Only the marks and scraps that a cut itself leaves (``TRACES``) have fixed likelihoods.

*Combination.* Posterior odds are the odds of the place times the likelihood ratio of the ending. At
a limit the share that was cut is the one that fits its endings best, with the censoring posterior as
a prior that weighs as much as all the texts there; elsewhere it is the source's share of broken
transfers. So the same ending may be a cut at a limit and complete away from it.

One pass reads the whole texts; counts are pre-aggregated per batch, then per key. A second one
looks for what goes on after frequent endings, of which there are at most 1 / ``SHARE_ENDS`` per
class; these and one count per class come to the driver. Fits run per limit and source, on counts.

Defined cases: null texts are left out, blank ones are complete; a null importer is a channel of
its own that may share the limits of its source; repeated rows give one result; empty tables give
an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from revloom.session import materialize, table

#: Endings whose likelihoods are estimated, with the share of all texts they are taken to have before any is seen.
CLASSES = {"stop": 0.7, "fence": 0.05, "trailer": 0.05, "formula": 0.02, "line": 0.08, "blank": 0.02, "open": 0.04, "in code": 0.04}
#: What cuts leave behind: share of whole and of cut texts that end so (documented constants).
TRACES = {"dots": (0.00005, 0.10), "scrap": (0.00002, 0.05), "mark": (0.00001, 0.02)}
#: Endings that a whole text has only by habit.
UNFINISHED = ("open", "in code")
#: Texts that count for a source besides its own: shares over all sources, and those of ``CLASSES`` over all data.
LIKE_OTHERS, LIKE_NONE = 50, 1
#: The same for the share of broken transfers, and that share before any text is seen.
BROKEN_OTHERS, BROKEN_NONE, BROKEN = 500, 100, 0.02
#: Share of a source's texts, away from limits, that broken transfers may have cut.
MOST_BROKEN = 0.1
#: A shape of unpunctuated lines is a convention from this share of the texts of one source on, with so many texts added to the source.
SHARE_INSIDE, TEXTS_ADDED = 2e-3, 1500
#: Words or a log line are a habit from this share of the dotted or log endings on, with so many endings added.
SHARE_ENDS, ENDS_ADDED = 5e-3, 600
#: A candidate limit: log-likelihood ratio of its texts against the density within ``AROUND`` of it.
SURPRISE, AROUND = 12.0, 40

_SENTENCES = re.compile(r"(?<=[.!?])\s+")
MARK = re.compile(r"[\[(<{]\s*(?:[\w ]{0,20}\b)?(?:clipped|truncated|cut off|cut|shortened|trimmed|snip(?:ped)?|omitted|more|continued|read more)\b[^\])>}]{0,24}[\])>}]?\s*$|--\s?more\s?--\s*$|\[(?:\.\.\.|…)\]\s*$", re.I)
SCRAP = re.compile(r"(?:&(?:#x?[0-9a-fA-F]{0,6}|[a-zA-Z]{1,8})?|(?<=[^\W\d])%[0-9A-Fa-f]?|\\u[0-9a-fA-F]{0,3}|\\x[0-9a-fA-F]?|\\|<[/!]?[a-zA-Z]{0,10}|\ufffd+)$")
STOP = re.compile(r"(?:[.!?。！？][\"'»”’)\]*_`]*|[:;]-?[)D(P])$")
DOTS = re.compile(r"(?:\.\.\.+|…)[\"'»”)\]]*$")
TRAILER = re.compile(r"^(?:https?://\S+|<?[\w.+-]+@[\w.-]+\w>?|-- ?@?[\w.-]+|[—–] ?\S.{0,40}|[A-Z][\w-]{1,24}(?: by)?: \S.*|\|.*\||[-=*_]{3,})$")
STAMPED = re.compile(r"^\W{0,2}(?:\d{4}-\d\d-\d\d[T ])?\d\d:\d\d:\d\d")
BULLET = re.compile(r"^\s*(?:[-*+•>]|\d+[.)])\s+")
_WORD = re.compile(r"[A-Za-z_][A-Za-z0-9_]*[a-z][A-Z0-9_]\w*|[A-Za-z_]+_\w+|[^\W\d_]+|\d[\w.]*|\s+|[^\w\s]")
_WHOLE = re.compile(r"\b[a-zß-ÿ]{2,24}\b")
_FUNCTION = frozenset("the a an to in of by for on at with from into and or as is was der die das den im in zu le la les de du des el los las en por para".split())


def line_shape(line: str) -> tuple[str, str]:
    """A line with its words, names and numbers replaced by their kinds, and its last word."""
    out, last = [], ""
    for t in _WORD.findall(BULLET.sub("", line)):
        c = t[0]
        if c.isspace():
            out.append(" ")
        elif c.isdigit():
            out.append("9")
            last = "9"
        elif c.isalpha() or c == "_":
            low = t.lower()
            last = low
            if low in _FUNCTION:
                out.append(low)
            elif "_" in t or any(x.isdigit() for x in t) or (t[1:] != t[1:].lower() and not t.isupper()):
                out.append("I")
                last = "I"
            else:
                out.append("W" if c.isupper() else "w")
        else:
            out.append(t)
            last = t
    return "".join(out).strip(), last


def log_shape(line: str) -> str:
    return re.sub(r"\d+(?:\.\d+)?", "9", re.sub(r"\b[0-9a-f]{6,}\b", "h", line.strip()))


def is_log(text: str) -> bool:
    """Whether the first or the last but one line bears a time stamp."""
    if STAMPED.match(text):
        return True
    end = text.rfind("\n")
    return end > 0 and bool(STAMPED.match(text, text.rfind("\n", 0, end) + 1))


def ending(text: str) -> tuple[str, str | None, str | None]:
    """(class, first key, second key): how a text ends; with keys, the class waits for corpus counts.

    The class is ``log?``, ``line?`` or ``dots?`` where counts decide.
    """
    t = text.rstrip()
    if not t:
        return "blank", None, None
    last = t[t.rfind("\n") + 1 :].strip()
    if MARK.search(last):
        return "mark", None, None
    if SCRAP.search(t):
        return "scrap", None, None
    if is_log(t):
        if STAMPED.match(last):
            return "open", None, None
        return "log?", "t" + log_shape(last), None
    if t.count("```") % 2:
        return "in code", None, None
    if last.startswith("```"):
        return "fence", None, None
    if DOTS.search(last):
        return "dots?", "g" + _SENTENCES.split(last)[-1].lower(), None
    if STOP.search(last) or not (t[-1].isalnum() or t[-1] in "()[]{}<>,;:/\\+*=&|-_'\"`@#$%^~"):
        return "stop", None, None
    if TRAILER.match(last):
        return "trailer", None, None
    shape, word = line_shape(last)
    return "line?", "s" + shape, "w" + word if _WHOLE.fullmatch(word) else None


def inner_lines(text: str) -> Counter:
    """The keys of what is whole inside a text: its words, and unpunctuated lines that others follow."""
    found: Counter = Counter()
    text = text.rstrip()
    for word in set(_WHOLE.findall(text)):
        # A word at the very end may be cut.
        if not text.endswith(word) or text.find(word) < len(text) - len(word):
            found["w" + word] += 1
    lines = text.split("\n")
    if len(lines) < 2:
        return found
    log = is_log(text)
    code = False
    for line in lines[:-1]:
        s = line.strip()
        if s.startswith("```"):
            code = not code
            continue
        if code or not s:
            continue
        if log:
            if not STAMPED.match(s):
                found["t" + log_shape(s)] += 1
        elif not STOP.search(s) and not DOTS.search(s):
            found["s" + line_shape(s)[0]] += 1
    return found


def stem(k1: str) -> str:
    """What a dotted ending or a last log line says, with its kind and without the dots."""
    return DOTS.sub("", k1).rstrip() if k1[0] == "g" else k1


def going_on(text: str, stems: dict[int, set[str]]) -> set[str]:
    """The stems, by their length, that begin a sentence or log line of ``text`` which goes on after them."""
    found = set()
    log = is_log(text)
    for line in text.split("\n"):
        s = line.strip()
        if log:
            parts = [] if STAMPED.match(s) else ["t" + log_shape(s)]
        else:
            parts = ["g" + x.lower() for x in _SENTENCES.split(s)]
        for part in parts:
            for n, those in stems.items():
                # Dots and quotes do not go on; in a log, a full stop does.
                if part[:n] in those and (len(part) > n if log else any(map(str.isalnum, part[n:]))):
                    found.add(part[:n])
    return found


def cut_inside(text: str, place: int) -> str | None:
    """``text`` up to ``place``, or None if that is the end of a line or of a sentence and so inside nothing."""
    head, after = text[:place], text[place : place + 1]
    if not head.strip() or not after or after == "\n" or head[-1] == "\n" or ((after.isspace() or head[-1].isspace()) and STOP.search(head.rstrip())):
        return None
    return head


_READ = "doc_id bigint, source string, importer string, chars int, bytes int, cls string, k1 bigint, k2 bigint, key bigint, ends bigint, inside bigint, stem string"


def read_endings(docs: DataFrame) -> DataFrame:
    """One row per text, one without ``doc_id`` per text cut inside, and per batch one row per key with how often it ends texts and stands inside them."""

    def run(batches):
        import xxhash

        def h(k):
            return None if k is None else xxhash.xxh3_64_intdigest(k) - (1 << 63)

        def counted(k, source):
            # Shapes of lines are counted by source, all else over the whole corpus.
            return h(k), (source or "") if k[0] == "s" else None

        for b in batches:
            rows, ends, inside = [], Counter(), Counter()
            for d, s, i, t in zip(*(b.column(c).to_pylist() for c in ("doc_id", "source", "importer", "text"))):
                cls, k1, k2 = ending(t)
                rows.append((d, s, i, len(t), len(t.encode("utf-8", "replace")), cls, h(k1), h(k2), None, None, None, stem(k1) if cls in ("dots?", "log?") else None))
                if k1:
                    ends[counted(k1, s)] += 1
                for k, n in inner_lines(t).items():
                    inside[counted(k, s)] += n
                head = cut_inside(t, xxhash.xxh3_64_intdigest(t.encode("utf-8", "replace")) % len(t)) if t else None
                if head:
                    cls, k1, k2 = ending(head)
                    rows.append((None, s, None, None, None, cls, h(k1), h(k2), None, None, None, stem(k1) if cls in ("dots?", "log?") else None))
            for k in ends.keys() | inside.keys():
                rows.append((None, k[1]) + (None,) * 6 + (k[0], ends[k], inside[k], None))
            cols = list(zip(*rows)) or [()] * 12
            types = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()] + [pa.int64()] * 5 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[f.split()[0] for f in _READ.split(", ")])

    return docs.select("doc_id", "source", "importer", "text").mapInArrow(run, _READ)


def habits(read: DataFrame, docs: DataFrame) -> DataFrame:
    """(stem): what ends at least ``SHARE_ENDS`` of the dotted or log texts, and more texts than it goes on in."""
    spark = read.sparkSession
    ends = read.filter("stem is not null and doc_id is not null")
    totals = {r.cls: r.n for r in ends.groupBy("cls").agg(F.count("*").alias("n")).toLocalIterator()}
    least = F.create_map(*[F.lit(x) for c in ("dots?", "log?") for x in (c, SHARE_ENDS * (ENDS_ADDED + totals.get(c, 0)))])
    often = {r.stem: r.n for r in ends.groupBy("cls", "stem").agg(F.count("*").alias("n")).filter(F.col("n") >= least[F.col("cls")]).toLocalIterator() if len(r.stem) > 1}
    stems: dict[int, set[str]] = {}
    for x in often:
        stems.setdefault(len(x), set()).add(x)

    def run(batches):
        for b in batches:
            n = Counter(x for t in b.column("text").to_pylist() for x in going_on(t, stems))
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["stem", "n"])

    beyond = {r.stem: r.n for r in docs.select("text").mapInArrow(run, "stem string, n bigint").groupBy("stem").agg(F.sum("n").alias("n")).toLocalIterator()} if often else {}
    return spark.createDataFrame([(x,) for x, n in often.items() if n > beyond.get(x, 0)], "stem string")


def classed(read: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, source, importer, chars, bytes, cls): texts, and without ``doc_id`` cut ones, with their class settled by the corpus counts."""
    texts = read.filter("cls is not null").select("doc_id", "source", "importer", "chars", "bytes", "cls", "k1", "k2", "stem")
    sizes = texts.filter("doc_id is not null").groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count("*").alias("size"))
    counts = (
        read.filter("key is not null").groupBy("key", "source").agg(F.sum("ends").alias("ends"), F.sum("inside").alias("inside"))
        .join(sizes, "source", "left")
        .withColumn("share", F.col("inside") / (F.col("size") + TEXTS_ADDED))
        .groupBy("key").agg(F.sum("ends").alias("ends"), F.sum("inside").alias("inside"), F.max("share").alias("share"))
        .filter("ends > 1 or inside > 1")
    )
    settled = texts.filter("k1 is null").drop("k1", "k2", "stem")
    asked = (
        texts.filter("k1 is not null")
        .join(counts.select(F.col("key").alias("k1"), F.col("ends").alias("e1"), F.col("inside").alias("i1"), "share"), "k1", "left")
        .join(counts.select(F.col("key").alias("k2"), F.col("inside").alias("i2")), "k2", "left")
        .fillna(0, ["e1", "i1", "i2", "share"])
        .join(habits(read, docs).withColumn("habit", F.lit(True)), "stem", "left")
    )
    cls = (
        F.when(F.col("cls") == "log?", F.when(F.col("habit") & (F.col("e1") > F.col("i1")), "stop").otherwise("open"))
        .when(F.col("cls") == "dots?", F.when(F.col("habit"), "formula").otherwise("dots"))
        .otherwise(F.when((F.col("share") >= SHARE_INSIDE) & (3 * F.col("i1") >= F.col("e1")) & (F.col("k2").isNull() | (F.col("i2") > 2)), "line").otherwise("open"))
    )
    return settled.unionByName(asked.withColumn("cls", cls).select(*settled.columns))


_PLACE = ["source", "importer", "unit", "length"]


def candidate_limits(texts: DataFrame) -> DataFrame:
    """(source, importer, unit, length, prior): lengths at which far more texts end than around them, and the posterior that one of that length was censored."""
    sized = texts.select("source", "importer", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length")))).alias("x")).select("source", "importer", "x.*").filter("length > 0")
    counts = sized.groupBy(*_PLACE).agg(F.count("*").alias("n"))
    near = W.partitionBy("source", "importer", "unit").orderBy("length").rangeBetween(-AROUND, AROUND)
    after = W.partitionBy("source", "importer", "unit").orderBy(F.desc("length")).rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy("source", "importer", "unit").orderBy("length").rowsBetween(W.unboundedPreceding, -1)
    log = F.log("length")
    expected = (F.col("around") + 1) / (2.0 * AROUND)
    heaps = (
        counts.withColumn("around", F.sum("n").over(near) - F.col("n"))
        .withColumn("above", F.coalesce(F.sum("n").over(after), F.lit(0)))
        .withColumn("below", F.coalesce(F.sum("n").over(upto), F.lit(0)))
        .withColumn("s1", F.coalesce(F.sum(F.col("n") * log).over(upto), F.lit(0.0)))
        .withColumn("s2", F.coalesce(F.sum(F.col("n") * log * log).over(upto), F.lit(0.0)))
        .filter((F.col("n") > expected) & (F.col("n") * F.log(F.col("n") / expected) - F.col("n") + expected >= SURPRISE))
    )

    def fit(frames):
        for f in frames:
            yield f[_PLACE].assign(prior=[censoring_posterior(h) for h in f.to_dict("records")])

    return heaps.mapInPandas(fit, "source string, importer string, unit string, length int, prior double")


def censoring_posterior(heap: dict) -> float:
    """The probability that a text of just the limit's length was censored there.

    Right-censored maximum likelihood of a log-normal length: texts below count with their length,
    those at the limit and above as longer than it.
    """
    n, cut, length = heap["below"], heap["n"] + heap["above"], heap["length"]
    if n < 5:
        return 0.5
    c = math.log(length)
    mean = heap["s1"] / n
    sd = max(0.05, math.sqrt(max(heap["s2"] / n - mean * mean, 0.0)))
    for _ in range(200):
        z = (c - mean) / sd
        tail = max(0.5 * math.erfc(z / math.sqrt(2)), 1e-12)
        hazard = math.exp(-z * z / 2) / math.sqrt(2 * math.pi) / tail
        e1 = mean + sd * hazard
        e2 = mean * mean + sd * sd + sd * (c + mean) * hazard
        new_mean = (heap["s1"] + cut * e1) / (n + cut)
        new_sd = max(0.05, math.sqrt(max((heap["s2"] + cut * e2) / (n + cut) - new_mean * new_mean, 0.0)))
        done = abs(new_mean - mean) + abs(new_sd - sd) < 1e-7
        mean, sd = new_mean, new_sd
        if done:
            break
    z = (c - mean) / sd
    natural = (n + cut) * math.exp(-z * z / 2) / (sd * math.sqrt(2 * math.pi)) / length
    return min(0.999, max(0.001, 1 - natural / heap["n"]))


def share_cut(prior: float, weight: float, counts: dict[str, float], whole: dict[str, float], cut: dict[str, float]) -> float:
    """The share of cut texts that best explains the counts per ending and a prior worth ``weight`` texts.

    The fixed point of expectation maximisation, found by bisection of the likelihood's slope,
    which falls from one end to the other.
    """
    low, high = 0.0005, 0.9995
    for _ in range(60):
        share = (low + high) / 2
        slope = weight * (prior / share - (1 - prior) / (1 - share))
        for c, n in counts.items():
            slope += n * (cut[c] - whole[c]) / (share * cut[c] + (1 - share) * whole[c])
        low, high = (share, high) if slope > 0 else (low, share)
    return (low + high) / 2


def ending_shares(away: dict[str, float], cuts: dict[str, float], whole0: dict[str, float], cut0: dict[str, float], weight: float, broken0: float, broken_weight: float, habits_too: bool = True) -> tuple[dict, dict, float]:
    """(shares of whole texts, shares of cut texts, share broken) from the endings away from limits and of texts cut inside.

    ``whole0`` and ``cut0`` are the shares of ``weight`` more texts, of which ``broken0`` are broken
    among ``broken_weight`` more. Without ``habits_too`` all unfinished endings count as broken.
    """
    n_cut, n_away = sum(cuts.get(c, 0) for c in CLASSES), sum(away.values())
    cut = {c: (cuts.get(c, 0) + weight * cut0[c]) / (n_cut + weight) for c in CLASSES}
    torn = sum(away.get(c, 0) for c in UNFINISHED) / sum(cut[c] for c in UNFINISHED)
    broken = min(MOST_BROKEN, (torn + broken_weight * broken0) / (n_away + broken_weight))
    # What is beyond the most that can be broken is how whole texts of this source end.
    habit = max(0.0, 1 - MOST_BROKEN * n_away / torn) if torn and habits_too else 0.0
    left = {c: away.get(c, 0) * habit if c in UNFINISHED else max(0.0, away.get(c, 0) - broken * n_away * cut[c]) for c in CLASSES}
    total = sum(left.values()) + weight
    whole = {c: (left[c] + weight * whole0[c]) / total for c in CLASSES}
    # The traces' shares are given; the others keep their proportions beside them.
    rest = [1 - sum(t[k] for t in TRACES.values()) for k in (0, 1)]
    return ({c: rest[0] * x for c, x in whole.items()} | {c: t[0] for c, t in TRACES.items()}, {c: rest[1] * x for c, x in cut.items()} | {c: t[1] for c, t in TRACES.items()}, broken)


_FLAT = {c: 1 / len(CLASSES) for c in CLASSES}


def _posteriors(group: pd.DataFrame, whole0: dict[str, float], cut0: dict[str, float], broken0: float) -> pd.DataFrame:
    """(source, length_limit, cls, p_cut) of one source's counts."""
    pick = lambda f: dict(zip(f["cls"], f["n"]))
    real = group[~group["drawn"]]
    away = real[real["length_limit"].isna()]
    whole, cut, broken = ending_shares(pick(away), pick(group[group["drawn"]]), whole0, cut0, LIKE_OTHERS, broken0, BROKEN_OTHERS)
    out = []
    for limit, f in real.groupby("length_limit", dropna=False):
        known = limit == limit and limit is not None
        share = share_cut(float(f["prior"].max()), float(f["n"].sum()), pick(f), whole, cut) if known else broken
        for c in f["cls"]:
            p = share * cut[c] / (share * cut[c] + (1 - share) * whole[c])
            out.append((f["source"].iloc[0], limit if known else None, c, p))
    return pd.DataFrame(out, columns=["source", "length_limit", "cls", "p_cut"])


def cut_posteriors(docs: DataFrame, limits: bool = True) -> DataFrame:
    """(doc_id, source, importer, length_limit, cls, p_cut): every text with the posterior that it was cut; by its ending alone without ``limits``."""
    docs = docs.filter("doc_id is not null and text is not null")
    every = materialize(classed(materialize(read_endings(docs), "endings"), docs), "classed")
    texts, drawn = every.filter("doc_id is not null"), every.filter("doc_id is null")
    own = materialize(candidate_limits(texts if limits else texts.limit(0)), "limits")
    # Texts whose channel is unknown may have come by any channel of their source.
    any_ = own.filter("importer is not null").select("source", F.lit(None).cast("string").alias("importer"), "unit", "length", "prior")
    known = own.unionByName(any_).groupBy(*_PLACE).agg(F.max("prior").alias("prior"))
    placed = texts
    for unit in ("chars", "bytes"):
        here = known.filter(F.col("unit") == unit).select(F.col("source").alias("s"), F.col("importer").alias("i"), F.col("length").alias("l"), F.col("prior").alias(f"{unit}_prior"), F.concat_ws(":", F.lit(unit), F.col("length")).alias(f"{unit}_limit"))
        placed = placed.join(here, F.col("source").eqNullSafe(F.col("s")) & F.col("importer").eqNullSafe(F.col("i")) & (F.col(unit) == F.col("l")), "left").drop("s", "i", "l")
    placed = materialize(placed.select("doc_id", "source", "importer", "cls", F.coalesce("chars_limit", "bytes_limit").alias("length_limit"), F.coalesce("chars_prior", "bytes_prior").alias("prior")), "placed")
    counts = placed.groupBy("source", "length_limit", "cls").agg(F.count("*").alias("n"), F.max("prior").alias("prior"), F.lit(False).alias("drawn")).unionByName(
        drawn.groupBy("source", "cls").agg(F.count("*").alias("n")).select("source", F.lit(None).cast("string").alias("length_limit"), "cls", "n", F.lit(None).cast("double").alias("prior"), F.lit(True).alias("drawn"))
    )
    counts = materialize(counts, "ending-counts")
    # Over all sources: one count per class. A habit of one source is none of the others.
    total = counts.filter("length_limit is null").groupBy("drawn", "cls").agg(F.sum("n").alias("n")).collect()
    whole0, cut0, broken0 = ending_shares({r.cls: r.n for r in total if not r.drawn}, {r.cls: r.n for r in total if r.drawn}, CLASSES, _FLAT, LIKE_NONE, BROKEN, BROKEN_NONE, False)
    scaled = [{c: d[c] / sum(d[x] for x in CLASSES) for c in CLASSES} for d in (whole0, cut0)]
    told = counts.groupBy("source").applyInPandas(lambda f: _posteriors(f, *scaled, broken0), "source string, length_limit string, cls string, p_cut double").select(F.col("source").alias("s"), F.col("length_limit").alias("l"), F.col("cls").alias("c"), "p_cut")
    same = F.col("source").eqNullSafe(F.col("s")) & F.col("length_limit").eqNullSafe(F.col("l")) & (F.col("cls") == F.col("c"))
    return placed.join(told, same).select("doc_id", "source", "importer", "length_limit", "cls", "p_cut")


def p8_found(spark, sf_dir: str) -> DataFrame:
    return cut_posteriors(table(spark, sf_dir, "documents")).filter("p_cut >= 0.5").select("doc_id").distinct()


def p8_shares(spark, sf_dir: str) -> DataFrame:
    """Texts and cut texts per source and channel."""
    rows = cut_posteriors(table(spark, sf_dir, "documents"))
    return rows.groupBy("source", "importer").agg(F.count("*").alias("n_texts"), F.sum((F.col("p_cut") >= 0.5).cast("bigint")).alias("n_cut"), F.round(F.avg((F.col("p_cut") >= 0.5).cast("double")), 6).alias("share_cut"))
