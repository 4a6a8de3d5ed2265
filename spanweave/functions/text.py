"""Column builders over text: offsets of matches, normal forms, labels, paragraphs and sentences. No Python at run time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns

SPAN = "array<struct<start:bigint,end:bigint,text:string>>"
_EDGE = r"(?U)^\s+|\s+$"


def strip(c) -> Column:
    """Trim Unicode white space at both ends."""
    return F.regexp_replace(c, _EDGE, "")


#: Matches of a text are added up by runs of this many, as an array grows by being copied.
_RUN = 256


def bound(value: Column, f) -> Column:
    """``f(value)`` with the value computed once: an expression that is used in several places, or in a lambda, would be
    computed again in each."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _offsets(pieces: Column, gaps: Column) -> Column:
    """Spans of pieces that stand between gaps, in code points."""
    long = lambda x: F.length(x).cast("bigint")
    none = F.expr(f"cast(array() as {SPAN})")

    def step(acc, pair):
        a = acc["at"] + long(pair["gap"])
        b = a + long(pair["piece"])
        return F.struct(b.alias("at"), F.concat(acc["spans"], F.array(F.struct(a.alias("start"), b.alias("end"), pair["piece"].alias("text")))).alias("spans"))

    def run(acc, part):
        own = F.aggregate(part, F.struct(acc["at"].alias("at"), none.alias("spans")), step)
        return bound(own, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["runs"], F.array(x["spans"])).alias("runs")))

    def fold(pairs):
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / _RUN).cast("int")), lambda k: F.slice(pairs, k * _RUN + 1, F.lit(_RUN)))
        start = F.struct(F.lit(0).cast("bigint").alias("at"), F.expr(f"cast(array() as array<{SPAN}>)").alias("runs"))
        return F.when(F.size(pairs) == 0, none).otherwise(F.aggregate(runs, start, run, lambda acc: F.flatten(acc["runs"])))

    # a last gap stands behind the last piece; zip_with gives it no piece
    pairs = F.zip_with(pieces, gaps, lambda p, g: F.struct(p.alias("piece"), g.alias("gap")))
    return bound(pairs, lambda x: fold(F.filter(x, lambda pair: pair["piece"].isNotNull())))


#: Put in place of matches, so that gaps are split off by one character: a pattern to split by is compiled for every text.
_MARK = "\x01"


def _one(start: Column, end: Column, text: Column) -> Column:
    return F.array(F.struct(start.cast("bigint").alias("start"), end.cast("bigint").alias("end"), text.alias("text")))


def match_spans(text, pattern: str) -> Column:
    """All leftmost, non-overlapping matches as (start, end, text); null text gives an empty array.

    A text without a match, or with one, as most are, is searched once: the gaps tell. Matches are extracted where there are
    more.
    """
    t = F.coalesce(text, F.lit(""))
    held = F.contains(t, F.lit(_MARK))  # such a text is split by the pattern itself
    gaps = F.split(F.when(held, t).otherwise(F.regexp_replace(t, F.lit(pattern), F.lit(_MARK))), F.when(held, F.lit(pattern)).otherwise(F.lit(_MARK)), -1)

    def spans(gaps):
        start, end = F.length(gaps[0]), F.length(t) - F.length(gaps[1])
        several = _offsets(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), gaps)
        return F.when(F.size(gaps) == 1, F.expr(f"cast(array() as {SPAN})")).when(F.size(gaps) == 2, _one(start, end, F.substring(t, start + 1, end - start))).otherwise(several)

    return bound(gaps, spans)


def literal_spans(text, literal) -> Column:
    """All non-overlapping occurrences of a literal, left to right; an empty literal occurs nowhere."""
    t, lit = F.coalesce(text, F.lit("")), F.coalesce(literal, F.lit(""))
    quoted = F.concat(F.lit(r"\Q"), F.replace(lit, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))

    def spans(at):
        several = bound(F.split(t, quoted, -1), lambda gaps: _offsets(F.array_repeat(lit, F.size(gaps) - 1), gaps))
        once = F.position(lit, t, at + F.length(lit)) == 0
        return F.when((lit == "") | (at == 0), F.expr(f"cast(array() as {SPAN})")).when(once, _one(at - 1, at - 1 + F.length(lit), lit)).otherwise(several)

    return bound(F.position(lit, t), spans)


def norm_structured(kind, surface) -> Column:
    low = F.lower(strip(surface))
    return F.when(kind.isin(*patterns.UNSEPARATED), F.regexp_replace(low, r"[\s\-.()]", "")).otherwise(low)


def norm_basic(surface) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip(surface)), r"\s+", " "), r"[.,]+$", "")


def _token(c) -> Column:
    return F.lower(F.regexp_replace(c, r"(?U)[^\w]", ""))


def person_last(surface) -> Column:
    """Last name: what stands before a comma, else the last word."""
    t = strip(surface)
    return F.when(F.contains(t, F.lit(",")), _token(F.split_part(t, F.lit(","), F.lit(1)))).otherwise(_token(F.element_at(F.split(t, r"\s+"), -1)))


def person_first(surface) -> Column:
    """First given name, or an empty string."""
    t = strip(surface)
    words = F.split(t, r"\s+")
    given = F.when(F.contains(t, F.lit(",")), strip(F.regexp_replace(t, r"^[^,]*,", ""))).otherwise(F.array_join(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), " "))
    return F.coalesce(F.get(F.filter(F.transform(F.split(given, r"\s+"), _token), lambda x: x != ""), F.lit(0)), F.lit(""))


def org_core(surface) -> Column:
    """Name words without punctuation and corporate suffixes."""
    words = F.transform(F.split(strip(surface), r"\s+"), _token)
    suffixes = F.array(*map(F.lit, patterns.ORG_SUFFIXES))
    return F.array_join(F.filter(words, lambda w: (w != "") & ~F.array_contains(suffixes, w)), " ")


def normalize_type(c) -> Column:
    up = F.upper(c)
    return F.when(up.isin(*patterns.TYPES), up).otherwise(F.lit("OTHER"))


def letters(n) -> Column:
    """Bijective base 26: 0 is A, 25 Z, 26 AA, 702 AAA."""
    zero = F.struct(n.cast("bigint").alias("n"), F.lit("").alias("s"))

    def step(acc, _):
        return F.when(acc["n"] < 0, acc).otherwise(F.struct((F.floor(acc["n"] / 26) - 1).cast("bigint").alias("n"), F.concat(F.char(F.lit(65) + (acc["n"] % 26).cast("int")), acc["s"]).alias("s")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(8)), zero, step, lambda acc: acc["s"])


def letters_index(s) -> Column:
    """Inverse of ``letters``; null where the text is not capital letters only."""
    fold = F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), F.lit(0).cast("bigint"), lambda acc, c: acc * 26 + F.ascii(c) - 64)
    return F.when(F.coalesce(s, F.lit("")).rlike("^[A-Z]+$"), fold - 1)


def text_place(n: Column, base: Column, size: Column) -> Column:
    """Place, from 0, that ``%04d`` of n takes in text order among those of base, base + 1 .. base + size - 1.

    Of the numbers that are written in k digits, those stand before n that are less than n's digits cut or filled with
    zeros to k; where n's are cut, the number that equals what is left does as well.
    """
    most = (1 << 63) - 1
    width = lambda x: F.greatest(F.length(x.cast("string")), F.lit(4))
    lows = F.array(*[F.lit(0 if k == 4 else 10 ** (k - 1)).cast("bigint") for k in range(4, 20)])
    highs = F.array(*[F.lit(min(10**k, most)).cast("bigint") for k in range(4, 20)])
    digits = F.lpad(n.cast("string"), width(n), F.lit("0"))

    def before(acc, k):
        to = F.coalesce(F.rpad(digits, k, F.lit("0")).try_cast("bigint"), F.lit(most)) + F.when(width(n) > k, F.lit(1)).otherwise(F.lit(0))
        low = F.greatest(base, F.get(lows, k - 4))
        return acc + F.greatest(F.least(to, base + size, F.get(highs, k - 4)) - low, F.lit(0)).cast("bigint")

    return F.aggregate(F.sequence(width(base), width(base + size - 1)), F.lit(0).cast("bigint"), before)


def pseudonym(kind, n) -> Column:
    """``Agent A`` for persons, ``Organization 1`` for organisations, ``[TAG-1]`` otherwise; n counts from 0."""
    tag = kind
    for name, short in patterns.TAGS.items():
        tag = F.when(kind == name, F.lit(short)).otherwise(tag)
    return F.when(kind == "PERSON", F.concat(F.lit("Agent "), letters(n))).when(kind == "ORG", F.concat(F.lit("Organization "), (n + 1).cast("string"))).otherwise(F.concat(F.lit("["), tag, F.lit("-"), (n + 1).cast("string"), F.lit("]")))


def pseudonym_index(kind, name) -> Column:
    """Index, from 0, in a pseudonym; null where it is malformed."""
    number = F.when(kind == "ORG", F.regexp_extract(name, r"^Organization ([0-9]{1,15})$", 1)).otherwise(F.regexp_extract(name, r"-([0-9]{1,15})\]$", 1))
    counted = F.when(number != "", number.try_cast("bigint") - 1)
    return F.when(kind == "PERSON", letters_index(F.regexp_extract(name, r"^Agent ([A-Z]+)$", 1))).otherwise(counted)


def paragraphs(text, separator: str = r"\n[^\S\n]*\n") -> Column:
    """(start, end, text) of paragraphs with words, from their first word to their last."""
    t = F.coalesce(text, F.lit(""))
    between = F.regexp_extract_all(t, F.lit(separator), F.lit(0))
    spans = _offsets(F.split(t, separator, -1), F.concat(F.array(F.lit("")), between))
    edged = F.transform(spans, lambda s: F.struct((s["start"] + F.length(s["text"]) - F.length(F.regexp_replace(s["text"], r"^\s+", ""))).alias("start"), strip(s["text"]).alias("text")))
    bounded = F.transform(edged, lambda s: F.struct(s["start"].cast("bigint").alias("start"), (s["start"] + F.length(s["text"])).cast("bigint").alias("end"), s["text"].alias("text")))
    return F.filter(bounded, lambda s: s["text"] != "")


def sentences(paragraph) -> Column:
    """(start, end, text) of sentences within a paragraph: up to . ! or ? before white space or the end."""
    spans = bound(F.split(paragraph, r"(?<=[.!?])(?=\s|$)", -1), lambda pieces: _offsets(pieces, F.transform(pieces, lambda _: F.lit(""))))
    cut = F.transform(spans, lambda s: F.struct((s["end"] - F.length(F.regexp_replace(s["text"], r"^\s+", ""))).cast("bigint").alias("start"), s["end"].alias("end"), F.regexp_replace(s["text"], r"^\s+", "").alias("text")))
    return F.filter(cut, lambda s: s["text"] != "")


def overlap_words(n, ratio: float) -> Column:
    return F.when((F.lit(ratio) <= 0) | (n == 0), F.lit(0)).otherwise(F.greatest(F.lit(1), F.ceil(n * F.lit(float(ratio))).cast("int")))
