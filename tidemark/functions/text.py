"""Text functions as Spark expressions.  A word character is any Unicode letter or number, or an underscore."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Everything that is no word character.
OTHER = r"[^\p{L}\p{N}_]+"


def tokens(text: Column) -> Column:
    """Runs of word characters of the lower-cased text; null has none."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), OTHER, " "), " "), lambda t: t != "")


def norm(text: Column) -> Column:
    """The word characters of the lower-cased text, joined."""
    return F.regexp_replace(F.lower(text), OTHER, "")


def norm_hyphen(text: Column) -> Column:
    """Like ``norm``, with hyphens inside kept."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\-]+", ""), "^-+|-+$", "")


def bare(text: Column) -> Column:
    """The lower-cased text without blanks and punctuation around it and without hyphens."""
    return F.replace(F.regexp_replace(F.lower(text), r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", ""), F.lit("-"), F.lit(""))


def mask(word: Column, mode: str = "stars") -> Column:
    """stars: first letter kept; first: all but the first two; full: everything; bleep: a mark in its place."""
    if mode == "bleep":
        return F.when(word != "", F.lit("[bleep]")).otherwise(word)
    keep = {"stars": 1, "first": 2, "full": 0}[mode]
    return F.concat(F.substring(word, 1, keep), F.repeat(F.lit("*"), F.greatest(F.length(word) - keep, F.lit(0))))


def collapse(word: Column) -> Column:
    """A trailing run of one letter becomes one, then inner runs of three or more."""
    return F.regexp_replace(F.regexp_replace(word, r"(.)\1+$", "$1"), r"(.)\1{2,}", "$1")


def stem(word: Column, endings: tuple[str, ...] = ("ement", "ation", "ment", "tion", "ing", "ed", "es", "s")) -> Column:
    """The word without the first listed ending that leaves three letters or more."""
    out = None
    for e in endings:
        hit = word.endswith(e) & (F.length(word) >= len(e) + 3)
        cut = F.substring(word, F.lit(1), F.length(word) - len(e))
        out = F.when(hit, cut) if out is None else out.when(hit, cut)
    return out.otherwise(word)


def phonetic(word: Column) -> Column:
    """A rough sound key by fixed letter replacements."""
    for a, b in (("ph", "f"), ("ck", "k"), ("qu", "k"), ("c", "k"), ("y", "i"), ("z", "s")):
        word = F.replace(word, F.lit(a), F.lit(b))
    return word


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0))


def clock(seconds: Column, hours: bool = False) -> Column:
    """mm:ss, or h:mm:ss."""
    s = F.floor(seconds).cast("int")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    minutes, rest = F.floor(s / 60).cast("int"), s % 60
    if not hours:
        return F.concat(two(minutes), F.lit(":"), two(rest))
    return F.concat(F.floor(s / 3600).cast("string"), F.lit(":"), two(minutes % 60), F.lit(":"), two(rest))


def cue_time(ms: Column, mark: str = ",") -> Column:
    """hh:mm:ss,mmm as subtitles write it."""
    pad = lambda x, n: F.lpad(x.cast("long").cast("string"), n, "0")
    return F.concat(
        pad(F.floor(ms / 3_600_000), 2), F.lit(":"), pad(F.floor(ms / 60_000) % 60, 2), F.lit(":"), pad(F.floor(ms / 1000) % 60, 2), F.lit(mark), pad(ms % 1000, 3)
    )


def ratio(a: Column, b: Column) -> Column:
    """Matching-block similarity of two strings (standard library), not an edit distance; null with a null."""

    def one(x, y):
        return None if x is None or y is None else difflib.SequenceMatcher(None, x, y, autojunk=False).ratio()

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")

    return run(a, b)


#: Fixed digits and signs that stand for letters in disguised words.
LEET = ("01345789@$", "oieastbgas")


def undisguised(word: Column) -> Column:
    """Letters for digits and signs where a word mixes them with letters; then only a-z and masking stars stay."""
    low = F.trim(F.lower(word))
    mixed = low.rlike("[a-z]") & low.rlike("[0-9@$]")
    return F.regexp_replace(F.when(mixed, F.translate(low, *LEET)).otherwise(low), "[^a-z*]", "")


def variants(word: Column, suffixes: str, prefixes: str) -> Column:
    """Lookup forms of a word, in order: itself, without a suffix, without a prefix (two letters left at least)."""
    forms = F.array(word, F.regexp_replace(word, f"({suffixes})$", ""), F.regexp_replace(word, f"^({prefixes})", ""))
    return F.array_distinct(F.filter(forms, lambda f: (f == word) | (F.length(f) >= 2)))


def shape(word: Column) -> Column:
    """A masked word (with stars) as a pattern of letters; null for any other."""
    return F.when(word.contains("*"), F.concat(F.lit("^"), F.replace(word, F.lit("*"), F.lit("[a-z]")), F.lit("$")))


def stripped_stem(word: Column, suffixes: tuple[str, ...], prefixes: tuple[str, ...], least: int = 6, left: int = 4) -> Column:
    """The word without its first listed suffix and then its first listed prefix, when ``left`` letters stay; words under
    ``least`` letters are left alone."""
    end = F.array(*map(F.lit, suffixes))
    hit = F.get(F.filter(end, lambda s: F.endswith(word, s) & (F.length(word) - F.length(s) >= left)), F.lit(0))
    cut = F.substr(word, F.lit(1), F.length(word) - F.coalesce(F.length(hit), F.lit(0)))
    start = F.array(*map(F.lit, prefixes))
    pre = F.get(F.filter(start, lambda s: F.startswith(cut, s) & (F.length(cut) - F.length(s) >= left)), F.lit(0))
    return F.when(F.length(word) < least, word).otherwise(F.substr(cut, F.coalesce(F.length(pre), F.lit(0)) + 1))


def token_similarity(a: Column, b: Column, stem_a: Column, stem_b: Column) -> Column:
    """In hundredths: equal 100; one starts the other 75 (four letters); equal stems 80 (three); a stem in the other 60 (four)."""
    long = lambda x, y: (F.length(x) >= 4) & (F.length(y) >= 4)
    return (
        F.when(a == b, 100)
        .when(long(a, b) & (F.startswith(a, b) | F.startswith(b, a)), 75)
        .when((F.length(stem_a) >= 3) & (stem_a == stem_b), 80)
        .when(long(stem_a, stem_b) & (F.contains(b, stem_a) | F.contains(a, stem_b)), 60)
        .otherwise(0)
    )


def content_tokens(text: Column, stop: tuple[str, ...], least: int = 4) -> Column:
    """Words of ``least`` letters or more that start with a letter, the part before a hyphen, without stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z][a-z0-9-]{2,}"), F.lit(0))
    heads = F.transform(found, lambda w: F.substring_index(w, "-", 1))
    return F.filter(heads, lambda w: (F.length(w) >= least) & ~w.isin(*stop))


def title(text: Column, limit: int = 70) -> Column:
    """A title without numbering, line breaks, quotes and marks around it, cut to ``limit`` characters."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)^\s*(\d+\s*[.):-]\s*|(chapter|part)\s*\d+\s*[:.)-]\s*)", "")
    t = F.regexp_replace(F.regexp_replace(t, "[\u2014\u2013]", "-"), r"[ \t\r\n]+", " ")
    t = F.regexp_replace(t, "^[ .\"'`*#:;-]+|[ .\"'`*#:;-]+$", "")
    return F.regexp_replace(F.substring(t, 1, limit), "[ ,;:-]+$", "")


def seconds(text: Column) -> Column:
    """Seconds of ``h:mm:ss``, ``mm:ss`` or plain numbers; null for anything else."""
    parts = F.transform(F.split(F.trim(text), ":"), lambda p: p.try_cast("double"))
    good = (F.size(parts) <= 3) & F.forall(parts, lambda p: p.isNotNull())
    return F.when(good, F.aggregate(parts, F.lit(0.0), lambda acc, p: acc * 60 + p))


def level(db: Column) -> Column:
    """Decibels as a linear factor."""
    return F.pow(F.lit(10.0), db / 20)


def decibels(linear: Column, floor: float = -120.0) -> Column:
    """A linear factor in decibels, ``floor`` for nothing."""
    return F.when(linear > 0, F.greatest(20 * F.log10(linear), F.lit(floor))).otherwise(F.lit(floor))


def grounded(claims: Column, said: Column) -> Column:
    """The numbers of one text that the other never says, without separators, sorted."""
    digits = lambda t: F.transform(F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(r"[0-9]+(?:[.,][0-9]+)*"), F.lit(0)), lambda n: F.regexp_replace(n, "[.,]", ""))
    return F.array_sort(F.array_distinct(F.array_except(digits(claims), digits(said))))


def chunks(parts: Column, limit: int) -> Column:
    """Consecutive strings of an array joined by line feeds while they fit ``limit`` characters; longer ones stand alone."""
    start = F.array().cast("array<string>")

    def step(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        fits = last.isNotNull() & (F.length(last) + 1 + F.length(x) <= limit)
        return F.when(fits, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(last, F.lit("\n"), x)))).otherwise(F.array_append(acc, x))

    return F.aggregate(parts, start, step)


def merge_patch(base: Column, patch: Column) -> Column:
    """JSON texts merged by RFC 7396: members of the patch replace those of the base, nulls remove them.

    A null base is an empty object, a null patch changes nothing; text that is no JSON gives null.
    """
    import json

    def merged(a, b):
        if not isinstance(b, dict):
            return b
        out = dict(a) if isinstance(a, dict) else {}
        for k, v in b.items():
            if v is None:
                out.pop(k, None)
            else:
                out[k] = merged(out.get(k), v)
        return out

    def one(a, b):
        try:
            return json.dumps(merged(json.loads(a) if a else {}, json.loads(b)) if b else json.loads(a or "{}"), sort_keys=True, separators=(",", ":"))
        except ValueError:
            return None

    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="object")

    return run(base, patch)


def overlap_share(ax0: Column, ay0: Column, ax1: Column, ay1: Column, bx0: Column, by0: Column, bx1: Column, by1: Column) -> Column:
    """Intersection over union of two boxes; 0 for empty ones."""
    side = lambda lo, hi: F.greatest(hi - lo, F.lit(0))
    both = side(F.greatest(ax0, bx0), F.least(ax1, bx1)) * side(F.greatest(ay0, by0), F.least(ay1, by1))
    whole = side(ax0, ax1) * side(ay0, ay1) + side(bx0, bx1) * side(by0, by1) - both
    return F.when(whole > 0, both / whole).otherwise(F.lit(0.0))
