"""PII: Aho-Corasick anchors, expanded and validated by deterministic local parsers.

One automaton finds at-signs, plus-signs, digits, schemes and identifier cues (A-Z like a-z) in a single pass over
the whole text.  Each anchor is handed to the parser of its kind, which expands it to both sides, checks it
and emits one span.  A parser looks no further than the token it grows, and what a failed one has read of a run is
remembered where a later anchor could read it again, so the time grows with the text alone.

The kinds email, ip, card and phone have exact base definitions (leftmost, not overlapping within a
kind, failing matches dropped without a retry).  The method adds three kinds: ``url`` for URLs with
credentials in them, ``iban`` for account numbers passing the mod-97 check, and ``secret`` for quoted or
bare values of at least 16 characters that hold a digit after a cue such as ``token =``.  Added spans
never replace base ones.  Null and empty texts have no spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Span = tuple[int, int]

#: Fixed order of kinds; ties of a start are listed in this order.
KINDS = ("email", "ip", "card", "phone", "url", "iban", "secret")
BASE_KINDS = KINDS[:4]

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LETTERS = _UPPER + _UPPER.lower()
_DIGITS = frozenset("0123456789")
_LOCAL = frozenset(_LETTERS + "0123456789._%+-")
_LABEL = frozenset(_LETTERS + "0123456789-")
_PHONE = frozenset(" ().0123456789-")
_ALNUM = frozenset(_LETTERS + "0123456789")
_SECRET = frozenset(_LETTERS + "0123456789_-+/.~=")
_URL_END = frozenset(" \t\n\x0b\x0c\r\"'<>()[]{}|")

#: Identifier cues before a secret value, in lower case, and the cue of an account number.
SECRET_CUES = ("token", "password", "passwd", "secret", "api_key", "apikey", "api-key", "access_key", "private_key")
IBAN_CUES = ("iban",)


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for d in _DIGITS:
        a.add_word(d, ("digit", 1))
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    a.add_word("://", ("scheme", 3))
    for cue in SECRET_CUES:
        a.add_word(cue, ("secret", len(cue)))
    for cue in IBAN_CUES:
        a.add_word(cue, ("iban", len(cue)))
    a.make_automaton()
    return a


_AUTOMATON = _automaton()



def _run(text: str, at: int, allowed) -> int:
    """End of the run of allowed characters that starts at ``at``."""
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def parse_email(text: str, at: int, after: int) -> Span | None:
    """Grow an at-sign: local part back to ``after`` at most, then a label and dotted labels."""
    start = at
    while start > after and text[start - 1] in _LOCAL:
        start -= 1
    end = _run(text, at + 1, _LABEL)
    if start == at or end == at + 1:
        return None
    first = end
    while end + 1 < len(text) and text[end] == "." and text[end + 1] in _LABEL:
        end = _run(text, end + 1, _LABEL)
    return (start, end) if end > first else None


def parse_ip(text: str, start: int) -> tuple[Span | None, bool]:
    """Grow a digit run to four dotted runs.  (span, matched): matched without a span is a failing match."""
    at, parts = start, []
    for i in range(4):
        if i:
            if at + 1 >= len(text) or text[at] != "." or text[at + 1] not in _DIGITS:
                return None, False
            at += 1
        end = _run(text, at, _DIGITS)
        parts.append((at, end))
        at = end
    ok = all(end - a < 4 or not text[a : end - 3].strip("0") for a, end in parts) and all(int(text[max(a, end - 3) : end]) <= 255 for a, end in parts)
    return (start, at), ok


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def parse_card(text: str, start: int) -> tuple[Span, bool]:
    """Grow a digit by digits that one space or hyphen may precede."""
    n, end, count = len(text), start + 1, 1
    while end < n:
        if text[end] in _DIGITS:
            end += 1
        elif text[end] in " -" and end + 1 < n and text[end + 1] in _DIGITS:
            end += 2
        else:
            break
        count += 1
    ok = 12 <= count <= 19 and luhn("".join(c for c in text[start:end] if c in _DIGITS))
    return (start, end), ok


def parse_phone(text: str, at: int) -> tuple[Span | None, bool]:
    """Grow a plus-sign followed by a digit over digits, spaces, brackets, dots and hyphens."""
    if at + 1 >= len(text) or text[at + 1] not in _DIGITS:
        return None, False
    end = _run(text, at + 2, _PHONE)
    while end > at + 3 and text[end - 1] not in _DIGITS:
        end -= 1
    if end <= at + 3:
        return None, False
    count = sum(c in _DIGITS for c in text[at:end])
    return (at, end), 9 <= count <= 15


def parse_url(text: str, at: int) -> Span | None:
    """A URL around ``://`` whose authority carries user:password@.

    Only the authority is read until the credentials are found: it ends before the next anchor's slashes.
    """
    start = at
    while start > 0 and text[start - 1] in _ALNUM:
        start -= 1
    if start == at:
        return None
    end, user, colon = at + 3, -1, False
    while end < len(text) and text[end] not in _URL_END and text[end] not in "/?#":
        if text[end] == ":" and user < 0:
            colon = True
        elif text[end] == "@" and colon:
            user = end
        end += 1
    if user <= at + 3:
        return None
    while end < len(text) and text[end] not in _URL_END:
        end += 1
    return start, end


def parse_iban(text: str, at: int) -> Span | None:
    """After the cue: country letters, check digits and groups of letters and digits, mod 97 equal to 1."""
    at = _run(text, at, frozenset(" :=-#\"'"))
    body, end, i = "", at, at
    while i < len(text) and len(body) < 34 and (text[i] in _ALNUM or text[i] == " "):
        if text[i] != " ":
            body += text[i].upper()
            if len(body) >= 15 and (i + 1 == len(text) or text[i + 1] not in _ALNUM) and _iban_valid(body):
                end = i + 1
        i += 1
    return (at, end) if end > at else None


def _iban_valid(body: str) -> bool:
    if not (body[0] in _UPPER and body[1] in _UPPER and body[2] in _DIGITS and body[3] in _DIGITS):
        return False
    return int("".join(c if c in _DIGITS else str(ord(c) - 55) for c in body[4:] + body[:4])) % 97 == 1


_QUOTE = frozenset(" \t\"'")


def parse_secret(text: str, at: int, failed: int = 0) -> tuple[Span | None, int]:
    """After the cue: blanks, = or :, blanks, an optional quote and a value of 16 characters with a digit.

    (span, failed): a value that is too short or has no digit fails up to its end, and so does every later value that
    starts before it, being a part of it.
    """
    i = _run(text, at, _QUOTE)
    if i >= len(text) or text[i] not in "=:":
        return None, failed
    start = _run(text, i + 1, _QUOTE)
    if start < failed:
        return None, failed
    end = _run(text, start, _SECRET)
    if end - start >= 16 and any(c in _DIGITS for c in text[start:end]):
        return (start, end), failed
    return None, end


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """All spans as (kind, start, end) in code points, end exclusive, by start and then kind as listed."""
    if not text:
        return []
    found: list[tuple[int, int, int]] = []
    after = dict.fromkeys(KINDS, 0)

    def add(kind: str, span: Span, valid: bool = True) -> None:
        if valid:
            found.append((span[0], KINDS.index(kind), span[1]))
        after[kind] = span[1]

    failed = 0
    low = text.lower() if text.isascii() else text.encode().lower().decode()  # bytes fold A-Z only
    for last, (what, length) in _AUTOMATON.iter(low):
        at = last - length + 1
        if what == "digit":
            if at >= after["card"]:
                span, ok = parse_card(text, at)
                if span[1] - at > 1:
                    add("card", span, ok)
                else:
                    after["card"] = span[1]
            if at >= after["ip"]:
                span, ok = parse_ip(text, at)
                if span:
                    add("ip", span, ok)
                else:  # no start within this run of digits can match
                    after["ip"] = _run(text, at, _DIGITS)
        elif what == "at":
            if at >= after["email"] and (span := parse_email(text, at, after["email"])):
                add("email", span)
        elif what == "plus":
            if at >= after["phone"]:
                span, ok = parse_phone(text, at)
                if span:
                    add("phone", span, ok)
        elif what == "scheme":
            if at >= after["url"] and (span := parse_url(text, at)):
                add("url", span)
        elif what == "iban":
            if at >= after["iban"] and (span := parse_iban(text, last + 1)):
                add("iban", span)
        elif at >= after["secret"]:
            span, failed = parse_secret(text, last + 1, failed)
            if span:
                add("secret", span)
    found.sort()
    return [(KINDS[k], s, e) for s, k, e in found]


def listing(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redact(text: str | None) -> str | None:
    """The text with every span replaced by its kind in brackets; of overlapping spans the union is replaced
    under the first one's kind."""
    spans = find_spans(text)
    if not spans:
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        kind, start, end = spans[i]
        while i + 1 < len(spans) and spans[i + 1][1] < end:
            i += 1
            end = max(end, spans[i][2])
        out += [text[at:start], f"[{kind.upper()}]"]
        at, i = end, i + 1
    return "".join(out) + text[at:]


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, counts of the base kinds, base_sha256, spans (all kinds).

    base_sha256 is of the base spans' listing ``kind:start:end``, comma-joined; both listings are empty
    strings without spans.  Repeated ids keep a row each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, digests, lists = {k: [] for k in BASE_KINDS}, [], []
            for t in b.column(1):
                spans = find_spans(t.as_py())
                base = [x for x in spans if x[0] in counts]
                for k in BASE_KINDS:
                    counts[k].append(sum(x[0] == k for x in base))
                digests.append(hashlib.sha256(listing(base).encode()).hexdigest())
                lists.append(listing(spans))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(counts[k], pa.int64()) for k in BASE_KINDS), pa.array(digests, pa.string()), pa.array(lists, pa.string())],
                names=[id_col, *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced; all columns and rows stay, null texts stay null."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(redact, na_action="ignore")

    return docs.withColumn(text_col, clean(F.col(text_col).cast("string")))
