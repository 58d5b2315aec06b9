"""Personal data by anchor expansion.

One Aho-Corasick automaton finds anchors in a text: at-signs, plus signs, digits, URL schemes and identifier cues. From
each anchor a deterministic parser expands to the left and right, finds the boundaries and validates. The parsers give
exactly the leftmost non-overlapping matches of

- email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
- ip    ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)``, each part at most 255
- card  ``[0-9]([\\x20-]?[0-9])+``, 16 to 19 digits that pass Luhn
- phone ``\\+[0-9][\\x20().0-9-]+[0-9]``, 8 to 15 digits

(a match that fails its check is dropped, and the search goes on behind it). Beyond these, schemes and cues give
``url`` (an address with a user part), ``iban`` (by country code, length and mod 97), ``key`` (access key ids) and
``secret`` (values of identifiers such as ``password``, in any case, behind ``=`` or ``:`` with spaces and quotes as they
come; at least 6 characters). A value without quotes that stands apart from its ``=`` or behind a colon may be prose, so it
needs a digit, or a capital behind a small letter. Positions are code points, the end exclusive.

Every anchor's work is bounded by what it finds: parsers that start within one run of characters share its end and what it
holds, so a text that is full of cues takes time in proportion to its length.

Defined cases: rows are judged one by one, by a plain map: null and empty texts have no spans, very long texts are scanned
whole, repeated rows repeat, an empty table gives no rows, other columns pass untouched, whatever their names (``redact``
changes the text, and the column that holds its length, if it is named and there).
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# The kinds in the order of the result, and the characters of the grammars.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "iban", "key", "secret")
DIGITS = frozenset("0123456789")
LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
LOCAL = LETTERS | DIGITS | frozenset("._%+-")
LABEL = LETTERS | DIGITS | frozenset("-")
PHONE = DIGITS | frozenset(" ().-")
UPPER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
SCHEMES = ("http://", "https://", "ftp://", "ssh://")
SECRET_CUES = ("password", "passwd", "passphrase", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key", "accesskey", "secret_key", "private_key")
KEY_CUES = ("AKIA", "ASIA")
#: The length of an IBAN by country.
IBANS = dict(
    AD=24, AE=23, AL=28, AT=20, AZ=28, BA=20, BE=16, BG=22, BH=22, BI=27, BR=29, BY=28, CH=21, CR=22, CY=28, CZ=24, DE=22, DJ=27, DK=18, DO=28,
    EE=20, EG=29, ES=24, FI=18, FK=18, FO=18, FR=27, GB=22, GE=22, GI=23, GL=18, GR=27, GT=28, HN=28, HR=21, HU=28, IE=22, IL=23, IQ=23, IS=26,
    IT=27, JO=30, KW=30, KZ=20, LB=28, LC=32, LI=21, LT=20, LU=20, LV=21, LY=25, MC=27, MD=24, ME=22, MK=19, MN=20, MR=27, MT=31, MU=30, NI=28,
    NL=18, NO=15, OM=23, PK=24, PL=28, PS=29, PT=25, QA=29, RO=24, RS=22, RU=33, SA=24, SC=31, SD=18, SE=24, SI=19, SK=24, SM=27, SO=23, ST=25,
    SV=28, TL=23, TN=24, TR=26, UA=29, VA=22, VG=24, XK=20, YE=30,
    AO=25, BF=28, BJ=28, CF=27, CG=27, CI=28, CM=27, CV=25, DZ=26, GA=27, GQ=27, GW=25, IR=26, KM=27, MA=28, MG=27, ML=28, MZ=25, NE=28, SN=28, TD=27, TG=28,
)
SPACES = frozenset(" \t\n\r\x0b\x0c")
QUOTES = frozenset("\"'`")
ALNUM = LETTERS | DIGITS
_URL_STOP, _HOST = re.compile("[ \t\n\r\x0b\x0c\"'<>)]"), re.compile(r"[^/?#]*")
_VALUE_STOP, _LOWER = re.compile("[ \t\n\r\x0b\x0c\"'<>,;]"), re.compile("[a-z]")
_automaton = None


class Runs:
    """Runs of a text up to a stop, each found once. Positions that are asked for only grow."""

    def __init__(self, text: str):
        self.text, self.ends = text, {}
        self.digit = self.upper = self.lower = -1  # of the run of a value: its last digit, last capital, next small letter

    def end(self, at: int, stop: re.Pattern) -> int:
        first, end = self.ends.get(stop, (0, -1))
        if not first <= at <= end:
            found = stop.search(self.text, at)
            end = found.start() if found else len(self.text)
            self.ends[stop] = at, end
            if stop is _VALUE_STOP:
                self.digit, self.upper = (max(self.text.rfind(c, at, end) for c in kind) for kind in (DIGITS, UPPER))
        return end

    def looks_made(self, at: int, end: int) -> bool:
        """Whether the value from here to its run's end has a digit, or a capital behind a small letter."""
        if self.digit >= at:
            return True
        if self.upper < at:
            return False
        if not at <= self.lower:
            found = _LOWER.search(self.text, at)
            self.lower = found.start() if found else len(self.text)
        return self.lower < self.upper


def automaton():
    """Anchors: cue -> kind. Built once in each worker."""
    global _automaton
    if _automaton is None:
        import ahocorasick

        _automaton = ahocorasick.Automaton()
        for kind, cues in (("@", "@"), ("+", "+"), ("0", DIGITS), ("url", SCHEMES), ("key", KEY_CUES), ("iban", IBANS)):
            for cue in cues:
                _automaton.add_word(cue, (kind, len(cue)))
        for cue in SECRET_CUES:
            for spelt in itertools.product(*({c, c.upper()} for c in cue)):  # in any case
                _automaton.add_word("".join(spelt), ("secret", len(cue)))
        _automaton.make_automaton()
    return _automaton


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _run(text: str, i: int, allowed: frozenset) -> int:
    n = len(text)
    while i < n and text[i] in allowed:
        i += 1
    return i


def expand_email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    end = _run(text, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    labels = 0
    while end < len(text) and text[end] == "." and (stop := _run(text, end + 1, LABEL)) > end + 1:
        end, labels = stop, labels + 1
    return (start, end) if labels else None


def expand_phone(text: str, at: int) -> tuple[int, int] | None:
    if at + 1 >= len(text) or text[at + 1] not in DIGITS:
        return None
    end = _run(text, at + 2, PHONE)
    while end > at + 3 and text[end - 1] not in DIGITS:
        end -= 1
    return (at, end) if end > at + 3 and text[end - 1] in DIGITS else None


def valid_phone(match: str) -> bool:
    return 8 <= sum(c in DIGITS for c in match) <= 15


def expand_card(text: str, at: int) -> tuple[int, int]:
    """From a digit to the end of the digits that single spaces or hyphens join."""
    end = at + 1
    while True:
        end = _run(text, end, DIGITS)
        if end + 1 < len(text) and text[end] in " -" and text[end + 1] in DIGITS:
            end += 2
        else:
            return at, end


def valid_card(match: str) -> bool:
    digits = "".join(c for c in match if c in DIGITS)
    return 16 <= len(digits) <= 19 and luhn(digits)


def expand_ip(text: str, at: int) -> tuple[tuple[int, int] | None, int]:
    """Four dotted numbers from a digit on, if there, and where the search goes on."""
    end, parts = _run(text, at, DIGITS), 1
    while parts < 4 and end < len(text) and text[end] == "." and (stop := _run(text, end + 1, DIGITS)) > end + 1:
        end, parts = stop, parts + 1
    return ((at, end) if parts == 4 else None), end


def valid_ip(match: str) -> bool:
    return all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in match.split("."))


def expand_url(text: str, start: int, after: int, runs: Runs) -> tuple[int, int] | None:
    """An address with a user part before its host."""
    end = runs.end(after, _URL_STOP)
    return (start, end) if text.find("@", after + 1, _HOST.match(text, after, end).end()) >= 0 else None


def expand_iban(text: str, start: int) -> tuple[int, int] | None:
    """From a country code on, the characters in groups that single spaces or hyphens join, as many as the country has."""
    if start and text[start - 1] in ALNUM or start + 2 >= len(text) or text[start + 2] not in DIGITS:
        return None
    end, chars, size = start, [], IBANS[text[start : start + 2]]
    while len(chars) < size:
        if end < len(text) and chars and text[end] in " -":
            end += 1
        if end >= len(text) or text[end] not in ALNUM:
            return None
        chars.append(text[end].upper())
        end += 1
    whole = "".join(chars)
    alone = end == len(text) or text[end] not in ALNUM
    return (start, end) if alone and whole[3] in DIGITS and int("".join(str(int(c, 36)) for c in whole[4:] + whole[:4])) % 97 == 1 else None


def expand_key(text: str, start: int, after: int) -> tuple[int, int] | None:
    if start and text[start - 1] in ALNUM:
        return None
    end = after
    while end < len(text) and (text[end] in UPPER or text[end] in DIGITS):
        end += 1
    return (start, end) if end - start == 20 else None


def expand_secret(text: str, after: int, runs: Runs) -> tuple[int, int] | None:
    """The value behind an identifier: past its closing quote, spaces, ``=``, ``:``, ``:=`` or ``=>``, and an opening quote."""
    n, at = len(text), after
    if at < n and text[at] == "\\":  # quotes within a quoted text
        at += 1
    if at < n and text[at] in QUOTES:
        at += 1
    at = _run(text, at, SPACES)
    if at >= n or text[at] not in "=:":
        return None
    sign = at
    at = _run(text, at, frozenset("=:>"))
    close = at == after + 1 and text[sign] == "="
    at = _run(text, at, SPACES)
    close &= at == sign + 1
    if at < n and text[at] == "\\":
        at += 1
    if at < n and text[at] in QUOTES:
        quote, start = text[at], at + 1
        end = start
        while end < n and text[end] not in "\n\r" and text[end] != quote:
            end += 2 if text[end] == "\\" and end + 1 < n and text[end + 1] == quote and text[start - 2] != "\\" else 1
        if end < n and text[end] == quote:
            end -= text[end - 1] == "\\"
            return (start, end) if end - start >= 6 else None
        at = start  # no closing quote on the line
    end = runs.end(at, _VALUE_STOP)
    return (at, end) if end - at >= 6 and (close or runs.looks_made(at, end)) else None


def find(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, in order, none overlapping another of its kind."""
    spans: dict[str, list[tuple[int, int]]] = defaultdict(list)
    floor: dict[str, int] = defaultdict(int)  # where the last match of a kind ended
    runs = Runs(text)

    def took(kind: str, span: tuple[int, int] | None, valid=None) -> None:
        if span and span[0] >= floor[kind]:
            floor[kind] = span[1]
            if valid is None or valid(text[span[0] : span[1]]):
                spans[kind].append(span)

    for last, (anchor, length) in automaton().iter(text):
        start = last - length + 1
        if anchor == "0":
            if start >= floor["card"]:
                span = expand_card(text, start)
                floor["card"] = span[1]
                if span[1] - span[0] > 1 and valid_card(text[span[0] : span[1]]):
                    spans["card"].append(span)
            if start >= floor["ip"]:
                span, floor["ip"] = expand_ip(text, start)
                if span and valid_ip(text[span[0] : span[1]]):
                    spans["ip"].append(span)
        elif anchor == "@":
            if start >= floor["email"]:
                took("email", expand_email(text, start, floor["email"]))
        elif anchor == "+":
            if start >= floor["phone"]:
                took("phone", expand_phone(text, start), valid_phone)
        elif anchor == "url":
            if start >= floor["url"]:
                took("url", expand_url(text, start, last + 1, runs))
        elif anchor == "iban":
            took("iban", expand_iban(text, start))
        elif anchor == "key":
            took("key", expand_key(text, start, last + 1))
        elif last + 1 >= floor["secret"]:
            took("secret", expand_secret(text, last + 1, runs))
    return spans


def listed(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans.get(k, ()))


def redacted(text: str, spans: dict[str, list[tuple[int, int]]]) -> str:
    """The text with each run of overlapping spans replaced by the name of its first kind (the earliest, then the longest)."""
    out, at = [], 0
    whole = sorted(((a, b, k) for k, v in spans.items() for a, b in v), key=lambda x: (x[0], -x[1], KINDS.index(x[2])))
    for i, (a, b, k) in enumerate(whole):
        if i and a < at:
            at = max(at, b)
            continue
        out += [text[at:a], f"[{k.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def detect(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone, base_sha256, spans."""

    def scan(batches):
        for batch in common.slices(batches):
            found = [find(x) if x else {} for x in batch.column(1).to_pylist()]
            counts = [pa.array([len(x.get(k, ())) for x in found], pa.int64()) for k in BASE_KINDS]
            hashed = pa.array([hashlib.sha256(listed(x, BASE_KINDS).encode()).hexdigest() for x in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, hashed, pa.array([listed(x, KINDS) for x in found], pa.string())], names=["key", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    part = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    return part.mapInArrow(scan, f"key {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string").withColumnRenamed("key", key)


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The documents with personal data replaced by [KIND]; ``length`` names a column that holds the text's length, if any."""
    length = length if length in docs.columns else None

    def rewrite(batches):
        for batch in common.slices(batches):
            names = batch.schema.names
            texts = batch.column(names.index(text)).to_pylist()
            fixed = [x if not x or not (found := find(x)) else redacted(x, found) for x in texts]
            if length:
                at = names.index(length)
                old = batch.column(at).to_pylist()
                batch = batch.set_column(at, batch.schema.field(at), pa.array([n if a == b else len(b) for n, a, b in zip(old, texts, fixed, strict=True)], batch.schema.field(at).type))
            yield batch.set_column(names.index(text), batch.schema.field(names.index(text)), pa.array(fixed, batch.schema.field(names.index(text)).type))

    return docs.mapInArrow(rewrite, docs.schema)
