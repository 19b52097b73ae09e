"""Personal data by anchor expansion.

One Aho-Corasick automaton finds anchors in the whole text: at-signs, `://`, plus
signs, digits, and cue words of identifiers. Each anchor hands over to a small
deterministic parser that expands left and right to the boundaries of an email, a
URL, an IP address, a card, a phone number, an account or a street address, and
validates it. Every parser moves forward only, so a text is read in linear time
however long its runs are.

Base kinds are leftmost, non-overlapping per kind, with no second try after a failed
check: `email`, `ip` (parts at most 255), `card` (16 to 19 digits, Luhn), `phone` (8
to 15 digits). Added kinds: `url` (scheme and host), `iban` (cue, country, length 15 to
34, checksum 97), `ssn` (cue, nine digits), `account` (cue, 6 to 17 digits), `address`
(street cue with a house number next to it).

Positions are code points, the end exclusive. A null or empty text has no span. An
empty table gives no rows; other columns pass through unchanged.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelwise.llm import tables
from parcelwise.llm import textarrays as X

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "iban", "ssn", "account", "address")
Span = tuple[int, int]

_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_DIGIT = frozenset("0123456789")
_LOCAL = _ALNUM | frozenset("._%+-")
_LABEL = _ALNUM | frozenset("-")
_PHONE = _DIGIT | frozenset(" ().-")
_SCHEMES = ("http", "https", "ftp", "ftps", "ssh", "mailto")
_CUES = {
    "iban": ("IBAN", "iban", "Iban"),
    "ssn": ("SSN", "ssn", "Social Security"),
    "account": ("account", "Account", "acct", "Acct", "Konto", "cuenta", "Cuenta", "compte", "Compte"),
    "address": (" Street", " Avenue", " Road", " Boulevard", " Lane", " Drive", "straße", "strasse", " Straße", "rue ", "Rue ", "calle ", "Calle "),
}


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for sign, kind in (("@", "email"), ("+", "phone"), ("://", "url")):
        a.add_word(sign, (kind, len(sign)))
    for d in "0123456789":
        a.add_word(d, ("digit", 1))
    for kind, cues in _CUES.items():
        for cue in cues:
            a.add_word(cue, (kind, len(cue)))
    a.make_automaton()
    return a


def _run(text: str, at: int, chars: frozenset) -> int:
    """First position from `at` on whose character is not in `chars`."""
    n = len(text)
    while at < n and text[at] in chars:
        at += 1
    return at


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def parse_email(text: str, at: int, floor: int) -> tuple[Span | None, int]:
    """Around the at-sign at `at`; nothing before `floor` belongs to it. Also where the next email may begin."""
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    end = _run(text, at + 1, _LABEL)
    if start == at or end == at + 1:
        return None, floor
    labels = 1
    while end < len(text) and text[end] == ".":
        stop = _run(text, end + 1, _LABEL)
        if stop == end + 1:
            break
        end, labels = stop, labels + 1
    return ((start, end), end) if labels > 1 else (None, floor)


def parse_ips(text: str, at: int) -> tuple[list[Span], int]:
    """Addresses in the chain of dotted numbers that begins at `at`, and the chain's end."""
    parts, end = [], at
    while True:
        stop = _run(text, end, _DIGIT)
        parts.append((end, stop))
        if stop + 1 < len(text) and text[stop] == "." and text[stop + 1] in _DIGIT:
            end = stop + 1
        else:
            break
    spans = []
    for k in range(0, len(parts) - 3, 4):
        if all(int(text[a:b].lstrip("0")[:4] or "0") <= 255 for a, b in parts[k : k + 4]):
            spans.append((parts[k][0], parts[k + 3][1]))
    return spans, stop


def parse_card(text: str, at: int) -> tuple[Span | None, int]:
    """The chain of digits with single spaces or hyphens that begins at `at`, and its end."""
    end = at
    while True:
        end = _run(text, end, _DIGIT)
        if end + 1 < len(text) and text[end] in " -" and text[end + 1] in _DIGIT:
            end += 1
        else:
            break
    digits = text[at:end].replace(" ", "").replace("-", "")
    return ((at, end) if 16 <= len(digits) <= 19 and _luhn(digits) else None), end


def parse_phone(text: str, at: int) -> tuple[Span | None, int]:
    """From the plus sign at `at`; also where the next number may begin."""
    if at + 1 >= len(text) or text[at + 1] not in _DIGIT:
        return None, at + 1
    end = _run(text, at + 2, _PHONE)
    while end > at + 3 and text[end - 1] not in _DIGIT:
        end -= 1
    if end <= at + 3 or text[end - 1] not in _DIGIT:
        return None, at + 1
    digits = sum(c in _DIGIT for c in text[at:end])
    return ((at, end) if 8 <= digits <= 15 else None), end


def parse_url(text: str, at: int, floor: int) -> Span | None:
    """Around the `://` at `at`: a known scheme, a host, and what follows up to white space or a quote."""
    start = at
    while start > floor and text[start - 1] in _ALNUM:
        start -= 1
    if text[start:at].lower() not in _SCHEMES:
        return None
    host = _run(text, at + 3, _LABEL | frozenset("."))
    if not any(c in _ALNUM for c in text[at + 3 : host]):
        return None
    end = host
    while end < len(text) and not text[end].isspace() and text[end] not in "\"'<>`":
        end += 1
    while text[end - 1] in ".,;:!?)]}":
        end -= 1
    return start, end


_IBAN = re.compile(r"[\s:#.]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})")
_SSN = re.compile(r"[^0-9\n]{0,12}([0-9]{3}[- ]?[0-9]{2}[- ]?[0-9]{4})(?![0-9])")
_ACCOUNT = re.compile(r"[^0-9\n]{0,16}([0-9]{6,17})(?![0-9])")
_HOUSE_AFTER = re.compile(r"[\w.' -]{0,30}?\s([0-9]{1,5}[a-zA-Z]?)\b")
_HOUSE_BEFORE = re.compile(r"([0-9]{1,5}[a-zA-Z]?,?(?: [A-ZÀ-Ý][\w.'-]{0,24}){1,4})$")


def parse_iban(text: str, end: int) -> Span | None:
    m = _IBAN.match(text, end)
    if not m:
        return None
    raw = m[1]
    while len(raw.replace(" ", "")) >= 15:
        code = raw.replace(" ", "")
        if int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
            return m.start(1), m.start(1) + len(raw)
        raw = raw[:-1].rstrip(" ")
    return None


def parse_ssn(text: str, end: int) -> Span | None:
    m = _SSN.match(text, end)
    if not m or (d := re.sub("[- ]", "", m[1]))[:3] in ("000", "666") or d[0] == "9" or d[3:5] == "00" or d[5:] == "0000":
        return None
    return m.span(1)


def parse_account(text: str, end: int) -> Span | None:
    m = _ACCOUNT.match(text, end)
    return m.span(1) if m else None


def parse_address(text: str, start: int, end: int) -> Span | None:
    """A street cue with a house number before it (`12 Long Street`) or after it (`Hauptstraße 12`)."""
    before = _HOUSE_BEFORE.search(text[max(0, start - 90) : start])
    if before and text[start] == " ":
        return start - len(before[1]), end
    after = _HOUSE_AFTER.match(text, end - 1 if text[end - 1] == " " else end)
    if not after:
        return None
    while start > max(0, end - 60) and text[start - 1].isalpha():
        start -= 1
    return start, after.end(1)


class Finder:
    """Finds all spans of a text; built once per task."""

    def __init__(self) -> None:
        self.anchors = _automaton()

    def __call__(self, text: str) -> dict[str, list[Span]]:
        found: dict[str, list[Span]] = {k: [] for k in KINDS}
        floor = dict.fromkeys((*KINDS, "chain", "digits"), 0)
        cued: dict[str, Callable[[str, int], Span | None]] = {"iban": parse_iban, "ssn": parse_ssn, "account": parse_account}
        for last, (kind, length) in self.anchors.iter(text):
            at = last - length + 1
            span: Span | None = None
            if kind == "digit":
                if at >= floor["chain"]:
                    spans, floor["chain"] = parse_ips(text, at)
                    found["ip"] += spans
                if at >= floor["digits"]:
                    span, floor["digits"] = parse_card(text, at)
                    kind = "card"
            elif at < floor[kind]:
                continue
            elif kind == "email":
                span, floor[kind] = parse_email(text, at, floor[kind])
            elif kind == "phone":
                span, floor[kind] = parse_phone(text, at)
            elif kind == "url":
                span = parse_url(text, at, floor[kind])
                floor[kind] = span[1] if span else floor[kind]
            elif kind == "address":
                span = parse_address(text, at, last + 1)
                if span and span[0] < floor[kind]:
                    span = None
                floor[kind] = span[1] if span else floor[kind]
            else:
                span = cued[kind](text, last + 1)
                floor[kind] = span[1] if span else floor[kind]
            if span:
                found[kind].append(span)
        return found


def joined(found: dict[str, list[Span]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in found[k])


def redacted(text: str, found: dict[str, list[Span]]) -> str:
    """Replace each span by its kind in brackets; overlapping spans become one, named by the first kind listed."""
    spans = sorted((a, b, rank, k) for rank, k in enumerate(KINDS) for a, b in found[k])
    merged: list[list] = []
    for a, b, rank, kind in spans:
        if merged and a < merged[-1][1]:
            top = merged[-1]
            top[1] = max(top[1], b)
            if rank < top[2]:
                top[2:] = [rank, kind]
        else:
            merged.append([a, b, rank, kind])
    out, done = [], 0
    for a, b, _, kind in merged:
        out += [text[done:a], f"[{kind.upper()}]"]
        done = b
    return "".join([*out, text[done:]])


NAMES = ("pii_spans", "pii_redacted")


def detect(docs: DataFrame, text: str = "text", names: tuple[str, str] = NAMES) -> DataFrame:
    """Add the spans (array of kind, start, end) and the text without them; columns of these names are replaced."""
    docs = docs.drop(*names)
    place = docs.columns.index(text)
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.ArrayType(span)), T.StructField(names[1], T.StringType())])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder()
        for whole in batches:
            named = whole.rename_columns([f"c{i}" for i in range(whole.num_columns)])
            for batch in X.slices(iter([named]), f"c{place}"):
                spans, clean = [], []
                for x in batch.column(place).to_pylist():
                    found = find(x or "")
                    spans.append([{"kind": k, "start": a, "end": b} for k in KINDS for a, b in found[k]])
                    clean.append(x if x is None else redacted(x, found))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, arrow), pa.array(clean, pa.string())], names=[*whole.schema.names, *names])

    return docs.mapInArrow(run, schema)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(tables.documents(spark, sf_dir).select("doc_id", "text"))
    as_text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("pii_spans", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("pii_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(as_text(base).cast("binary"), 256).alias("base_sha256"), as_text(F.col("pii_spans")).alias("spans"))


QUERIES = {"op1_pii": op1_pii}
ORACLES: dict[str, str] = {}
