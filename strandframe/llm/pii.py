"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over a text: at-signs, plus signs, digits, "://" and cue words.
From each anchor a deterministic local parser expands to the left and right, decides the boundary and validates.
Each kind remembers where its last match ended, so its spans are the leftmost non-overlapping ones and no place is
scanned twice.

Base kinds are email, ip, card and phone. The method adds: url (an address with user data, from "://"), secret (the
value after a cue such as token or password), iban (after its cue, mod-97 checked) and address (number and street,
from the street word). Added spans stand beside the base ones and never change them.

Null or empty text: no spans. Each row gets a row, ids and other columns as they are. Positions are code points, the
end exclusive. A text of any length is scanned whole, in time linear in it.
"""

from __future__ import annotations

import re
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _units as u
from ._shared import extended

BASE = ("email", "ip", "card", "phone")
ADDED = ("url", "secret", "iban", "address")
KINDS = BASE + ADDED

# The character classes and limits of each kind, and the cues.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DIGITS = re.compile(r"[0-9]+")
IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])*")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{0,19}\Z")
URL_REST = re.compile(r"[^\s<>\"'/@]+@[^\s<>\"']+")
ASSIGNED = re.compile(r"[\"']?[ \t]{0,3}[:=][ \t]{0,3}[\"']?([A-Za-z0-9_+/=.-]{12,})")
IBAN = re.compile(r"[: \t]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})")
STREET = re.compile(r"[0-9]{1,5} (?:[A-Z][a-z]{1,20} ){1,3}\Z")
SECRET_CUES = ("token", "secret", "password", "passwd", "api_key", "apikey", "access_key", "private_key")
STREET_CUES = ("Street", "Avenue", "Boulevard", "Road", "Lane", "Drive")


@cache
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    keys = {"@": "email", "+": "phone", "://": "url"} | dict.fromkeys("0123456789", "digit")
    keys |= {form: "secret" for cue in SECRET_CUES for form in (cue, cue.upper(), cue.capitalize())}
    keys |= {"IBAN": "iban"} | dict.fromkeys(STREET_CUES, "address")
    for key, kind in keys.items():
        a.add_word(key, (kind, len(key)))
    a.make_automaton()
    return a


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    back = [int(c) for c in reversed(digits)]
    return (sum(back[::2]) + sum(sum(divmod(2 * d, 10)) for d in back[1::2])) % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def find(text: str) -> list[tuple[str, int, int]]:
    """Every span (kind, start, end), by kind as in KINDS, then start."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done = dict.fromkeys(KINDS, 0)

    def keep(kind: str, start: int, end: int) -> None:
        out[kind].append((start, end))

    for last, (kind, size) in automaton().iter(text):
        at = last - size + 1
        if kind == "digit":
            if at >= done["card"]:
                m = CARD.match(text, at)
                done["card"] = m.end()
                if m.end() - at >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                    keep("card", at, m.end())
            if at >= done["ip"]:
                m = IP.match(text, at)
                done["ip"] = (m or DIGITS.match(text, at)).end()
                if m and all(map(_octet, m.groups())):
                    keep("ip", at, m.end())
        elif kind == "email":
            start = at
            while start > done["email"] and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                done["email"] = m.end()
                keep("email", start, m.end())
        elif kind == "phone":
            if at >= done["phone"] and (m := PHONE.match(text, at)):
                done["phone"] = m.end()
                if 9 <= len(_digits(m[0])) <= 15:
                    keep("phone", at, m.end())
        elif kind == "url":
            m, rest = SCHEME.search(text[max(0, at - 20) : at]), URL_REST.match(text, last + 1)
            if m and rest and at >= done["url"]:
                end = last + 1 + len(rest[0].rstrip(".,;:!?)"))
                done["url"] = end
                keep("url", at - len(m[0]), end)
        elif kind == "secret":
            m = ASSIGNED.match(text, last + 1)
            if m and m.start(1) >= done["secret"] and re.search("[0-9]", m[1]) and re.search("[A-Za-z]", m[1]):
                done["secret"] = m.end(1)
                keep("secret", m.start(1), m.end(1))
        elif kind == "iban":
            if (m := IBAN.match(text, last + 1)) and m.start(1) >= done["iban"]:
                code = m[1].replace(" ", "")
                if int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
                    done["iban"] = m.end(1)
                    keep("iban", m.start(1), m.end(1))
        elif kind == "address":
            low = max(0, at - 90)
            m = STREET.search(text[low:at])
            if m and low + m.start() >= done["address"] and not text[last + 1 : last + 2].isalpha():
                done["address"] = last + 1
                keep("address", low + m.start(), last + 1)
    return [(k, s, e) for k in KINDS for s, e in out[k]]


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with each span, and each union of overlapping ones, replaced by the name of the kind listed first in it."""
    merged: list[list] = []
    for kind, start, end in sorted(spans, key=lambda s: (s[1], s[2])):
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
            merged[-1][0] = min(merged[-1][0], kind, key=KINDS.index)
        else:
            merged.append([kind, start, end])
    parts, at = [], 0
    for kind, start, end in merged:
        parts += [text[at:start], f"<{kind.upper()}>"]
        at = end
    return "".join([*parts, text[at:]])


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def find_spans(docs: DataFrame, text_col: str = "text", spans_col: str = "pii_spans") -> DataFrame:
    """docs with a column of all spans, array<struct<kind, start, end>>; an older column of that name is replaced."""

    def run(batches):
        for b, _, _ in u.chunks(batches, text_col):
            found = [find(t) if t else [] for t in b.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in x] for x in found], pa.list_(_SPAN))], [*b.schema.names, spans_col])

    docs = docs.drop(spans_col)
    return docs.mapInArrow(run, extended(docs, {spans_col: "array<struct<kind string, start int, end int>>"}))


def digest(docs: DataFrame) -> DataFrame:
    """A row a document: doc_id, the count of each base kind, the digest of the base spans, and all spans."""
    found = find_spans(docs.select("doc_id", "text")).drop("text")

    def of(*kinds):
        return F.filter("pii_spans", lambda s: s["kind"].isin(*kinds))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    return found.select(
        "doc_id",
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(listed(of(*BASE)), 256).alias("base_sha256"),
        listed(F.col("pii_spans")).alias("spans"),
    )


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs, all columns, with personal data in the text replaced by the kind's name; null stays null."""
    place = docs.columns.index(text_col)

    def run(batches):
        for b, _, _ in u.chunks(batches, text_col):
            texts = [t and redact(t, find(t)) for t in b.column(text_col).to_pylist()]
            yield b.set_column(place, b.schema.field(place), pa.array(texts, b.schema.field(place).type))

    return docs.mapInArrow(run, docs.schema)
