"""Personal data by anchor expansion.

An Aho-Corasick automaton finds at-signs, schemes and identifier cues; a parser for each kind of anchor expands to both sides and
validates what it finds. Numbers have no rarer anchor than their digits, so their parsers walk the runs of digits.

Kinds: email, ip, card and phone as the base definitions have them, and from the method url (after a scheme), handle (an at-sign
with a name behind it and none before it), iban (validated by its remainder), account (a cue such as "account" or "ssn"
followed by an identifier) and secret (a cue such as "token" with a value of 16 characters or more, letters and digits both). The added kinds take only what no base span covers. Positions are code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .common import arrow_rows, in_chunks

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "iban", "account", "handle", "secret")
#: Anchors of the added kinds.
SCHEMES = ("http://", "https://", "ftp://", "mailto:")
CUES = ("account", "acct", "iban", "passport", "ssn", "social security", "customer id", "user id", "member id", "licence", "license no")

SECRETS = ("token", "secret", "password", "passwd", "api key", "api_key", "apikey", "api-key", "access key", "access_key", "private key", "private_key")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL = re.compile(r"[A-Za-z0-9\-._~:/?#\[\]@!$&'()*+,;=%]+")
_LEAD = re.compile(r"(?:\s?(?:number|no\.?|nr\.?|id|code|#))?\s?[:#=]\s?")
_IDENT = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9]|[-/](?=[A-Za-z0-9])){4,33}(?![A-Za-z0-9])")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_VALUE = re.compile(r"\s?[:=]{1,2}\s?[\"'`]?([A-Za-z0-9_\-+/.~]{16,}+={0,2})")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]{2,30}")


def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for w in ("@", *SCHEMES, *CUES, *SECRETS):
        out.add_word(w, w)
    out.make_automaton()
    return out


_ANCHORS = _automaton()


_SECRETS = frozenset(SECRETS)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def emails(text: str, ats: list[int]) -> list[tuple[int, int]]:
    """Leftmost and not overlapping, from the at-signs' places in order: the longest local part that stands behind the last
    match, and as long a domain of two labels or more."""
    out, last = [], 0
    for at in ats:
        if at < last:
            continue
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            last = m.end()
            out.append((start, last))
    return out


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind in the order of KINDS."""
    low = text.lower()
    if len(low) != len(text):  # a few letters grow in lower case; positions must hold
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    hits = [(end + 1 - len(w), w) for end, w in _ANCHORS.iter(low)]
    ats = [i for i, w in hits if w == "@"]
    out = [(a, b, "email") for a, b in emails(text, ats)]
    for m in _IP.finditer(text):
        if all(len(d := p.lstrip("0")) <= 3 and int(d or 0) <= 255 for p in m[0].split(".")):
            out.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append((*m.span(), "phone"))
    if hits:
        # what is covered, as ascending runs that do not overlap
        begins, ends = [], []
        for a, b, _ in sorted(out):
            if begins and a < ends[-1]:
                ends[-1] = max(ends[-1], b)
            else:
                begins.append(a)
                ends.append(b)

        def add(kind: str, a: int, b: int) -> None:
            i = bisect_left(begins, b)
            if not i or ends[i - 1] <= a:
                begins.insert(i, a)
                ends.insert(i, b)
                out.append((a, b, kind))

        for at, w in hits:
            if w == "mailto:" or w == "@":
                continue
            if w in SCHEMES:
                if (at == 0 or not text[at - 1].isalnum()) and (m := _URL.match(text, at + len(w))):
                    end = m.start() + len(m[0].rstrip(".,;:!?'()[]"))
                    if "." in text[m.start() : end]:
                        add("url", at, end)
            elif w in _SECRETS:
                if (m := _VALUE.match(text, at + len(w))) and any(c.isdigit() for c in m[1]) and any(c.isalpha() for c in m[1]):
                    add("secret", *m.span(1))
            elif at == 0 or not text[at - 1].isalnum():
                if m := _LEAD.match(text, at + len(w)):
                    iban, ident = _IBAN.match(text, m.end()), _IDENT.match(text, m.end())
                    if iban and _iban_ok(iban[0]):
                        add("iban", *iban.span())
                    elif ident and sum(map(str.isdigit, ident[0])) >= 4:
                        add("account", *ident.span())
        for at in ats:
            if (at == 0 or text[at - 1].isspace()) and (m := _NAME.match(text, at + 1)):
                add("handle", at, m.end())
    rank = {k: i for i, k in enumerate(KINDS)}
    return sorted(out, key=lambda x: (x[0], rank[x[2]], x[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Each span, or run of spans that overlap, becomes the first one's kind in brackets."""
    out, last = [], 0
    for a, b, k in spans:
        if a >= last:
            out += [text[last:a], f"[{k.upper()}]"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans), a row for each row. A null text counts as empty: no spans."""
    ship(docs.sparkSession)

    def run(batches):
        for chunk in in_chunks(arrow_rows(batches, "doc_id", "text"), 1):
            found = [find(t or "") for _, t in chunk]
            base = [[s for s in x if s[2] in BASE_KINDS] for x in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in chunk], pa.int64())] + [pa.array([sum(s[2] == k for s in x) for x in base], pa.int64()) for k in BASE_KINDS] + [pa.array([hashlib.sha256(joined(x).encode()).hexdigest() for x in base], pa.string()), pa.array([joined(x) for x in found], pa.string())],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(docs: DataFrame) -> DataFrame:
    """documents with each span of personal data in text replaced by its kind, and n_chars, if there is one, counted anew. All rows stay; null texts stay null."""
    ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index("text")
            texts = [None if t is None else redact(t, find(t)) for (t,) in arrow_rows([b], "text")]
            cols = list(b.columns)
            cols[at] = pa.array(texts, b.schema.field(at).type)
            if (n := b.schema.get_field_index("n_chars")) >= 0:
                cols[n] = pa.array([None if t is None else len(t) for t in texts], b.schema.field(n).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
