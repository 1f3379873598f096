"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

Every proposal has a kind, a span and a score, which words of its context raise and words of doubt
lower. Base kinds (email, ip, card, phone) are kept at any score; the others need a checksum or a word of
their context to reach the limit. All patterns run in time linear in the text: each is tried from the
one place where a match can begin, and overlaps are found by bisection.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from .arrowtext import slices

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "local_phone", "ipv6", "secret", "key")
BASE = KINDS[:4]
#: A proposal below this score is dropped. A confirmed checksum alone reaches it, a bare pattern doesn't.
LIMIT = 0.7
#: Characters on either side in which context words count.
NEAR = 48

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{2}[0-9]{2}(?:\x20?[A-Za-z0-9]{4}){2,7}(?:\x20?[A-Za-z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_NATIONAL = re.compile(r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])")
_DIGITS = re.compile(r"[0-9]")

_IPV6 = re.compile(r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f]{0,4}:)[0-9A-Fa-f:.]++(?![0-9A-Za-z])")
#: What a name of a secret, quoted or not, is set to: up to the closing quote or white space, however long.
_SECRET = re.compile(
    r"(?i)(?<![a-z])(?:token|secret|passw(?:or)?d|pwd|passphrase|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?secret|auth(?:orization)?)[\"']?"
    r"[\x20\t]*+(=>|:=|[:=])[\x20\t]*+(?:bearer\x20++)?(?:\"([^\"\n]++)\"|'([^'\n]++)'|([^\s\"'<>]++))"
)
#: Keys known by how they begin, and hexadecimal digests, of any length from the shortest on.
_KEY = re.compile(r"(?<![A-Za-z0-9_-])(?:AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|xox[abpr]-[A-Za-z0-9-]{10,}+|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+|[0-9a-fA-F]{32,}+)(?![A-Za-z0-9])")

#: Words that raise a kind's score, and words that lower any score.
CONTEXT = {
    "email": re.compile(r"(?i)\b(?:e-?mail|mailto|contact|write to|courriel|correo)\b"),
    "ip": re.compile(r"(?i)\b(?:ip|address|host|server|client|login|from)\b"),
    "card": re.compile(r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta|cvv|expires)\b"),
    "phone": re.compile(r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|telefon|t[ée]l[ée]phone|tel[ée]fono)\b"),
    "iban": re.compile(r"(?i)\b(?:iban|account|bank|konto|compte|cuenta)\b"),
    "ssn": re.compile(r"(?i)\b(?:ssn|social security|tax id)\b"),
    "local_phone": re.compile(r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|telefon|t[ée]l[ée]phone|tel[ée]fono)\b"),
    "ipv6": re.compile(r"(?i)\b(?:ip|ipv6|address|host|server|client)\b"),
    "secret": re.compile(r"(?i)\b(?:token|secret|key|auth|password|login|user)\b"),
    "key": re.compile(r"(?i)\b(?:token|secret|key|auth|password|bearer|session)\b"),
}
DOUBT = re.compile(r"(?i)\b(?:example|sample|isbn|order no|invoice|part no|version|sha1|sha256|md5|commit|checksum)\b")


@dataclass(frozen=True, order=True)
class Span:
    start: int
    rank: int
    end: int
    score: float

    @property
    def kind(self) -> str:
        return KINDS[self.rank]

    def __str__(self) -> str:
        return f"{self.kind}:{self.start}:{self.end}"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def mod_97(iban: str) -> bool:
    plain = iban.replace(" ", "")
    if not 15 <= len(plain) <= 34:
        return False
    rest = 0
    for c in plain[4:] + plain[:4]:
        n = int(c, 36)
        rest = (rest * (100 if n > 9 else 10) + n) % 97
    return rest == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """A match begins where the run of local characters before an @ does, no earlier than the match before it ended."""
    last = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            last = at = found.end()
        else:
            # what stands before this @ can't begin a later match
            last = at = at + 1


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m.group().split(".")):
            yield m.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            yield m.span()


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Groups of four, the last one shorter, in capitals or not. Words may follow, so of a match's beginnings the longest with the right remainder counts."""
    for m in _IBAN.finditer(text):
        end = m.end()
        while end - m.start() >= 15:
            if mod_97(text[m.start() : end]):
                yield m.start(), end
                break
            end = text.rfind(" ", m.start(), end)


def ipv6s(text: str) -> Iterator[tuple[int, int, float]]:
    """(start, end, score) of addresses in any form of RFC 4291: eight groups, a gap of zeros, an IPv4 address at the end. Without a digit it may be a word."""
    for m in _IPV6.finditer(text):
        said = m.group().rstrip(".")
        if said.endswith(":") and not said.endswith("::"):
            said = said[:-1]
        if len(said) > 45 or said.strip(":") == "":
            continue
        try:
            ipaddress.IPv6Address(said)
        except ValueError:
            continue
        yield m.start(), m.start() + len(said), 0.95 if _DIGITS.search(said) else 0.5


def secrets(text: str) -> Iterator[tuple[int, int]]:
    """Values that names of secrets are set to, not one character over and over: with a digit, or in quotes or behind an equals sign, as a bare word behind a colon is prose."""
    for m in _SECRET.finditer(text):
        k = next(k for k in (2, 3, 4) if m[k] is not None)
        value = m[k] if k < 4 else m[k].rstrip(".,;)]}")
        sure = k < 4 or m[1] != ":"
        if len(value) >= (6 if _DIGITS.search(value) else 8) and len(set(value)) >= 5 and (sure or _DIGITS.search(value)):
            yield m.start(k), m.start(k) + len(value)


def _scored(text: str, rank: int, start: int, end: int, score: float) -> Span:
    around = text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]
    score += 0.35 * bool(CONTEXT[KINDS[rank]].search(around)) - 0.25 * bool(DOUBT.search(around))
    return Span(start, rank, end, round(min(1.0, max(0.0, score)), 4))


class Taken:
    """Disjoint stretches of a text; whether a new one overlaps any is found by bisection."""

    def __init__(self, spans: list[Span]):
        self.start: list[int] = []
        self.end: list[int] = []
        for s in sorted(spans):
            if self.end and s.start < self.end[-1]:
                self.end[-1] = max(self.end[-1], s.end)
            else:
                self.start.append(s.start)
                self.end.append(s.end)

    def add(self, s: Span) -> bool:
        """Whether s overlaps none; it is one of them from then on."""
        i = bisect_left(self.end, s.start + 1)
        if i < len(self.start) and self.start[i] < s.end:
            return False
        self.start.insert(i, s.start)
        self.end.insert(i, s.end)
        return True


def find(text: str | None) -> list[Span]:
    """All spans by start, then kind. A method span that overlaps a base one is dropped; of two of its own the higher score stays."""
    if not text:
        return []
    base: list[Span] = []
    if "@" in text:
        base += [_scored(text, 0, a, b, 0.95) for a, b in emails(text)]
    digits = _DIGITS.search(text) is not None
    if digits:
        base += [_scored(text, 1, a, b, 0.8) for a, b in ips(text)]
        base += [_scored(text, 2, a, b, 0.9) for a, b in cards(text)]
        if "+" in text:
            base += [_scored(text, 3, a, b, 0.85) for a, b in phones(text)]
    found: list[tuple[int, int, int, float]] = []
    if digits:
        found += [(4, a, b, 0.95) for a, b in ibans(text)]
        for rank, pattern, score in ((5, _SSN, 0.5), (6, _NATIONAL, 0.5)):
            found += [(rank, m.start(), m.end(), score) for m in pattern.finditer(text)]
    found += [(8, a, b, 0.95) for a, b in secrets(text)] + [(9, m.start(), m.end(), 0.5) for m in _KEY.finditer(text)]
    if text.count(":") > 1:
        found += [(7, *x) for x in ipv6s(text)]
    more: list[Span] = []
    if found:
        taken = Taken(base)
        scored = (_scored(text, *x) for x in found)
        more = [s for s in sorted((s for s in scored if s.score >= LIMIT), key=lambda s: (-s.score, s)) if taken.add(s)]
    return sorted(base + more)


def spans_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_more, scores (of the spans in turn) and max_score of every row.

    Positions are code points, end exclusive. A null text is empty: no spans, the hash of "" and "".
    Texts of any length are searched whole, in time linear in their length but for the sorting of spans.
    Repeated rows are searched each; of spans of one kind and start there is one; an empty table gives none.
    Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def scan(batches):
        for whole in batches:
            for b in slices(whole):
                found = [find(x) for x in b.column(1).to_pylist()]
                counts = [[sum(s.rank == k for s in x) for x in found] for k in range(len(BASE))]
                base = [hashlib.sha256(",".join(str(s) for s in x if s.rank < len(BASE)).encode()).hexdigest() for x in found]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.string()), pa.array([",".join(map(str, x)) for x in found], pa.string()), pa.array([sum(s.rank >= len(BASE) for s in x) for x in found], pa.int64()), pa.array([[s.score for s in x] for x in found], pa.list_(pa.float64())), pa.array([max((s.score for s in x), default=0.0) for x in found], pa.float64())],
                    names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_more", "scores", "max_score"],
                )

    schema = StructType([rows.schema[0], *(StructField(f"n_{k}", LongType()) for k in BASE), StructField("base_sha256", StringType()), StructField("spans", StringType()), StructField("n_more", LongType()), StructField("scores", ArrayType(DoubleType())), StructField("max_score", DoubleType())])
    return rows.mapInArrow(scan, schema)


def redacted(text: str | None) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans are replaced as one."""
    if not text:
        return text
    out, last = [], 0
    for s in find(text):
        if s.start >= last:
            out += [text[last : s.start], f"[{s.kind}]"]
        last = max(last, s.end)
    return "".join([*out, text[last:]])


def redacted_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with spans in the text replaced by their kinds. Null and empty texts stay as they are, as do all other columns; rows are treated each by itself; an empty table stays empty."""
    at, names = docs.columns.index(text_col), docs.columns

    def scan(batches):
        for whole in batches:
            for b in slices(whole, text_col):
                text = pa.array([redacted(x) for x in b.column(at).to_pylist()], b.column(at).type)
                yield pa.RecordBatch.from_arrays([text if i == at else b.column(i) for i in range(len(names))], names=names)

    return docs.mapInArrow(scan, docs.schema)


def op8_pii(spark, sf_dir: str) -> DataFrame:
    from .tables import table

    return spans_of(table(spark, sf_dir, "documents"))
