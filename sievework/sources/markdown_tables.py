"""Tables of postings in Markdown files: header rows are found by their names, rows are read with escapes and links, rejects say why."""

from __future__ import annotations

import re
from html import unescape
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# The columns of a table, in any order, and the marks that a row may bear.
HEADERS = ("company", "role", "location", "apply", "added")
MARKS = {"🔒": "closed", "🛂": "no_sponsorship", "🇺🇸": "us_citizenship_required"}
SCHEMA = "file string, line int, company string, title string, location string, source_url string, added string, closed boolean, no_sponsorship boolean, us_citizenship_required boolean, reason string"

_CELL = re.compile(r"((?:\\.|[^|\\])*)(?:\||\Z)", re.S)
_LINK = re.compile(r"\[[^\]]*\]\(((?:\\.|[^()\\]|\((?:\\.|[^()\\]|\([^()]*\))*\))*)\)")


def cells(line: str) -> list[str]:
    """The cells of a row; a bar after a backslash is text."""
    body = re.sub(r"(?<!\\)\|$", "", re.sub(r"^\|", "", line.strip()))
    found, at = [], 0
    while at <= len(body):
        m = _CELL.match(body, at)
        found.append(m[1].strip())
        if m.end() == len(body) and not m[0].endswith("|"):
            break
        at = m.end()
    return found


def plain(cell: str) -> str:
    """A cell's text without links, tags, emphasis and escapes."""
    s = re.sub(r"(?i)<br\s*/?>", " / ", cell)
    s = re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", s)
    s = re.sub(r"\\([\\`*_{}\[\]()#+.!|<>-])", r"\1", re.sub(r"<[^>]+>", " ", s))
    return " ".join(re.sub(r"\*\*|__|~~|`", "", unescape(s)).split())


def link(cell: str) -> str:
    """The http address that a cell links to, or names; blank if none, or if it has a user."""
    m = _LINK.search(cell)
    found = m[1].strip() if m else ""
    if not found and (m := re.search(r"https?://\S+", cell)):
        found = m[0].rstrip(".,;")
    found = found.strip("<>").split(None, 1)[0] if found.strip("<>").strip() else ""
    try:
        p = urlsplit(found)
    except ValueError:
        return ""
    return found if p.scheme.lower() in ("http", "https") and p.hostname and not p.username else ""


def rows_of(text: str):
    """A tuple of SCHEMA without file for each row of each table."""
    columns: dict[str, int] | None = None
    head: list[str] = []
    for n, line in enumerate(text.split("\n"), 1):
        if "|" not in line:
            columns, head = None, []
            continue
        own = cells(line)
        if head and all(re.fullmatch(r":?-{3,}:?", c) for c in own):
            names = [re.sub("[^a-z]+", "", plain(c).casefold()) for c in head]
            columns = {h: names.index(h) for h in HEADERS} if set(HEADERS) <= set(names) else None
            head = []
        elif columns is None:
            head = own
        elif len(own) <= max(columns.values()):
            yield n, *(None,) * 5, *(False,) * 3, "column_count"
        else:
            raw = {h: own[i] for h, i in columns.items()}
            said = " ".join(raw[h] for h in HEADERS[:3])
            flags = [m in said for m in MARKS]
            for m in MARKS:
                raw = {h: v.replace(m, " ") for h, v in raw.items()}
            company, title, place, url, added = plain(raw["company"]), plain(raw["role"]), plain(raw["location"]), link(raw["apply"]), plain(raw["added"])
            why = "missing_company" if not company else "missing_role" if not title else "invalid_apply_url" if not url else None
            yield n, company, title, place, url, "" if added in ("-", "—", "–") else added, *flags, why


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """All rows of all tables of Markdown files, in SCHEMA; reason is null for good rows. A file is one task's."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def parse(batches):
        for b in batches:
            out = [(p, *row) for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for row in rows_of(c.decode("utf-8", "replace").replace("\r\n", "\n"))]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            kinds = [pa.string(), pa.int32(), *[pa.string()] * 5, *[pa.bool_()] * 3, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * len(names), kinds, strict=True)], names=names)

    return files.mapInArrow(parse, SCHEMA)
