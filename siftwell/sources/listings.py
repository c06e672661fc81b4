"""Dated listing pages to rows, one a listed record, with what the page declares beside it.

The page is read as a stream of tags; nothing is checked while reading. Whether sections, days and totals are complete is
asked of the rows afterwards, by grouped counts (siftwell.operators.checks).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.operators.checks import members

# The form of a record's id and of a category's label, and the classes of a listing's fields, as the pages have them.
_ID = r"\d{4}\.\d{4,5}|[a-z-]+(?:\.[A-Z]{2})?/\d{7}"
_LABEL = re.compile(r"\(([A-Za-z][A-Za-z0-9-]*(?:\.[A-Za-z0-9-]+)?)\)")
_FIELDS = ("list-title", "list-authors", "list-subjects", "primary-subject", "list-comments", "mathjax")
# The headings of a listing's sections.
SECTIONS = {"New submissions": "new", "Cross submissions": "cross", "Cross-lists": "cross", "Replacement submissions": "replace", "Replacements": "replace"}

_ROWS = (
    "page_id string, category string, total int, day date, section string, section_shown int, section_of int, place int, identifier string, label string, cross_from string, title string, summary string, "
    "authors array<string>, categories array<string>, primary string, comment string"
)


class _Reader(HTMLParser):
    """Rows of a listing page. Text is gathered for the open heading, dt, dd and the fields within."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.total: int | None = None
        self.day = None
        self.section, self.shown, self.of = None, None, None
        self.open: list[tuple[str, str, list[str]]] = []  # tag, field, text
        self.fields: dict[str, list[str]] = {}
        self.links: list[tuple[str, str, str]] = []
        self.people: list[str] = []
        self.listing = False
        self.pending: dict | None = None

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        classes = a.get("class", "").split()
        if tag == "dl" and a.get("id") == "articles":
            self.listing = True
        if tag in ("dt", "dd"):
            self._close_until(("dt", "dd", "h3"))
            self.fields, self.links, self.people = {}, [], []
        field = next((f for f in _FIELDS if f in classes), "paging" if "paging" in classes else "")
        if field or tag in ("h3", "dt", "dd", "a"):
            self.open.append((tag, field or (f"href {a.get('title', '')} {a.get('href', '')}" if tag == "a" else tag), []))

    def handle_data(self, data):
        for _, _, text in self.open:
            text.append(data)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                while len(self.open) > k:
                    self._done(*self.open.pop())
                break

    def _close_until(self, tags) -> None:
        while any(t in tags for t, _, _ in self.open):
            self._done(*self.open.pop())

    def _done(self, tag: str, field: str, pieces: list[str]) -> None:
        text = " ".join("".join(pieces).split())
        if field == "paging" and (m := re.search(r"Total of (\d+) entries", text)) and self.total is None:
            self.total = int(m[1])
        elif tag == "h3":
            self._heading(text)
        elif tag == "a" and field.startswith("href"):
            self.links.append((*field.split(" ", 2)[1:], text))
            if any(f == "list-authors" for _, f, _ in self.open):
                self.people.append(text)
        elif field in _FIELDS:
            self.fields.setdefault(field, []).append(text)
        elif tag == "dt":
            self._entry(text)
        elif tag == "dd":
            self._details()

    def _heading(self, text: str) -> None:
        if m := re.fullmatch(r"Showing new listings for (\w+, \d{1,2} \w+ \d{4})", text):
            self.day = datetime.strptime(m[1], "%A, %d %B %Y").date()
        elif self.listing and (m := re.fullmatch(r"([A-Z][\w -]+?) \(showing (\d+) of (\d+) entries\s*\)", text)) and m[1] in SECTIONS:
            self.section, self.shown, self.of = SECTIONS[m[1]], int(m[2]), int(m[3])
        elif self.listing and (m := re.fullmatch(r"(\w+, \d{1,2} \w+ \d{4})(?: \(showing (?:(?:first|last) )?(\d+) of (\d+) entries\s*\))?", text)):
            self.day, self.section = datetime.strptime(m[1], "%a, %d %b %Y").date(), None
            self.shown, self.of = int(m[2] or 0), int(m[3] or 0)

    def _entry(self, text: str) -> None:
        found = [(re.search(rf"/abs/({_ID})(?:v\d+)?$", href), re.search(rf"({_ID})(?:v\d+)?$", label)) for title, href, label in self.links if title == "Abstract"]
        cross = re.search(r"\(cross-list from ([A-Za-z.\-]+)\)", text)
        section = self.section or ("replace" if "(replaced)" in text else "cross" if cross else "new")
        href, label = found[0] if len(found) == 1 else (None, None)
        self.pending = {"section": section, "identifier": href and href[1], "label": label and label[1], "cross_from": cross[1] if cross else None}

    def _details(self) -> None:
        f = {k: " ".join(v).strip() for k, v in self.fields.items()}
        row = self.pending or {"section": self.section, "identifier": None, "label": None, "cross_from": None}
        self.pending = None
        primary = _LABEL.findall(f.get("primary-subject", ""))
        self.rows.append(row | {
            "day": self.day, "section_shown": self.shown, "section_of": self.of, "place": len(self.rows) + 1, "title": f.get("list-title", "").removeprefix("Title:").strip(), "summary": f.get("mathjax", ""), "authors": self.people,
            "categories": list(dict.fromkeys(_LABEL.findall(f.get("list-subjects", "") + " " + f.get("primary-subject", "")))), "primary": primary[0] if len(primary) == 1 else None, "comment": f.get("list-comments", "").removeprefix("Comments:").strip(),
        })
        self.people = []


def listing(payload: bytes) -> tuple[int | None, list[dict]]:
    """(declared total, rows) of a page; a page without entries has one row that only tells the day."""
    reader = _Reader()
    reader.feed(payload.decode("utf-8", "replace"))
    reader.close()
    reader._close_until(("dt", "dd", "h3"))
    rows = reader.rows or [{"day": reader.day, "section_shown": reader.shown, "section_of": reader.of}]
    return reader.total, rows


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in _ROWS.split(", ")]
    for p in batches:
        out, blank = [], dict.fromkeys(columns)
        for page, category, payload in zip(p.page_id, p.category, p.payload, strict=True):
            total, rows = listing(bytes(payload))
            out += [blank | {"page_id": page, "category": category, "total": total} | r for r in rows]
        yield pd.DataFrame(out, columns=columns).astype({c: "Int32" for c in ("total", "section_shown", "section_of", "place")})


def listed(pages: DataFrame) -> DataFrame:
    """The rows of pages (page_id, category, payload)."""
    return pages.where("payload is not null").select("page_id", "category", "payload").mapInPandas(_parse, _ROWS)


def section_faults(rows: DataFrame) -> DataFrame:
    """(page_id, day, section, declared, came): sections that hold another number of records than they declare."""
    found = rows.where("identifier is not null").groupBy("page_id", "day", F.coalesce("section", F.lit("")).alias("section")).agg(F.max("section_shown").alias("declared"), F.count("*").alias("came"))
    return found.where("declared != came")


def row_faults(rows: DataFrame) -> DataFrame:
    """Rows whose id and label differ, or that lack what a listed record must have."""
    lacking = F.col("identifier").isNull() | (F.col("identifier") != F.coalesce("label", F.lit(""))) | (F.col("title") == "") | F.col("primary").isNull() | (F.size("authors") == 0)
    return rows.where(F.col("section").isin("new", "cross") & lacking)


def announced(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, excluded) ids: of all new and cross-listed records, those that the listing of their own primary category has as new, and the others."""
    eligible = rows.where("section in ('new', 'cross') and identifier is not null")
    return members(eligible, rows.where("section = 'new' and identifier is not null and category = primary"), "identifier")
