"""Digests as JSON, Markdown and RSS, and dated archives with a manifest.

A digest is a bounded top-k result, so one document of it is put together on the driver; a whole table is written as JSON
lines or XML parts by the executors.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import UTC, date, datetime
from email.utils import format_datetime
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.operators.reads import MOST_ROWS

HEADINGS = (("news", "News"), ("paper", "Papers"))


def bounded(rows: DataFrame, most: int = MOST_ROWS) -> list[dict]:
    """The rows of a digest as plain values; more than `most` raise."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a digest holds at most {most} rows; write tables with write_lines")
    return [r.asDict(recursive=True) for r in found]


def _iso(value: datetime) -> str:
    return (value.replace(tzinfo=UTC) if value.tzinfo is None else value).astimezone(UTC).isoformat()


def json_document(items: Sequence[dict], generated: datetime, bounds: dict[str, tuple[datetime | None, datetime | None]] | None = None) -> str:
    """An envelope with the count, the items and, if given, the bounds of each kind."""
    doc: dict = {"generated_at": _iso(generated), "count": len(items), "items": items}
    if bounds is not None:
        for k, name in enumerate(("published_since", "published_before")):
            doc[name] = {kind: b[k] and _iso(b[k]) for kind, b in bounds.items()}
    return json.dumps(doc, ensure_ascii=False, indent=2, default=lambda v: _iso(v) if isinstance(v, datetime) else str(v))


def markdown(items: Sequence[dict], generated: datetime, title: str = "Digest") -> str:
    """Sections in fixed order, each with its items or a line that there are none."""
    out = [f"# {title}", "", f"> {_iso(generated)}", ""]
    for kind, heading in HEADINGS:
        out += [f"## {heading}", ""]
        chosen = [i for i in items if i.get("kind") == kind]
        for i in chosen:
            label = str(i.get("title") or "").replace("[", "\\[").replace("]", "\\]")
            out += [f"### {'* ' if i.get('is_important') else ''}[{label}]({i.get('url') or ''})", ""]
            facts = [str(x) for x in (i.get("source_name"), i.get("published_at"), i.get("category")) if x]
            out += [" | ".join(facts), ""] if facts else []
            out += [str(i["summary"]), ""] if i.get("summary") else []
        out += [] if chosen else ["Nothing.", ""]
    return "\n".join(out)


def rss(items: Sequence[dict], generated: datetime, link: str, title: str = "Digest") -> str:
    """RSS 2.0; dates in mail form where they are instants, else as they are."""

    def dated(value) -> str:
        return format_datetime(value.replace(tzinfo=UTC) if value.tzinfo is None else value) if isinstance(value, datetime) else str(value or "")

    rows = [f"<item><title>{escape(str(i.get('title') or ''))}</title><link>{escape(str(i.get('url') or ''))}</link><guid>{escape(str(i.get('url') or i.get('id') or ''))}</guid><pubDate>{escape(dated(i.get('at') or i.get('published_at')))}</pubDate><description>{escape(str(i.get('summary') or ''))}</description></item>" for i in items]
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<rss version="2.0"><channel><title>{escape(title)}</title><link>{escape(link)}</link><description>{escape(title)}</description><lastBuildDate>{dated(generated)}</lastBuildDate>{"".join(rows)}</channel></rss>\n'


def export(parts: Sequence[DataFrame], folder: str | Path, generated: datetime, link: str = "https://localhost/", bounds: dict | None = None) -> list[Path]:
    """The union of bounded parts, latest first, in all three formats."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    items = [i for p in parts for i in bounded(p)]
    items.sort(key=lambda i: str(i.get("published_at") or ""), reverse=True)
    made = {"digest.json": json_document(items, generated, bounds), "digest.md": markdown(items, generated), "feed.xml": rss(items, generated, link)}
    for name, body in made.items():
        (folder / name).write_text(body, "utf-8")
    return [folder / n for n in made]


def write_lines(rows: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """A whole table as JSON lines, written by the executors."""
    rows.write.mode("overwrite").partitionBy(*partition_by).json(path)


def write_xml(rows: DataFrame, path: str, row_tag: str = "item") -> None:
    rows.write.mode("overwrite").format("xml").option("rowTag", row_tag).option("rootTag", "channel").save(path)


def archive(digest: str, day: str, folder: str | Path, name: str = "digest.json") -> list[str]:
    """Puts a digest under its day and returns the manifest of all days, sorted; the same call again changes nothing."""
    if date.fromisoformat(day).isoformat() != day:
        raise ValueError("a day is YYYY-MM-DD")
    folder = Path(folder)
    (folder / day).mkdir(parents=True, exist_ok=True)
    (folder / day / name).write_text(digest, "utf-8")
    manifest = folder / "manifest.json"
    days = sorted({*(json.loads(manifest.read_text("utf-8")) if manifest.exists() else []), day})
    manifest.write_text(json.dumps(days), "utf-8")
    return days


def mail(items: DataFrame, day: str, limits: dict[str, int]) -> tuple[str, str]:
    """(subject, text) of a daily mail: the best of each kind by score."""
    body, counts = [], []
    for kind, heading in HEADINGS:
        best = bounded(items.where(F.col("kind") == kind).orderBy(F.desc("score"), F.desc("id")).select("title", "url", "score").limit(limits.get(kind, 0)))
        counts.append(f"{len(best)} {heading.lower()}")
        body += [heading, *(f"{k}. {i['title']} - {i['url']}" for k, i in enumerate(best, 1)), ""]
    return f"Digest of {day}: {', '.join(counts)}", "\n".join(body)
