"""Feeds to rows: Python takes XML and HTML apart into raw strings, native expressions do everything after that.

A payload that can't be parsed gives one row with `error` and nothing else; it never fails the job.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions import text, times, urls

MOST_BODY = 12_000

_RAW = "source_id string, title string, link string, body string, published string, updated string, guid string, labels array<string>, authors array<string>, pdf string, comment string, total int, error string"


def _name(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2].lower() if isinstance(e.tag, str) else ""


def _all_text(e: ET.Element) -> str:
    return "".join(e.itertext()).strip()


def entries(payload: bytes) -> Iterator[dict]:
    """The raw fields of every item or entry at any depth, whatever their namespaces."""
    root = ET.fromstring(payload)
    totals = [_all_text(e) for e in root.iter() if _name(e) == "totalresults"]
    total = int(totals[0]) if totals and totals[0].isdigit() else None
    for entry in root.iter():
        if _name(entry) not in ("item", "entry"):
            continue
        parts: dict[str, list[ET.Element]] = {}
        for child in entry:
            parts.setdefault(_name(child), []).append(child)

        def first(*names: str, parts=parts, entry=entry) -> str:
            """The first text that isn't empty, in order of the entry's children."""
            return next((t for c in entry if _name(c) in names and (t := _all_text(c))), "")

        links = [((c.get("href") or "").strip(), c.get("rel", "alternate"), c.get("type", ""), (c.text or "").strip()) for c in parts.get("link", [])]
        page = next((h for h, rel, kind, _ in links if h and rel in ("alternate", "") and kind != "application/pdf"), "")
        labels = [c.get("term") or _all_text(c) for n in ("category", "subject") for c in parts.get(n, [])]
        people = []
        for c in [c for c in entry if _name(c) in ("author", "creator")]:
            named = next((t for x in c if _name(x) == "name" and (t := _all_text(x))), "")
            people.append(named or _all_text(c))
        yield {
            "title": first("title"), "link": page or next((h or t for h, _, _, t in links if h or t), ""), "body": first("content", "encoded", "description", "summary"),
            "published": first("published", "pubdate", "updated", "date"), "updated": first("updated"), "guid": first("guid", "id"), "labels": [x.strip() for x in labels if x and x.strip()], "authors": [x for x in people if x],
            "pdf": next((h for h, _, kind, _ in links if kind == "application/pdf"), ""), "comment": first("comment"), "total": total,
        }


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in _RAW.split(", ")]
    for p in batches:
        out, blank = [], dict.fromkeys(columns)
        for source, payload in zip(p.source_id, p.payload, strict=True):
            try:
                out += [blank | {"source_id": source} | e for e in entries(bytes(payload))]
            except Exception as e:
                out.append(blank | {"source_id": source, "error": f"{type(e).__name__}: {e}"})
        yield pd.DataFrame(out, columns=columns).astype({"total": "Int32"})


def raw_entries(pages: DataFrame) -> DataFrame:
    """The raw fields of the entries of pages (source_id, payload)."""
    return pages.where("payload is not null").select("source_id", "payload").mapInPandas(_rows, _RAW)


def records(raw: DataFrame, sources: DataFrame, fetched: Column, kind: str = "news") -> DataFrame:
    """Records from raw entries: cleaned texts, canonical addresses, verified instants, fingerprints; entries without title or link are left out."""
    s = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), F.col("tier").alias("source_tier"), F.col("type").alias("source_type"), F.col("tags"))
    title, link = text.clean_html(F.col("title")), F.trim(F.col("link"))
    rows = raw.where("error is null").join(s, "source_id")
    at, sure = times.parsed_or(F.col("published"), fetched)
    rows = rows.select(
        F.lit(kind).alias("kind"), title.alias("title"), link.alias("url"), F.left(text.clean_html(F.col("body")), F.lit(MOST_BODY)).alias("summary"), "source_id", "source_name", "source_tier", "source_type", "tags", at.alias("published_at"),
        sure.alias("published_at_verified"), F.col("published").alias("published_raw"), text.clean_html(F.col("guid")).alias("external_id"), text.unique_in_order(F.col("labels")).alias("categories"),
        text.unique_in_order(F.transform("authors", text.squeeze)).alias("authors"),
    )
    rows = rows.where("title != '' and url != ''").withColumn("canonical_url", urls.canonical_url(F.col("url"))).withColumn("_normal", text.normalize_title(F.col("title")))
    return rows.withColumn("fingerprint", text.fingerprint(F.col("_normal"), text.title_tokens(F.col("_normal"), True))).drop("_normal").withColumn("cluster_key", F.col("fingerprint"))


def paper_records(raw: DataFrame, fetched: Column) -> DataFrame:
    """Records of a paper feed: id and version apart, verified dates only, the code address found in the texts."""
    at, sure = times.parsed_or(F.col("published"), fetched)
    changed = times.parsed(F.col("updated"))
    rows = raw.where("error is null and trim(guid) != ''").select(
        text.clean_html(F.col("title")).alias("title"), F.left(text.clean_html(F.col("body")), F.lit(16_000)).alias("summary"), text.paper_id(F.col("guid")).alias("external_id"), text.paper_version(F.col("guid")).alias("version"),
        at.alias("published_at"), sure.alias("_sure"), F.when(changed == at, "initial-version").otherwise("updated-version").alias("version_type"), text.unique_in_order(F.col("labels")).alias("categories"),
        text.unique_in_order(F.transform("authors", text.squeeze)).alias("authors"), F.col("pdf").alias("pdf_url"), text.clean_html(F.col("comment")).alias("comment"), "total",
    )
    rows = rows.where("title != '' and _sure").drop("_sure")
    return rows.withColumn("code_url", text.code_url(F.concat_ws(" ", "summary", "comment")))


def failures(raw: DataFrame) -> DataFrame:
    """(source_id, error) of the payloads that couldn't be parsed."""
    return raw.where("error is not null").select("source_id", "error")


_POST = "array<struct<id: bigint, status: string, link: string, date_gmt: string, title: struct<rendered: string>, content: struct<rendered: string, protected: boolean>>>"


def posts(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """Public posts of pages (source_id, payload) that hold a JSON array of them, newest fields only: published, on an allowed
    https host, unprotected, with title, body and a first-publication date in UTC."""
    s = sources.select(F.col("id").alias("source_id"), "allowed_domains", F.greatest(F.lit(1), F.least(F.lit(100), F.coalesce("max_items", F.lit(100)))).alias("most"))
    found = pages.join(s, "source_id").select("source_id", "allowed_domains", F.explode(F.slice(F.from_json(F.col("payload").cast("string"), _POST.replace(": ", ":")), F.lit(1), F.col("most"))).alias("p"))
    rows = found.where("p.status = 'publish' and not coalesce(p.content.protected, false)").where(F.startswith("p.link", F.lit("https://")) & urls.domain_allowed(F.col("p.link"), F.col("allowed_domains")))
    rows = rows.select(
        "source_id", F.col("p.id").cast("string").alias("external_id"), F.col("p.link").alias("url"), urls.canonical_url(F.col("p.link")).alias("canonical_url"), text.clean_html(F.col("p.title.rendered")).alias("title"),
        F.left(text.clean_html(F.col("p.content.rendered")), F.lit(MOST_BODY)).alias("summary"), times.parsed(F.col("p.date_gmt")).alias("published_at"),
    )
    return rows.where("title != '' and summary != '' and published_at is not null")
