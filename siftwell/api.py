"""The facade: what a service or the command line asks of the tables in a folder. Results are DataFrames."""

from __future__ import annotations

import re
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.times import period_bounds
from siftwell.operators import dedup, reads
from siftwell.session import table
from siftwell.sinks import documents
from siftwell.sources.config import Settings


class Feed:
    def __init__(self, spark: SparkSession, folder: str, settings: Settings | None = None) -> None:
        self.spark, self.folder, self.settings = spark, folder, settings or Settings()

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    def items(self, kind: str = "", period: str = "all", category: str = "", query: str = "", important: bool = False, limit: int = 100, now: datetime | None = None) -> DataFrame:
        """Filtered items with their latest feedback, latest first; the limit is held between 1 and 500."""
        if kind not in ("", "news", "paper") or not re.fullmatch(r"[\w\-]{0,64}", category):
            raise ValueError("unknown kind or category")
        s = self.settings
        at = F.lit(now or datetime.now(UTC))
        _, since, before = period_bounds(at, s.timezone, kind or "news", period, s.paper_hours if kind == "paper" else s.news_hours, s.paper_lag_days)
        rows = reads.scan(self.table("items"), kind, important, category, query, *((since, before if kind == "paper" or period == "today" else None) if period != "all" else (None, None)))
        rows = reads.top(rows, limit)
        return reads.with_feedback(rows, self.table("feedback")).orderBy(F.desc("at"), F.desc("score"), F.desc("id"))

    def categories(self) -> DataFrame:
        return self.table("items").where("category is not null").select("category").distinct().orderBy("category")

    def stats(self) -> DataFrame:
        return reads.stats(self.table("items"))

    def runs(self, limit: int = 10) -> DataFrame:
        return reads.top(self.table("runs"), limit, [F.desc("id")])

    def sources(self) -> DataFrame:
        return reads.newest_checks(self.table("source_checks"))

    def health(self, now: datetime | None = None) -> DataFrame:
        return reads.health(self.sources(), F.lit(now or datetime.now(UTC)))

    def usage(self, day: str = "") -> DataFrame:
        rows = self.table("llm_usage")
        return reads.usage_summary(rows.where(F.col("local_date") == day), ()) if day else reads.usage_summary(rows)

    def recent_usage(self, limit: int = 20) -> DataFrame:
        return reads.top(self.table("llm_usage"), limit, [F.desc("id")], 200)

    def duplicates(self) -> DataFrame:
        rows = reads.timed(self.table("items"))
        key = dedup.dedup_key(F.col("canonical_url"), F.col("fingerprint"))
        return dedup.winners(rows.select("id", key.alias("key"), dedup.preference(F.col("source_tier"), F.col("summary"), F.col("at"), F.col("id")).alias("rank"))).where("members > 1")

    def snapshot(self, now: datetime | None = None, most: int = 200) -> str:
        """Everything that a static page shows, as one JSON document: important news, papers, health, usage by day, counts. Each part is bounded."""
        now = now or datetime.now(UTC)
        columns = ("id", "kind", "title", "url", "source_name", "published_at", "category", "score", "is_important")
        parts = {
            "news": reads.top(reads.scan(self.table("items"), "news", important=True), most).select(*columns), "papers": reads.top(reads.scan(self.table("items"), "paper"), most).select(*columns),
            "health": self.health(now), "usage": reads.top(self.usage(), most, [F.desc("local_date")]), "stats": self.stats(),
        }
        return documents.json_document([{"part": name, "rows": documents.bounded(rows)} for name, rows in parts.items()], now)

    def export(self, out: str | Path, limit: int = 500, now: datetime | None = None) -> list[Path]:
        now = now or datetime.now(UTC)
        columns = ("id", "kind", "title", "summary", "url", "source_name", "published_at", "category", "score", "is_important")
        return documents.export([reads.top(reads.scan(self.table("items"), k), limit).select(*columns) for k in ("news", "paper")], out, now)
