"""Settings and the source dimension from files, with environment overrides."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SOURCE_SCHEMA = (
    "id string, name string, url string, type string, adapter string, community_platform string, time_zone string, tier int, max_items int, community_rank_limit int, community_min_points int, community_min_comments int, "
    "focus double, enabled boolean, allow_external_links boolean, tags array<string>, allowed_domains array<string>"
)


@dataclass(frozen=True)
class Settings:
    timezone: str = "Asia/Shanghai"
    news_hours: int = 48
    paper_hours: int = 96
    paper_lag_days: int = 1
    similarity: float = 0.72
    most_news: int = 15
    most_papers: int = 20
    stale_hours: int = 36


def _document(path: str | Path) -> object:
    path = Path(path)
    if path.suffix in (".yaml", ".yml"):
        import yaml  # only where it's installed

        return yaml.safe_load(path.read_text("utf-8"))
    return json.loads(path.read_text("utf-8"))


def load_settings(path: str | Path | None = None, env: dict[str, str] | None = None, prefix: str = "SIFTWELL_") -> Settings:
    """Settings from a file, over which SIFTWELL_<NAME> in the environment wins."""
    known = {f.name: type(f.default) for f in fields(Settings)}
    given = {k: v for k, v in (dict(_document(path)) if path else {}).items() if k in known}
    env = os.environ if env is None else env
    given |= {k: env[prefix + k.upper()] for k in known if prefix + k.upper() in env}
    return replace(Settings(), **{k: known[k](v) for k, v in given.items()})


def load_sources(spark: SparkSession, path: str | Path, enabled_only: bool = True) -> DataFrame:
    """The source dimension; raises where an id occurs twice."""
    rows = _document(path)
    rows = rows["sources"] if isinstance(rows, dict) else rows
    ids = [r["id"] for r in rows]
    if twice := sorted({i for i in ids if ids.count(i) > 1}):
        raise ValueError(f"sources occur twice: {', '.join(twice)}")
    names = [c.split()[0] for c in SOURCE_SCHEMA.split(", ")]
    found = spark.createDataFrame([tuple(({"enabled": True, "allow_external_links": False, "tags": [], "allowed_domains": []} | r).get(n) for n in names) for r in rows], SOURCE_SCHEMA)
    return found.where("enabled") if enabled_only else found


#: Readers by adapter: the module and function that turns a source's payloads into rows.
ADAPTERS = {"rss": ("siftwell.sources.feeds", "raw_entries"), "wordpress": ("siftwell.sources.feeds", "posts"), "hackernews": ("siftwell.sources.ranked", "stories"), "ranked": ("siftwell.sources.ranked", "ranked_articles"), "hot-list": ("siftwell.sources.ranked", "hot_list"), "listing": ("siftwell.sources.listings", "listed")}


def reader(adapter: str):
    """The reader of an adapter; an unknown one raises."""
    import importlib

    if adapter not in ADAPTERS:
        raise ValueError(f"no reader for {adapter}")
    module, name = ADAPTERS[adapter]
    return getattr(importlib.import_module(module), name)


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, payload) of landed files, whose names begin with the id of their source."""
    return spark.read.format("binaryFile").load(path).selectExpr("regexp_extract(path, '([^/.]+)[^/]*$', 1) as source_id", "content as payload")
