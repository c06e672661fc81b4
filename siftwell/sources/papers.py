"""Paged sources: what is asked for, and whether all of it came. Nothing here fetches; pages are rows."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta
from urllib.parse import urlencode

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.operators.checks import declared_totals, key_sets_differ, repeated_keys


def query_url(base: str, categories: Sequence[str], since: datetime | None = None, before: datetime | None = None, start: int = 0, rows: int = 200) -> str:
    """The address that asks for records of any of the categories, submitted in a half-open span, a page at a time.

    The service takes whole minutes and both ends inclusively, so the last minute asked for is the one before the end.
    """
    any_of = " OR ".join(f"cat:{c}" for c in categories)
    wanted = f"({any_of})" if len(categories) > 1 and since else any_of
    if since is not None and before is not None:
        first, last = (t.strftime("%Y%m%d%H%M") for t in (since, before - timedelta(minutes=1)))
        wanted += f" AND submittedDate:[{first} TO {last}]"
    return f"{base}?{urlencode({'search_query': wanted, 'start': start, 'max_results': rows, 'sortBy': 'submittedDate', 'sortOrder': 'descending'})}"


def page_faults(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """(group, fault) of paged answers: totals that differ from page to page, too few or too many entries, entries that came twice.

    pages: group, total, entries (how many the page holds); entries: group, id.
    """
    totals = declared_totals(pages, "group", "total", "entries")
    differ = totals.where("totals != 1").select("group", F.lit("totals differ").alias("fault"))
    lacking = totals.where("totals = 1 and declared != came").select("group", F.lit("incomplete").alias("fault"))
    twice = repeated_keys(entries, ["group", "id"]).select("group", F.lit("repeated").alias("fault")).distinct()
    return differ.unionByName(lacking).unionByName(twice)


def missing_details(asked: DataFrame, details: DataFrame, key: str = "id") -> DataFrame:
    """(key, side): ids that were asked for without a detail ('left'), and details that nobody asked for ('right')."""
    return key_sets_differ(asked, details, key)


def silent_sources(raw: DataFrame, valid: DataFrame, key: str = "source_id") -> DataFrame:
    """(source_id, error) of sources that sent entries of which none is valid: an answer without a result is a failure, not an empty day."""
    sent = raw.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    return sent.join(valid.select(key).distinct(), key, "left_anti").select(key, F.concat(F.col("n"), F.lit(" entries and none valid")).alias("error"))


def redirected(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """(source_id, error) of pages (source_id, final_url) that came from a host which isn't one of the source's."""
    from siftwell.functions import urls

    rows = pages.join(sources.select(F.col("id").alias("source_id"), "allowed_domains"), "source_id")
    away = rows.where(~urls.domain_allowed(F.col("final_url"), F.col("allowed_domains")))
    return away.select("source_id", F.concat(F.lit("answered by "), urls.hostname(F.col("final_url"))).alias("error"))


def restored(days: Sequence[str], files: Sequence[str], read) -> dict[str, bytes]:
    """{day/file: content} of a published archive; read(path) gives bytes or None. No manifest is an empty archive, a missing file an error."""
    out = {}
    for path in (f"{day}/{name}" for day in sorted(days) for name in files):
        body = read(path)
        if body is None:
            raise FileNotFoundError(path)
        out[path] = body
    return out


def demo(spark, per_kind: int = 4) -> DataFrame:
    """A few invented records of each kind, for trying things out."""
    rows = spark.range(1, 2 * per_kind + 1).withColumn("kind", F.when(F.col("id") <= per_kind, "news").otherwise("paper"))
    number = F.pmod(F.col("id") - 1, F.lit(per_kind)) + 1
    return rows.select("id", "kind", F.concat(F.lit("Example "), "kind", F.lit(" "), number).alias("title"), F.concat(F.lit("https://example.org/"), "kind", F.lit("/"), number).alias("url"), (F.lit(100) - number * 10).cast("double").alias("score"), (number == 1).alias("is_important"))
