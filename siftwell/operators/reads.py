"""The read side: filtered scans, latest-per-key lookups, rollups and top-k over the record and log tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.operators.timeline import STORED_FORM

MOST_ROWS = 500


def timed(items: DataFrame) -> DataFrame:
    """Items with `at`, the instant of a published_at in the stored form, else null."""
    stored = F.col("published_at").rlike(STORED_FORM)
    return items.withColumn("at", F.when(stored, F.try_to_timestamp(F.when(stored, F.left("published_at", F.lit(19))), F.lit("yyyy-MM-dd'T'HH:mm:ss"))))


def json_text(column: str, path: str) -> Column:
    """A JSON field as text; null where the document or the field is missing or broken."""
    return F.get_json_object(column, path)


def json_true(column: str, path: str) -> Column:
    """Whether a JSON field is true; anything else is false."""
    return F.coalesce(json_text(column, path) == "true", F.lit(False))


def matches_text(needle: str, texts: Sequence[str] = ("title", "summary"), lists: Sequence[str] = ("tags",)) -> Column:
    """Case-blind substring search over texts and lists; % and _ stand for themselves."""
    want = F.lower(F.lit(needle))
    found = [F.contains(F.lower(F.coalesce(c, F.lit(""))), want) for c in texts] + [F.contains(F.lower(F.coalesce(F.array_join(c, "\n"), F.lit(""))), want) for c in lists]
    out = found[0]
    for f in found[1:]:
        out = out | f
    return out


def scan(
    items: DataFrame, kind: str = "", important: bool = False, category: str = "", needle: str = "", since: datetime | Column | None = None, before: datetime | Column | None = None, json_equals: dict[str, str] | None = None
) -> DataFrame:
    """Items that fulfil all conditions given; the lower bound is closed, the upper open. Conditions not given cost nothing."""
    rows = items if "at" in items.columns else timed(items)
    if kind:
        rows = rows.where(F.col("kind") == kind)
    if important:
        rows = rows.where("is_important")
    if category:
        rows = rows.where(F.col("category") == category)
    if needle:
        rows = rows.where(matches_text(needle))
    if since is not None:
        rows = rows.where(F.col("at") >= F.lit(since))
    if before is not None:
        rows = rows.where(F.col("at") < F.lit(before))
    for path, value in (json_equals or {}).items():
        rows = rows.where(json_text("metadata_json", path) == value)
    return rows


def top(rows: DataFrame, limit: int = 100, order: Sequence[Column] | None = None, most: int = MOST_ROWS) -> DataFrame:
    """The first rows, latest and best first; the limit is held between 1 and `most`. Ties go to the larger id."""
    return rows.orderBy(*(order or (F.desc("at"), F.desc("score"), F.desc("id")))).limit(max(1, min(int(limit), most)))


def latest(rows: DataFrame, key: str | Sequence[str], by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The columns of the last row of each key in the order of `by`; one partial aggregation, no window."""
    keys = [key] if isinstance(key, str) else list(key)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*by)).alias("x")).select(*keys, "x.*")


def with_feedback(items: DataFrame, feedback: DataFrame) -> DataFrame:
    """Items with the value of their latest feedback, if any; equal times go to the larger id."""
    last = latest(feedback.where("item_id is not null"), "item_id", ("created_at", "id"), ("value",)).toDF("item_id", "feedback_value")
    return items.join(last, items["id"] == last["item_id"], "left").drop("item_id")


def stats(items: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts of all, news, papers and important records; zeros over no rows."""

    def count_if(c: Column) -> Column:
        return F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")

    return items.groupBy(*by).agg(F.count("*").alias("total"), count_if(F.col("kind") == "news").alias("news"), count_if(F.col("kind") == "paper").alias("papers"), count_if(F.col("is_important")).alias("important"))


COUNTERS = ("request_items", "prompt_tokens", "completion_tokens", "reasoning_tokens", "cache_hit_tokens", "cache_miss_tokens", "total_tokens")


def usage_summary(usage: DataFrame, by: Sequence[str] = ("local_date",)) -> DataFrame:
    """Sums of calls, tokens and cost; failed and successful calls apart; zeros over no rows."""

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(c), F.lit(0))

    return usage.groupBy(*by).agg(
        total(F.col("call_count")).cast("long").alias("calls"),
        *(total(F.when(F.col("status") == s, F.col("call_count"))).cast("long").alias(n) for s, n in (("success", "successful_calls"), ("failed", "failed_calls"))),
        *(total(F.col(c)).cast("long").alias(c) for c in COUNTERS),
        F.round(total(F.col("estimated_cost_usd")), 6).alias("cost"),
    )


def stage(purpose: Column, prefixes: Sequence[tuple[str, str]], other: str) -> Column:
    """The name of the first prefix that a purpose begins with."""
    out = F.lit(other)
    for prefix, name in reversed(list(prefixes)):
        out = F.when(F.startswith(purpose, F.lit(prefix)), F.lit(name)).otherwise(out)
    return out


def carried_forward(local: DataFrame, remote: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    """What a remote snapshot is ahead of the local sums by, per metric and never below 0; only keys where it is ahead in any."""
    far = remote.select(key, *(F.col(m).alias(f"r_{m}") for m in metrics))
    rows = far.join(local.select(key, *metrics), key, "left")
    ahead = [F.greatest(F.lit(0).cast("long"), F.col(f"r_{m}") - F.coalesce(m, F.lit(0))).cast("long").alias(m) for m in metrics]
    return rows.select(key, *ahead).where(" or ".join(f"{m} > 0" for m in metrics))


def running_before(rows: DataFrame, key: str, order: str, metrics: Sequence[str], slice_ids: int = 65_536) -> DataFrame:
    """Sums of the metrics over the earlier rows of each key, by a unique integer order.

    Sums run within slices of ids and are carried over from slice to slice, so a key of any size is spread over tasks.
    """
    cut_ = F.floor(F.col(order) / slice_ids).cast("long")
    rows = rows.withColumn("_slice", cut_)
    sums = rows.groupBy(key, "_slice").agg(*(F.sum(m).alias(f"_s_{m}") for m in metrics))
    carried = sums.selectExpr(key, "_slice", *(f"coalesce(sum(_s_{m}) over (partition by {key} order by _slice rows between unbounded preceding and 1 preceding), 0) as _c_{m}" for m in metrics))
    within = rows.selectExpr("*", *(f"coalesce(sum({m}) over (partition by {key}, _slice order by {order} rows between unbounded preceding and 1 preceding), 0) as _w_{m}" for m in metrics))
    return within.join(carried, [key, "_slice"]).select(*(c for c in rows.columns if c != "_slice"), *((F.col(f"_c_{m}") + F.col(f"_w_{m}")).alias(f"{m}_before") for m in metrics))


def numbered(rows: DataFrame, order: str, slice_ids: int = 65_536) -> DataFrame:
    """Rows with `n`, their place from 1 by a unique integer order, counted slice by slice instead of in one window."""
    rows = rows.withColumn("_slice", F.floor(F.col(order) / slice_ids).cast("long"))
    sizes = rows.groupBy("_slice").agg(F.count("*").alias("_n"))
    starts = sizes.selectExpr("_slice", "coalesce(sum(_n) over (order by _slice rows between unbounded preceding and 1 preceding), 0) as _start")  # one row a slice
    return rows.selectExpr("*", f"row_number() over (partition by _slice order by {order}) as _k").join(starts, "_slice").withColumn("n", F.col("_start") + F.col("_k")).drop("_slice", "_start", "_k")


def flag_top(rows: DataFrame, key: str, order: str, limit: int, salts: int = 64) -> DataFrame:
    """All rows with `chosen`: whether a row is among the first `limit` of its key by the SQL order.

    The best of each salted part are ranked again, so no window sees a whole key; at most limit * keys ids are joined back.
    """
    parts = rows.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    some = parts.selectExpr("*", f"row_number() over (partition by {key}, _salt order by {order}) as _r").where(F.col("_r") <= limit)
    best = some.selectExpr("id", f"row_number() over (partition by {key} order by {order}) as _r2").where(F.col("_r2") <= limit).select("id").withColumn("_in", F.lit(True))
    return rows.join(best, "id", "left").withColumn("chosen", F.coalesce("_in", F.lit(False))).drop("_in")


def newest_checks(checks: DataFrame, rows: int = MOST_ROWS) -> DataFrame:
    """The latest check of each source within the newest rows."""
    columns = [c for c in ("id", "checked_at", "success", "http_status", "item_count", "elapsed_ms", "domain_match") if c in checks.columns]
    return latest(checks.distinct().orderBy(F.desc("id")).limit(rows), "source_id", ("id",), columns)


def health(checks: DataFrame, now: Column, stale_after: timedelta = timedelta(hours=36)) -> DataFrame:
    """One row: sources that are healthy and fresh, stale ones, and all. checks: the latest of each source."""
    stale = F.col("checked_at").isNull() | ((F.unix_micros(now) - F.unix_micros("checked_at")) > int(stale_after.total_seconds()) * 1_000_000)
    ones = {"healthy": F.col("success") & F.col("domain_match") & ~stale, "stale": stale}
    return checks.agg(*(F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long").alias(n) for n, c in ones.items()), F.count("*").alias("sources"))


def latest_run(runs: DataFrame, kind: str, since: datetime | None = None, before: datetime | None = None, details: dict[str, str] | None = None) -> DataFrame:
    """(id, started_at) of the latest run of a kind in which a source succeeded, with the details given."""
    rows = runs.where(F.col("kind") == kind).where("sources_ok > 0")
    if since is not None:
        rows = rows.where(F.col("started_at") >= F.lit(since))
    if before is not None:
        rows = rows.where(F.col("started_at") < F.lit(before))
    for name, value in (details or {}).items():
        rows = rows.where(json_text("details", f"$.{name}") == value)
    return rows.select("id", "started_at").orderBy(F.desc("started_at"), F.desc("id")).limit(1)


def signals(items: DataFrame) -> DataFrame:
    """(id, pos, platform, rank, points, comments, qualified): the nested signals of the records, unnested."""
    schema = "array<struct<platform string, signal_type string, rank int, points int, comments int, views int, likes int, qualified boolean, discussion_url string, period string>>"
    found = items.select("id", F.from_json(F.get_json_object("metadata_json", "$.community_signals"), schema).alias("s"))
    return found.select("id", F.posexplode("s").alias("pos", "x")).select("id", "pos", "x.platform", "x.rank", "x.points", "x.comments", "x.qualified", "x.discussion_url", "x.period")


def heat_qualified(rank: Column, points: Column, comments: Column, rank_limit: Column, least_points: Column, least_comments: Column) -> Column:
    """Whether a ranked entry passes its source's thresholds: within the rank limit, and enough points or comments where such are set."""
    limit, p, c = (F.coalesce(x, F.lit(0)) for x in (rank_limit, least_points, least_comments))
    enough = ((p > 0) & (points >= p)) | ((c > 0) & (comments >= c))
    return F.when((limit > 0) & (rank > limit), False).when((p > 0) | (c > 0), enough).otherwise(limit > 0)
