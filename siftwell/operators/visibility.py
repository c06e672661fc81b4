"""What a reader may see: provenance, versions and days as predicates, and the states of a day's batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions import times, urls

# The statuses of a checked address that let a record be used.
USABLE = ["verified-primary", "verified-publisher", "verified-community", "verified-link", "access-restricted"]


def verified(status: Column) -> Column:
    """Whether a status is one of verification, or of an address that exists but asks for access; null isn't."""
    return F.coalesce(F.startswith(status, F.lit("verified-")) | (status == "access-restricted"), F.lit(False))


def usable(status: Column, statuses: Sequence[str] = USABLE) -> Column:
    return F.coalesce(status.isin(list(statuses)), F.lit(False))


def only_for(kind: str, condition: Column) -> Column:
    """A condition that records of one kind must fulfil and all others needn't; where it is null, it isn't fulfilled."""
    return F.coalesce(F.col("kind") != kind, F.lit(True)) | F.coalesce(condition, F.lit(False))


def within(at: Column, since: Column, before: Column) -> Column:
    """Half-open; null bounds are open ends, a null instant is outside."""
    return at.isNotNull() & (since.isNull() | (at >= since)) & (before.isNull() | (at < before))


def day_batch(papers: DataFrame, day: str, zone: str, new: Column, sure: Column) -> DataFrame:
    """The papers (with `at`) of a local day that are new submissions and sure of their date."""
    since, before = (F.to_utc_timestamp(F.date_add(F.lit(day).cast("date"), k).cast("timestamp"), zone) for k in (0, 1))
    return papers.where(within(F.col("at"), since, before) & F.coalesce(new, F.lit(False)) & F.coalesce(sure, F.lit(False)))


def identity_faults(papers: DataFrame, hosts: Sequence[str], zone: str) -> DataFrame:
    """(id, fault) of papers (id, external_id, canonical_url, at, announced): what keeps a paper from being what its id says.

    The id must have the form of one, the address lie on an official host below /abs/ and end in the id, and the day of announcement be the local day
    after that of the record.
    """
    path = F.regexp_extract("canonical_url", r"^[a-z]+://[^/]+(/[^?#]*)", 1)
    faults = {
        "id": ~F.coalesce(F.col("external_id").rlike(r"^[0-9]{4}\.[0-9]{4,5}$"), F.lit(False)), "host": ~urls.hostname(F.col("canonical_url")).isin(list(hosts)),
        "path": path != F.concat(F.lit("/abs/"), F.coalesce("external_id", F.lit(""))), "day": ~F.coalesce(F.date_add(times.local_date(F.col("at"), zone), 1) == F.col("announced"), F.lit(False)),
    }
    found = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in faults.items())))
    return papers.select("id", F.explode(found).alias("fault"))


def batch_status(runs: DataFrame, day: str, details: dict[str, str], missing: str = "unavailable") -> DataFrame:
    """One row with the status of the latest run whose details say that it made a day's batch; `missing` if there is none."""
    rows = runs.where(F.get_json_object("details", "$.digest_date") == day)
    for name, value in details.items():
        rows = rows.where(F.get_json_object("details", f"$.{name}") == value)
    return rows.agg(F.coalesce(F.max_by(F.when(F.col("sources_failed") > 0, "partial").otherwise("complete"), F.struct("started_at", "id")), F.lit(missing)).alias("status"))


def message(status: Column, texts: dict[str, str], other: str) -> Column:
    """The text that goes with a status."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in texts.items() for x in kv)), status), F.lit(other))


def snapshot_instant(runs: DataFrame, kind: str, reference: Column) -> DataFrame:
    """One row: when the latest run of a kind began at or before a reference, which is what a replay goes by; the reference if there is none."""
    return runs.where((F.col("kind") == kind) & (F.col("started_at") <= reference)).agg(F.coalesce(F.max("started_at"), reference).alias("at"))


def attempts_used(failed: DataFrame, attempt: Column, current: int = 1) -> DataFrame:
    """One row: attempts that failed runs used, at least one each, and those of the current run before this one."""
    return failed.agg((F.coalesce(F.sum(F.greatest(F.lit(1), F.coalesce(attempt, F.lit(1)))), F.lit(0)) + max(0, current - 1)).cast("long").alias("attempts"))


def audited(rows: DataFrame, status: Column) -> DataFrame:
    """One row of counts by what became of an address: checked, verified, restricted, unverified and unknown."""
    kinds = {"verified": F.startswith(status, F.lit("verified")), "restricted": status == "access-restricted", "unverified": status == "unverified", "unknown": status.isNull()}
    return rows.agg(F.count("*").alias("checked"), *(F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long").alias(n) for n, c in kinds.items()))


def reaudited(rows: DataFrame, results: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows with the status of a new check of their address, the old one where it wasn't checked. results: on, status."""
    new = results.groupBy(*on).agg(F.max("status").alias("_new"))
    return rows.join(new, list(on), "left").withColumn("status", F.coalesce("_new", "status")).drop("_new")


def keep_usable(groups: DataFrame, results: DataFrame, statuses: Sequence[str] = USABLE) -> DataFrame:
    """(id, member): groups whose primary address is usable, with those of their alternates that are.

    groups: id, member, url, source_id, where the primary has member = id; results: url, source_id, status. Each address is looked up once, a primary
    that isn't usable takes its group along, an alternate only itself.
    """
    good = results.where(usable(F.col("status"), statuses)).select("url", "source_id").distinct()
    sure = groups.join(good, ["url", "source_id"], "left_semi")
    heads = sure.where("id = member").select("id").distinct()
    return sure.join(heads, "id", "left_semi").select("id", "member")


def all_or_nothing(kept: DataFrame, wanted: DataFrame, key: str = "id") -> DataFrame:
    """The kept rows if there are as many of them as wanted keys, else none: a batch is published whole or not at all."""
    have, want = (rows.agg(F.count_distinct(key)).first()[0] for rows in (kept, wanted))
    return kept if have == want else kept.limit(0)


def fresh(generated: Column, now: Column, zone: str) -> Column:
    """Whether something was made on the local day of now."""
    return F.coalesce(times.local_date(generated, zone) == times.local_date(now, zone), F.lit(False))


def pages_needed(pages: DataFrame, since: Column, most: int = 10) -> DataFrame:
    """Pages (page, oldest) of a history, newest first, up to the first that holds something older than `since`, at most so many."""
    last = pages.where(F.col("oldest") < since).agg(F.min("page")).first()[0]  # one number
    return pages.where(F.col("page") <= min(most, most if last is None else last))
