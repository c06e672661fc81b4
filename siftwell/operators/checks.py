"""Completeness: what arrived against what was declared, as grouped counts whose violations are rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def repeated_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n) of keys that occur more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def declared_totals(pages: DataFrame, group: str, total: str, count: str) -> DataFrame:
    """A row a group: how many totals its pages declare, the largest, how many entries came, and whether all agrees."""
    found = pages.groupBy(group).agg(F.count_distinct(total).alias("totals"), F.max(total).cast("long").alias("declared"), F.coalesce(F.sum(count), F.lit(0)).cast("long").alias("came"))
    return found.withColumn("complete", (F.col("totals") == 1) & (F.col("declared") == F.col("came")))


def key_sets_differ(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one side has; empty if both have the same."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def descending(rows: DataFrame, group: str, place: str, value: str) -> DataFrame:
    """Rows whose value isn't below that of the place before, within a group (the sections of one page)."""
    return rows.selectExpr("*", f"lag({value}) over (partition by {group} order by {place}) as _before").where(F.col(value) >= F.col("_before")).drop("_before")


def bracketed(days: DataFrame, group: str, day: str, target: str) -> DataFrame:
    """(group, state): whether a day is there, missing between days that are there, or not yet covered."""
    found = days.groupBy(group).agg(F.min(day).alias("low"), F.max(day).alias("high"), F.max((F.col(day) == F.lit(target)).cast("int")).alias("has"))
    state = F.when(F.col("has") == 1, "present").when((F.col("low") < F.lit(target)) & (F.lit(target) < F.col("high")), "empty").otherwise("unknown")
    return found.select(group, state.alias("state"))


def members(eligible: DataFrame, confirmed: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, excluded): distinct eligible keys that are confirmed, and those that aren't."""
    ids, sure = eligible.select(key).distinct(), confirmed.select(key).distinct()
    return ids.join(sure, key, "left_semi"), ids.join(sure, key, "left_anti")


def done_today(runs: DataFrame, kind: str, day: str, zone: str) -> DataFrame:
    """One row: whether a run of a kind began on a local day and finished with a source that answered."""
    from siftwell.functions.times import local_date

    found = runs.where((F.col("kind") == kind) & F.col("finished_at").isNotNull() & (F.col("sources_ok") > 0) & (local_date(F.col("started_at"), zone) == F.lit(day).cast("date")))
    return found.agg((F.count("*") > 0).alias("done"))
