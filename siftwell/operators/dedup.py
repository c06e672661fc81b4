"""Exact deduplication with survivorship.

Records of one key (canonical address, else title fingerprint) leave one winner: the lowest tier, then the longest
summary, then the earliest instant, then the earliest arrival. Winners come from one partial aggregation, so a key may
hold any share of the rows. What a winner displaced is a table, a row an alternate, never an array of a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dedup_key(url: Column, fingerprint: Column) -> Column:
    return F.when(F.coalesce(url, F.lit("")) != "", url).otherwise(F.concat(F.lit("title:"), fingerprint))


def preference(tier: Column, summary: Column, at: Column, arrival: Column) -> Column:
    """Orders records of one key, best first; unknown tiers and times come last, a missing summary counts as empty."""
    return F.struct(
        F.coalesce(tier.cast("int"), F.lit(2**31 - 1)).alias("tier"), (-F.coalesce(F.length(summary), F.lit(0))).alias("length"), at.isNull().alias("timeless"), at.alias("at"), arrival.alias("arrival")
    )


def winners(records: DataFrame) -> DataFrame:
    """(key, winner, members) of records (id, key, rank); ids are in order of arrival."""
    return records.where("key is not null").groupBy("key").agg(F.min_by("id", "rank").alias("winner"), F.count("*").alias("members"))


def alternates(records: DataFrame) -> DataFrame:
    """(winner, alternate, place): what each winner displaced, in order.

    Records arrive in order of id; the best so far is the champion. A champion that is displaced takes nothing along, so the
    winner has the champion before it and all that came after it.
    """
    best = winners(records).where("members > 1").select("key", "winner")
    rows = records.join(best, "key")
    before = rows.where("id < winner").groupBy("winner").agg(F.min_by("id", "rank").alias("alternate"))
    after = rows.where("id > winner").select("winner", F.col("id").alias("alternate"))
    return before.unionByName(after).select("winner", "alternate", F.when(F.col("alternate") < F.col("winner"), 0).otherwise(1).alias("place"))


def merged_signals(signals: DataFrame) -> DataFrame:
    """Signals of a key's records, each (platform, discussion, period) once, the earliest kept.

    signals: key, id, pos, platform, discussion, period and any other columns.
    """
    names = [c for c in signals.columns if c not in ("key", "platform", "discussion", "period", "id", "pos")]
    first = signals.groupBy("key", F.coalesce("platform", F.lit("")).alias("platform"), F.coalesce("discussion", F.lit("")).alias("discussion"), F.coalesce("period", F.lit("")).alias("period"))
    kept = first.agg(F.min_by(F.struct("id", "pos", *names), F.struct("id", "pos")).alias("x"))
    return kept.select("key", "platform", "discussion", "period", "x.*")
