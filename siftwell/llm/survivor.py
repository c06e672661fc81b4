"""One surviving record of each group of duplicates, field by field.

Each field is a partial order over the values that a group has, of which the topologically latest is taken. For `best_fields` the orders are given: the
most trusted tier, as a stated precedence; the most complete summary that wasn't cut off and the latest instant, as stamps. Fields that change
over time (CURRENT) take their current value, by currency reasoning: the timestamped rows of
all groups teach which values follow which (a value precedes another if it was followed by it far more often than the other
way round, and all that those precede, be they in the group or not); in each group, timestamps order the values that have any, the learned precedence orders those that lack
one, and the topologically latest value is taken: one that no other value of the group follows.

All is aggregated by group with partial aggregation, so a group may hold any share of the rows; the partial order of a
group is joined from its distinct values and the learned transitions, never from all pairs.

Defined results: a null or blank key belongs to no group, and a group of one row is left out of `best_fields`; a field without a usable
value gives no row (`best_fields`) or null (`records`); equal values go to the smaller id; repeated rows of one id
are one row; values of a cycle of learned precedence have no order among themselves, so that the latest timestamp decides, else the
smallest id; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.shown import BLANK_CLASS, shown
from siftwell.llm.truncation import cut_records
from siftwell.operators.timeline import instants
from siftwell.session import cut

#: Fields whose current value is wanted, as expressions over a record.
CURRENT = {"title": "title", "category": "category", "prompt_version": "get_json_object(metadata_json, '$.llm_screening.prompt_version')"}
#: A transition is learned if it was seen this often, and this many times as often as its reverse.
SEEN, OFTENER = 3, 2


def _keyed(items: DataFrame, sources: DataFrame, extra: list[str]) -> DataFrame:
    """(cluster_key, id, tier, length, utc_us, *extra) of the records with a key."""
    key = F.lower(F.regexp_replace("cluster_key", f"^{BLANK_CLASS}+|{BLANK_CLASS}+$", ""))
    rows = items.select(key.alias("cluster_key"), "id", "source_tier", F.length(shown(F.col("summary"))).alias("length"), *extra).where("cluster_key != '' and id is not null")
    whole = cut_records(items).withColumn("was_cut", F.lit(True))
    rows = rows.join(instants(items, sources), "id", "left").join(whole, "id", "left")
    tier = F.when(F.col("source_tier").between(1, 3), F.col("source_tier"))
    length = F.when(F.col("was_cut").isNull() & (F.col("length") > 0), F.col("length"))
    return rows.withColumn("tier", tier).withColumn("length", length).drop("source_tier", "was_cut").dropDuplicates(["cluster_key", "id"])


def _least(order: Column, value: Column) -> Column:
    """The value of the row that comes first in the order, among rows that have one; smaller ids first."""
    return F.min_by(value, F.when(order.isNotNull(), F.struct(order, F.col("id"))))


#: The precedence of tiers as it is stated: a tier is followed by every lower one.
TIERS = [("source_tier", str(b), str(a)) for b in (1, 2, 3) for a in (1, 2, 3) if a < b]


def best_fields(items: DataFrame, sources: DataFrame) -> DataFrame:
    """(cluster_key, field, id): for each group of two or more, the record with the best value of each field.

    Each field is a partial order over the values of a group, whose topologically latest value is taken as for changing fields: tiers follow
    each other as stated in TIERS, without any time; instants and lengths of summaries are stamps of their own.
    """
    rows = _keyed(items, sources, [])
    stamped = {"source_tier": (F.col("tier").cast("string"), F.lit(None).cast("long")), "summary": (F.col("length").cast("string"), F.col("length").cast("long")), "published_at": (F.col("utc_us").cast("string"), F.col("utc_us"))}
    fields = F.array(*(F.struct(F.lit(f).alias("field"), v.alias("value"), at.alias("stamp")) for f, (v, at) in stamped.items()))
    values = rows.select("cluster_key", "id", F.explode(fields).alias("x")).select("cluster_key", "id", "x.field", "x.value", F.col("x.stamp").alias("utc_us"))
    groups = rows.groupBy("cluster_key").agg(F.count("*").alias("rows")).where("rows > 1").select("cluster_key")
    own = _own_values(values.join(groups, "cluster_key", "left_semi"))
    return latest(own, items.sparkSession.createDataFrame(TIERS, "field string, before string, after string")).select("cluster_key", "field", "id")


def transitions(values: DataFrame) -> DataFrame:
    """(field, before, after): learned precedence. values: (cluster_key, field, value, id, utc_us).

    A value is followed by the next one of its group in time. That is looked for within days first and from the last value of a day to the
    first of the next one after that, so that no task sees a whole group, however large.
    """
    day = F.floor(F.col("since") / 86_400_000_000).cast("int")
    stamped = values.where("utc_us is not null").groupBy("cluster_key", "field", "value").agg(F.min("utc_us").alias("since")).withColumn("day", day)
    within = stamped.selectExpr("field", "value as before", "lead(value) over (partition by cluster_key, field, day order by since, value) as after")
    ends = stamped.groupBy("cluster_key", "field", "day").agg(F.min_by("value", F.struct("since", "value")).alias("first"), F.max_by("value", F.struct("since", "value")).alias("before"))
    across = ends.selectExpr("field", "before", "lead(first) over (partition by cluster_key, field order by day) as after")  # a row a day
    counts = within.unionByName(across).where("after is not null").groupBy("field", "before", "after").agg(F.count("*").alias("n"))
    reverse = counts.select("field", F.col("after").alias("before"), F.col("before").alias("after"), F.col("n").alias("back"))
    return counts.join(reverse, ["field", "before", "after"], "left").where((F.col("n") >= SEEN) & (F.col("n") >= OFTENER * F.coalesce("back", F.lit(0)))).select("field", "before", "after")


def reachable(learned: DataFrame) -> DataFrame:
    """(field, before, after): learned precedence over any number of steps, without pairs that precede each other.

    Paths double in length each round, so the rounds grow with the logarithm of the longest shortest one.
    """
    paths = cut(learned.distinct())
    known = paths.count()
    while known:
        on = paths.select("field", F.col("before").alias("after"), F.col("after").alias("far"))
        longer = paths.join(on, ["field", "after"]).select("field", "before", F.col("far").alias("after"))
        paths = cut(paths.unionByName(longer).distinct())
        if (now := paths.count()) == known:
            break
        known = now
    back = paths.select("field", F.col("after").alias("before"), F.col("before").alias("after"))
    return paths.join(back, ["field", "before", "after"], "left_anti")


def _own_values(values: DataFrame) -> DataFrame:
    """(cluster_key, field, value, last, id): each value of a group once, with its latest stamp and its smallest id."""
    return cut(values.where("value is not null").groupBy("cluster_key", "field", "value").agg(F.max("utc_us").alias("last"), F.min("id").alias("id")))


def latest(own: DataFrame, precedence: DataFrame) -> DataFrame:
    """(cluster_key, field, value, id): the topologically latest value of each group and field, by stamps and a precedence that is closed.

    own: as of `_own_values`; precedence: (field, before, after).
    """
    newest = own.groupBy("cluster_key", "field").agg(F.max("last").alias("newest"))
    # among stamped values the latest is not followed by another; the precedence decides wherever one lacks a stamp
    after = own.select("cluster_key", "field", F.col("value").alias("after"), F.col("last").alias("after_last"))
    followed = own.join(precedence.withColumnRenamed("before", "value"), ["field", "value"]).join(after, ["cluster_key", "field", "after"])
    followed = followed.where("last is null or after_last is null").select("cluster_key", "field", "value").distinct().withColumn("followed", F.lit(True))
    rows = own.join(newest, ["cluster_key", "field"]).join(followed, ["cluster_key", "field", "value"], "left")
    open_ = F.col("followed").isNull() & (F.col("last").isNull() | (F.col("last") == F.col("newest")))
    # unfollowed first; of these a value that only precedence makes last beats none, and time beats mere presence
    rank = F.struct(F.when(open_, 0).otherwise(1), F.when(F.col("last").isNull(), 1).otherwise(0), -F.coalesce("last", F.lit(0)), F.col("id"), F.col("value"))
    return rows.groupBy("cluster_key", "field").agg(F.min_by(F.struct("value", "id"), rank).alias("x")).select("cluster_key", "field", "x.value", "x.id")


def current_values(values: DataFrame) -> DataFrame:
    """(cluster_key, field, value): the topologically latest value of each group and field, by learned precedence."""
    own = _own_values(values)
    return latest(own, reachable(transitions(values.where("value is not null")))).select("cluster_key", "field", "value")


def records(items: DataFrame, sources: DataFrame) -> DataFrame:
    """One surviving record a group: cluster_key, members, source_tier, summary, published_ms and the current values."""
    have = [f for f, e in CURRENT.items() if f in items.columns or "metadata_json" in e and "metadata_json" in items.columns]
    rows = cut(_keyed(items, sources, ["summary", *(F.expr(CURRENT[f]).alias(f) for f in have)]))
    base = rows.groupBy("cluster_key").agg(
        F.count("*").alias("members"), F.min("tier").alias("source_tier"), _least(-F.col("length"), F.col("summary")).alias("summary"), F.floor(F.max("utc_us") / 1000).cast("long").alias("published_ms")
    )
    fields = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in have))
    values = rows.select("cluster_key", "id", "utc_us", F.explode(fields).alias("x")).select("cluster_key", "id", "utc_us", "x.field", "x.value")
    now = current_values(values).groupBy("cluster_key").pivot("field", have).agg(F.first("value"))
    return base.join(now, "cluster_key", "left")
