"""Projections for pages and for outside services: bounded texts, lists and numbers as plain column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounded_number(value: Column, low: float, high: float) -> Column:
    """A text or number as a double within bounds; null where it's none or lies outside."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number) & number.between(low, high), number)


def whole_number(value: Column) -> Column:
    """A text or number as a whole number, never below 0; 0 where it's none."""
    return F.greatest(F.lit(0).cast("long"), F.coalesce(value.try_cast("long"), F.lit(0).cast("long")))


def clamped(value: Column, low: int, high: int) -> Column:
    """A whole number held between bounds; the lower one where there is none."""
    return F.least(F.lit(high), F.greatest(F.lit(low), F.coalesce(value.try_cast("int"), F.lit(low))))


def signal_line(platform: Column, rank: Column, points: Column, comments: Column, separator: str = " / ") -> Column:
    """One line of a signal: its platform and what is known of its rank, points and comments."""
    parts = [platform, F.when(rank > 0, F.concat(F.lit("#"), rank)), F.when(points > 0, F.concat(points, F.lit(" points"))), F.when(comments > 0, F.concat(comments, F.lit(" comments")))]
    return F.array_join(F.array_compact(F.array(*parts)), separator)


def first_lines(lines: DataFrame, key: str, place: str, line: str, most: int = 6) -> DataFrame:
    """(key, lines): the first lines of each key, in order of place; only `most` are kept while they are gathered."""
    few = lines.selectExpr(key, place, line, f"row_number() over (partition by {key} order by {place}, {line}) as _k").where(F.col("_k") <= most)
    return few.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", line))), lambda x: x[line]).alias("lines"))


def candidate(title: int = 1000, summary: int = 8000, labels: int = 12) -> Column:
    """A record as the JSON that a judging service is given: bounded texts and lists, the columns of its kind only."""
    text = lambda c, n: F.left(F.coalesce(c, F.lit("")), F.lit(n)).alias(c)
    paper = F.when(F.col("kind") == "paper", F.slice(F.coalesce("categories", F.array().cast("array<string>")), 1, labels)).alias("categories")
    news = F.when(F.col("kind") != "paper", F.slice(F.coalesce("tags", F.array().cast("array<string>")), 1, labels)).alias("tags")
    return F.to_json(F.struct("id", text("title", title), text("summary", summary), paper, news))


def excerpt(summary: Column, most: int = 480) -> Column:
    """(excerpt, truncated) of a text: its first characters, and whether there were more."""
    text = F.coalesce(summary, F.lit(""))
    return F.struct(F.left(text, F.lit(most)).alias("excerpt"), (F.length(text) > most).alias("truncated"))


def labelled(key: Column, labels: dict[str, str]) -> Column:
    """The label of a key; keys without one stand for themselves."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in labels.items() for x in kv)), key), key)


def first_names(names: Column, most: int = 4, more: str = " et al.") -> Column:
    """The first names of a list, and whether there are more."""
    listed = F.coalesce(names, F.array().cast("array<string>"))
    return F.concat(F.array_join(F.slice(listed, 1, most), ", "), F.when(F.size(listed) > most, F.lit(more)).otherwise(""))


def bar_width(value: Column, largest: Column) -> Column:
    """A value as a share of the largest in percent, between 0 and 100; of 100 where the largest is unknown or not positive."""
    top = F.when(largest > 0, largest).otherwise(100.0)
    return F.least(F.abs(F.coalesce(value, F.lit(0.0))) / top * 100, F.lit(100.0))


def flagged(rows: DataFrame, chosen: DataFrame, key: str, name: str) -> DataFrame:
    """Rows with a flag that tells whether `chosen` has their key; a null key has none."""
    have = chosen.where(F.col(key).isNotNull()).select(key).distinct().withColumn("_in", F.lit(True))
    return rows.join(have, key, "left").withColumn(name, F.coalesce("_in", F.lit(False))).drop("_in")


def prompt_manifest(prompts: DataFrame, needed: Sequence[str]) -> DataFrame:
    """(name, sha256, missing): the hash of each prompt (name, text) and the placeholders that it lacks."""
    lacking = F.array_compact(F.array(*(F.when(~F.contains("text", F.lit("{" + n + "}")), F.lit(n)) for n in needed)))
    return prompts.select("name", F.sha2("text", 256).alias("sha256"), F.array_join(lacking, ",").alias("missing"))
