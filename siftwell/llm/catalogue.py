"""The queries of the training-data problems over texts, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftwell.llm import encoding, history, mixing, neardup, spans, spelling, survivor, truncation
from siftwell.session import spread
from siftwell.session import table as plain_table


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spread(plain_table(spark, d, name))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return spelling.same_looking(table(spark, d, "items"))


def p1_texts(spark: SparkSession, d: str) -> DataFrame:
    return spelling.canonical_texts(table(spark, d, "items")).select("id", "field", "canonical")


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    return spelling.look_classes(table(spark, d, "items"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return history.repeats(table(spark, d, "items"), table(spark, d, "incoming_items"), table(spark, d, "sources"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.pairs(table(spark, d, "items"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.groups(table(spark, d, "items"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return survivor.best_fields(table(spark, d, "items"), table(spark, d, "sources"))


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    return survivor.records(table(spark, d, "items"), table(spark, d, "sources"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_records(table(spark, d, "items"))


def p6_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_rates(table(spark, d, "items"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode(table(spark, d, "documents"))


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    return encoding.decode(encoding.encode(table(spark, d, "documents")))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"), table(spark, d, "sources"))


def p8_selected(spark: SparkSession, d: str) -> DataFrame:
    return mixing.selected(table(spark, d, "documents"), table(spark, d, "mix_targets"), table(spark, d, "sources"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.sharing(table(spark, d, "documents"))


def p9_coverage(spark: SparkSession, d: str) -> DataFrame:
    return spans.coverage(table(spark, d, "documents"))


QUERIES = {"p1_found": p1_found, "p1_texts": p1_texts, "p1_classes": p1_classes, "p2_found": p2_found, "p3_found": p3_found, "p3_groups": p3_groups, "p5_found": p5_found, "p5_records": p5_records, "p6_found": p6_found, "p6_rates": p6_rates, "p7_ids": p7_ids, "p7_decoded": p7_decoded, "p8_selected": p8_selected, "p8_shares": p8_shares, "p9_found": p9_found, "p9_coverage": p9_coverage}
SQL: dict[str, str] = {}
