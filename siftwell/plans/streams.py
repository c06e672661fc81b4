"""Streaming queries, drained over what has landed, against the SQL of the same result in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.operators.store import Table
from siftwell.session import scratch_path
from siftwell.streaming import ingest

QUERIES: dict = {}
SQL: dict[str, str] = {}


def stream_local_days(spark: SparkSession, d: str) -> DataFrame:
    rows = ingest.landed(spark, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    sums = ingest.tumbling(rows, "ts", ["event_type"], [F.count("*").alias("n"), F.sum("value").alias("total")])
    out = ingest.drain(sums.select(F.date_format(F.col("window.start") + F.expr("interval 8 hours"), "yyyy-MM-dd").alias("day"), "event_type", "n", "total"), "complete")
    return out.withColumn("total", F.round("total", 4))


def stream_checks_once(spark: SparkSession, d: str) -> DataFrame:
    rows = ingest.landed(spark, f"{d}/source_checks.parquet").select("id", "source_id", "checked_at", "success")
    return ingest.drain(ingest.once_each(rows, ["id"], "checked_at", "48 hours")).select("id", "source_id", "success")


def stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    target = Table(spark, scratch_path(spark, "upserted"), ["kind", "canonical_url"])
    rows = ingest.landed(spark, f"{d}/incoming_items.parquet").where("kind is not null and canonical_url is not null")
    rows = rows.select("id", "kind", "canonical_url", "title", (F.floor(F.unix_micros("received_at") / 1000)).cast("long").alias("created_ms"))
    ingest.drain(rows, sink=ingest.merge_into(target, keep=("id", "created_ms"), order=("created_ms", "id")))
    return target.read()


QUERIES |= {f.__name__: f for f in (stream_local_days, stream_checks_once, stream_upsert)}
SQL["stream_local_days"] = "SELECT strftime(date_trunc('day', ts + INTERVAL 8 HOUR), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"
SQL["stream_checks_once"] = "SELECT DISTINCT id, source_id, success FROM source_checks"
SQL["stream_upsert"] = (
    "SELECT kind, canonical_url, first(id ORDER BY c, id) AS id, first(c ORDER BY c, id) AS created_ms, first(title ORDER BY c DESC, id DESC) AS title "
    "FROM (SELECT *, epoch_ms(received_at) AS c FROM incoming_items) WHERE kind IS NOT NULL AND canonical_url IS NOT NULL GROUP BY kind, canonical_url"
)
