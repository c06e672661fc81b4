"""Streams of landed files: late data, duplicates, windows, and keyed merges per micro-batch.

State is bounded by watermarks; a merge is idempotent by batch id, so a batch that runs again after a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftwell.operators.store import Table
from siftwell.session import scratch_path


def landed(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream over parquet files, with the schema of those that are there; path is a file or a folder."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", name if "*" in name else "*").option("recursiveFileLookup", "true").parquet(path if "*" not in name else folder)


def once_each(rows: DataFrame, keys: Sequence[str], at: str, late: str = "48 hours") -> DataFrame:
    """Rows once a key within the watermark; what comes later than that is dropped, as is its state."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark(list(keys))


def within_tolerance(rows: DataFrame, at: str, now, ahead: str = "2 hours") -> DataFrame:
    """Rows that aren't dated further ahead than the tolerance."""
    return rows.where(F.col(at) <= now + F.expr(f"interval {ahead}"))


def tumbling(rows: DataFrame, at: str, keys: Sequence[str], aggregates: Sequence, size: str = "1 day", offset: str = "16 hours", late: str = "48 hours") -> DataFrame:
    """Windows of a local day: a day from 16:00 UTC is one at eight hours east."""
    return rows.withWatermark(at, late).groupBy(F.window(at, size, size, offset), *keys).agg(*aggregates)


def merge_into(table: Table, name: str = "stream", **how) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that merges each batch into a table once: what was merged is marked in the table itself, so a batch
    that runs again after a failure, in whatever process, changes nothing. `name` is that of the stream among those that write to the table."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        table.merge(batch, f"{name}-{batch_id}", **how)

    return merge


def drain(rows: DataFrame, mode: str = "append", sink: Callable[[DataFrame, int], None] | None = None) -> DataFrame | StreamingQuery:
    """Runs a stream over all that has landed and stops; without a sink, returns what it wrote."""
    spark = rows.sparkSession
    state = scratch_path(spark, "stream-state")
    writer = rows.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    if sink is not None:
        query = writer.foreachBatch(sink).start()
        query.awaitTermination()
        return query
    out = scratch_path(spark, "stream-out")
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
        query.awaitTermination()
    else:
        # complete results replace each other; the last one stays
        writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)
