"""A lookup that stands hot keys: broadcast behind a check of the table's size, else by shuffle with the hot keys salted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000
HOT_ROWS = 1_000_000


def lookup(rows: DataFrame, table: DataFrame, key: str, small: int = BROADCAST_ROWS, hot: int = HOT_ROWS) -> DataFrame:
    """Rows with the columns of their key in `table`, which has one row a key; rows without one are left out, as are null keys.

    The table is counted, so it should be at rest. If it is small it is broadcast. Else keys of more than `hot` rows are split into salted parts of
    about that size, and only their rows of the table are repeated, once a part; there are at most rows / hot such keys.
    """
    if table.count() <= small:
        return rows.join(F.broadcast(table), key)
    many = rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > hot).select(key, F.ceil(F.col("_n") / hot).cast("int").alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    salted = rows.join(many, key, "left").withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), parts).cast("int")).drop("_parts")
    repeated = table.join(many, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return salted.join(repeated, [key, "_salt"]).drop("_salt")
