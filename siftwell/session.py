"""What operators ask of the session: a shared folder to cut lineage in, and table access."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Only a session in one process may lack it: there a local one is made."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named is None and sc._jsc.sc().getCheckpointDir().isEmpty() and not sc.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir names no folder; executors need one that they share")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="siftwell-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder for a table that an operator writes and reads again."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, freed: bool = False) -> DataFrame:
    """The same rows with their lineage cut by a checkpoint in the shared folder. freed: the shuffles that made them are deleted at once, not when the driver collects its garbage."""
    spark = df.sparkSession
    shared_dir(spark)
    if not freed:
        return df.checkpoint()
    before = spark.conf.get(_FREE, None)
    spark.conf.set(_FREE, "true")
    try:
        return df.select("*").checkpoint()  # a plan takes the setting when it is made
    finally:
        if before is None:
            spark.conf.unset(_FREE)
        else:
            spark.conf.set(_FREE, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The same rows over as many partitions as there are cores, where a small file would leave most of them idle.

    A scan of more partitions than half the cores is left as it is, so nothing is shuffled where there is much to read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() * 2 < cores else df
