"""Reading tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_spread(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table; one of fewer splits than there are cores is dealt out to all of them.

    A table of one small file would keep one core busy. Its rows move once for that;
    those of a large table, which has splits enough, don't.
    """
    table = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    files = table.inputFiles()
    return table.repartition(cores) if len(files) < cores and table.rdd.getNumPartitions() < 2 * cores else table
