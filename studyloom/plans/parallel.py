"""Use of all cores for narrow, CPU-heavy work."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """`df` over at least as many partitions as there are cores.

    Text rules cost far more than reading: a table in a few small files would run on as many tasks. Large inputs have
    more splits than cores and are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
