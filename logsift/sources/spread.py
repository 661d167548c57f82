"""Parallelism of badly split inputs."""

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """Rebalance a table whose files give fewer tasks than the cluster has cores.

    One big row group or one gzip file is one task. Well-split inputs pass unchanged,
    so no shuffle is added at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= 2 * cores:
        return df
    return df.repartition(2 * cores)
