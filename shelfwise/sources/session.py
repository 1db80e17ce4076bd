"""Runtime SQL settings the analyses count on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join partition even where that costs another shuffle: one order, customer or store may hold a large
    # part of all rows, and a task over all of it costs far more.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # What adaptive execution joins to one task's share. Keys and sums take thirty times as much in memory as compressed.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply ``SETTINGS`` to a running session. Memory, broadcast limit and the least number of partitions stay the cluster's choice."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark
