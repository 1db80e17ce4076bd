"""Tables laid out for joins and group-bys on a key: bucketed, if the key allows it.

A bucketed table is dealt out once, when it is written. What groups or joins by its key afterwards needs no exchange. Nothing can
split a bucket, though, so a key that holds a large part of the rows would make one task of all later ones slow. Such a
table is written plainly instead, clustered by the key, and its joins are left to adaptive execution, which splits them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.sources.storage import shared_dir, write_bucketed, write_once

#: Rows that one key may hold, in shares of an even bucket, for the table to be bucketed.
MOST_IN_A_KEY = 2.0
#: Rows of an even bucket where the number of buckets follows the table: what one task sorts in memory, several times at once.
ROWS_IN_A_BUCKET = 250_000


def _largest_key(df: DataFrame, key: str) -> tuple[int, int]:
    """All rows, and those of the most frequent key (missing keys are one)."""
    per_key = df.groupBy(key).agg(F.count("*").alias("n"))
    found = per_key.agg(F.sum("n").alias("rows"), F.max("n").alias("most")).first()
    return found["rows"] or 0, found["most"] or 0


def bucket_count(df: DataFrame, *key: str) -> int | None:
    """How many buckets ``df`` takes by ``key``: they grow with its rows, so that a bucket does not. None if one would hold too many.

    Reads the key alone, twice, and shuffles a count per bucket. A frame with some of these rows may be dealt out likewise.
    Where rows are many there are as many buckets as shuffle partitions at least: with fewer the engine moves both sides of a join.
    """
    spark, rows = df.sparkSession, df.count()
    least = spark.sparkContext.defaultParallelism
    if rows > ROWS_IN_A_BUCKET:
        least = max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
    buckets = max(-(-rows // ROWS_IN_A_BUCKET), least)
    in_bucket = df.groupBy(F.pmod(F.hash(*key), F.lit(buckets)).alias("bucket")).agg(F.count("*").alias("n"))
    largest = in_bucket.agg(F.max("n").alias("n")).first()["n"] or 0
    return buckets if largest <= MOST_IN_A_KEY * ROWS_IN_A_BUCKET else None


def fills_buckets(df: DataFrame) -> bool:
    """Whether ``df`` has more rows than one bucket holds; for fewer an exchange costs less than a file per bucket."""
    return df.count() > ROWS_IN_A_BUCKET


def partition_by_rows(spark: SparkSession, rows: int) -> None:
    """Let shuffles start with partitions of at most ``ROWS_IN_A_BUCKET`` of that many rows; adaptive execution joins small ones.

    With a fixed number what a task holds would grow with the tables. The number set for the session is the least.
    """
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = max(-(-rows // ROWS_IN_A_BUCKET), least)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(first))


def write_by_key(df: DataFrame, label: str, key: str, buckets: int | None) -> DataFrame:
    """Write ``df`` in that many buckets by ``key``; without a number (``bucket_count``) plainly, clustered by the key."""
    return write_bucketed(df, label, key, buckets) if buckets else write_once(df, label, key)


def save_bucketed(df: DataFrame, name: str, key: str, buckets: int, folder: str | None = None) -> tuple[DataFrame, bool]:
    """Save ``df`` as table ``name``, bucketed and sorted by ``key``, and return a scan of it and whether it is bucketed.

    A table whose largest key holds more than ``MOST_IN_A_KEY`` even buckets is written as a plain table clustered by the key.
    One file per bucket: rows are dealt out once. ``df`` is read twice (the key alone, then all), so pass a written table.
    """
    spark = df.sparkSession
    rows, most = _largest_key(df, key)
    if most * buckets > MOST_IN_A_KEY * max(rows, buckets):
        return write_once(df, name, key), False
    writer = df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
    writer.option("path", f"{folder or shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name), True
