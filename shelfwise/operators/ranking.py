"""Global order without a global window.

``ntile() over (order by ...)`` and ``percentile_cont over ()`` send every row to one task in Spark. Here the few rows that
delimit buckets or surround a percentile are found by counting (``operators.selection``), and no row moves. Running totals
and row numbers need the rows in order: they are range-partitioned on a total order and written once, and one count or sum
per partition carries over to the partitions behind it.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.operators.selection import comes_after, key_columns, select_ranks, whole_units
from shelfwise.sources.storage import write_once

_SLOT_BITS = 33  # monotonically_increasing_id keeps the partition above, the position within it below


class OrderedRows:
    """Rows written in a global total order.

    ``order`` must be total (end with a unique key): ties then never decide the result, and a value shared by a third of
    the rows still spreads over many partitions.
    """

    def __init__(self, df: DataFrame, order: Sequence[str | Column], label: str):
        self.frame = write_once(
            df.repartitionByRange(*order)  # no number: adaptive execution sizes the partitions by their bytes
            .sortWithinPartitions(*order)
            .withColumn("_address", F.monotonically_increasing_id()),
            label,
        )

    @staticmethod
    def partition() -> Column:
        return F.shiftright("_address", _SLOT_BITS)

    def with_position(self) -> DataFrame:
        """Every row with its 1-based global ``position``; the offsets have one row per partition."""
        running = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
        offsets = (
            self.frame.groupBy(self.partition().alias("_p"))
            .agg(F.count("*").alias("_n"))
            .select("_p", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_before"))
        )
        slot = F.col("_address").bitwiseAND((1 << _SLOT_BITS) - 1)
        return (
            self.frame.withColumn("_p", self.partition())
            .join(F.broadcast(offsets), "_p")
            .withColumn("position", F.col("_before") + slot + 1)
            .drop("_p", "_before", "_address")
        )


def add_ntiles(df: DataFrame, key: str, buckets: int, **orders: tuple[str, bool]) -> DataFrame:
    """Add one exact NTILE column per keyword, ``name=(column, descending)``; ties are broken by the unique ``key``.

    NULLs come first ascending and last descending. Bucket sizes follow NTILE: with n = q * buckets + r the first r buckets hold
    q + 1 rows. The last row of every bucket is found by counting (``select_ranks``), all orders in the same passes; rows
    are compared with it where they are. ``df`` is read several times, so pass a written table. Values count to four
    places; ``key`` is an integer or a text.
    """
    tie = key_columns(df, key)

    def sort_columns(column: str, descending: bool) -> list[Column]:
        units, missing = whole_units(F.col(column)), F.col(column).isNull()
        rank = F.when(missing, 1 if descending else 0).otherwise(0 if descending else 1)
        return [rank, F.coalesce(-units if descending else units, F.lit(0).cast("decimal(38,0)")), *tie]

    columns = [sort_columns(*spec) for spec in orders.values()]
    rows = df.count()
    share, extra = divmod(rows, buckets)
    last_of = [at for b in range(1, buckets) if (at := b * share + min(b, extra) - 1) >= 0]
    found = select_ranks(df, columns, {i: sorted(set(last_of)) for i in range(len(columns))}) if last_of else {}
    result = df
    for i, name in enumerate(orders):
        later = [comes_after(columns[i], found[i, at]).cast("int") for at in last_of]
        result = result.withColumn(name, sum(later, F.lit(1)))
    return result


def exact_percentiles(df: DataFrame, value: str, fractions: Sequence[Fraction]) -> list[Decimal | None]:
    """Continuous percentiles of a decimal column: the two rows around each fraction of the global order, interpolated exactly.

    Values count to four places and NULLs not at all; without a value the percentiles are None. The rows are found by counting
    (``select_ranks``), all of them in the same passes over the column. ``df`` is read several times: pass a written table.
    Runs its jobs when called.
    """
    present = df.select(whole_units(F.col(value)).alias("units")).dropna()
    rows = present.count()
    if rows == 0:
        return [None] * len(fractions)
    places = [divmod(f * (rows - 1), 1) for f in fractions]
    wanted = sorted({int(at) for low, part in places for at in ((low, low + 1) if part else (low,))})
    found = select_ranks(present, [[F.col("units")]], {0: wanted})
    at = lambda rank: Decimal(found[0, int(rank)][0]).scaleb(-4)
    return [
        at(low) + (at(low + 1) - at(low)) * Decimal(part.numerator) / Decimal(part.denominator) if part else at(low)
        for low, part in places
    ]


def exact_percentile(df: DataFrame, value: str, fraction: Fraction) -> Decimal | None:
    """One of ``exact_percentiles``."""
    return exact_percentiles(df, value, [fraction])[0]


def running_totals(df: DataFrame, value: str, key: str) -> DataFrame:
    """Add ``running_value`` (sum of ``value`` in descending order, ties by ``key``) and ``position`` without one task
    seeing all rows: sums per range partition are carried over to the following partitions."""
    ordered = OrderedRows(df, [F.col(value).desc(), F.col(key)], "running")
    carried = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ordered.frame.groupBy(OrderedRows.partition().alias("_p"))
        .agg(F.count("*").alias("_n"), F.sum(value).alias("_s"))
        .select(
            "_p",
            F.coalesce(F.sum("_n").over(carried), F.lit(0)).alias("_rows_before"),
            F.coalesce(F.sum("_s").over(carried), F.lit(0)).alias("_sum_before"),
        )
    )
    within = Window.partitionBy("_p").orderBy("_address")
    return (
        ordered.frame.withColumn("_p", OrderedRows.partition())
        .withColumn("_sum", F.sum(value).over(within.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_row", F.row_number().over(within))
        .join(F.broadcast(offsets), "_p")
        .withColumn("running_value", F.col("_sum_before") + F.coalesce("_sum", F.lit(0)))
        .withColumn("position", F.col("_rows_before") + F.col("_row"))
        .drop("_p", "_sum", "_row", "_rows_before", "_sum_before", "_address")
    )


def numbered_surplus(df: DataFrame, keys: Sequence[str], order: Sequence[Column], number: str = "rn") -> DataFrame:
    """Rows that ``row_number() over (partition by keys order by order)`` would number 2 and up, with that number.

    Keys that occur once are dropped first, so only repeated rows are put in order. The number is the global position
    minus that of the group's first row: a group of any size stays distributed.
    """

    def same_group(names: Sequence[str]) -> list[Column]:
        return [F.col(k).eqNullSafe(F.col(name)) for k, name in zip(keys, names)]

    names = [f"_{k}" for k in keys]
    repeated = df.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)]).agg(F.count("*").alias("_n")).filter("_n > 1")
    candidates = df.join(repeated, same_group(names), "left_semi")
    ordered = OrderedRows(candidates, [*[F.col(k) for k in keys], *order], "surplus").with_position()
    starts = ordered.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)]).agg(F.min("position").alias("_start"))
    return (
        ordered.join(starts, same_group(names))
        .withColumn(number, (F.col("position") - F.col("_start") + 1).cast("bigint"))
        .filter(F.col(number) > 1)
        .select(*df.columns, number)
    )
