"""Distinct counts of any period from small daily sketches.

Exact distinct counts cannot be added up: a month is not the sum of its days. A HyperLogLog sketch per day and store can be
merged, so counts of weeks, months, regions or all time come from the sketches alone, within a known error. The exact
counts stay the default everywhere else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.columns import month_of

#: Columns that are counted, and the sketches' size: 2**12 registers, a standard error of 1.6 in a hundred.
COUNTED = {"customers": "customer_id", "orders": "order_id", "products": "product_id"}
REGISTER_BITS = 12
#: Relative error that a sketch of this size exceeds about once in 10,000 times: four standard errors.
ERROR_BOUND = 4 * 1.04 / 2 ** (REGISTER_BITS / 2)


def daily_sketches(orders: DataFrame) -> DataFrame:
    """``day, storeid`` with one sketch per counted column. Lines without a date form a day of their own."""
    sketches = [F.hll_sketch_agg(c, F.lit(REGISTER_BITS)).alias(name) for name, c in COUNTED.items()]
    day = F.col("correct_date").cast("date")
    return orders.groupBy(day.alias("day"), F.col("delivered_storeid").alias("storeid")).agg(*sketches)


def rolled_up(sketches: DataFrame, *groups: Column) -> DataFrame:
    """Estimated distinct counts of any groups of days and stores, from the sketches alone. A day without values counts nothing."""
    counts = [F.hll_sketch_estimate(F.hll_union_agg(name)).alias(name) for name in COUNTED]
    return sketches.groupBy(*groups).agg(*counts)


def distinct_counts_by_month(orders: DataFrame, sketches: DataFrame | None = None) -> DataFrame:
    """Per month the exact distinct counts and whether those rolled up from daily sketches are within the error bound."""
    daily = daily_sketches(orders) if sketches is None else sketches
    month = month_of("day").alias("Month")
    rolled = rolled_up(daily, month).withColumnsRenamed({name: f"{name}_about" for name in COUNTED})
    exact = orders.groupBy(month_of("correct_date").alias("_month")).agg(
        *[F.countDistinct(c).alias(name) for name, c in COUNTED.items()]
    )
    close = [
        (F.abs(F.col(f"{name}_about") - F.col(name)) <= ERROR_BOUND * F.col(name) + 1).alias(f"{name}_close") for name in COUNTED
    ]
    return exact.join(rolled, F.col("_month").eqNullSafe(F.col("Month"))).select("Month", *COUNTED, *close)
