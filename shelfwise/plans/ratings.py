"""Customer satisfaction by month, category, customer state and store.

The source joins lines to reviews, so a review weighs as often as its order has lines. Reviews are reduced to sums per
order and lines to counts per (order, dimension); their product gives the same figures without repeating rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.columns import month_of, ratio2

# The output name per dimension.
DIMENSIONS = {"month": "Month_Year", "category": "Category", "state": "Customer_State", "store": "Store_ID"}


def _scores(reviews: DataFrame) -> DataFrame:
    score = F.col("customer_satisfaction_score")
    return (
        reviews.filter(score.isNotNull())
        .groupBy("order_id")
        .agg(F.count("*").alias("n"), F.sum(score).alias("s"), F.min(score).alias("low"), F.max(score).alias("high"))
    )


def _rated_lines(orders: DataFrame, reviews: DataFrame, by: str, products: DataFrame | None, customers: DataFrame | None):
    """Line counts per (order, dimension) next to the order's review sums. Unknown categories and states drop out."""
    name = DIMENSIONS[by]
    if by == "category":
        lines = orders.select("order_id", "product_id").join(products, "product_id")
        dimension: Column = F.col("category")
    elif by == "state":
        per_order = orders.groupBy("order_id", "customer_id").agg(F.count("*").alias("lines"))
        states = customers.select("custid", F.col("customer_state").alias(name))
        lines = per_order.join(states, F.col("customer_id") == F.col("custid")).select("order_id", name, "lines")
        return name, lines.join(_scores(reviews), "order_id")
    else:
        lines = orders
        dimension = month_of("correct_date") if by == "month" else F.col("delivered_storeid")
    counted = lines.groupBy("order_id", dimension.alias(name)).agg(F.count("*").alias("lines"))
    return name, counted.join(_scores(reviews), "order_id")


def average_rating(
    orders: DataFrame,
    reviews: DataFrame,
    by: str,
    products: DataFrame | None = None,
    customers: DataFrame | None = None,
    integer_averages: bool = False,
) -> DataFrame:
    """Mean score and number of reviews by ``month``, ``category`` (needs products), ``state`` (customers) or ``store``."""
    name, rated = _rated_lines(orders, reviews, by, products, customers)
    total, count = F.sum(F.col("lines") * F.col("s")), F.sum(F.col("lines") * F.col("n"))
    return rated.groupBy(name).agg(
        ratio2(total, count, integer_averages).alias("Avg_Rating"), count.alias("Total_Reviews")
    )


def rating_extremes(
    orders: DataFrame, reviews: DataFrame, by: str, products: DataFrame | None = None, customers: DataFrame | None = None
) -> DataFrame:
    """Highest, lowest and mean score and review count by the same dimensions (announced by a heading of the source)."""
    name, rated = _rated_lines(orders, reviews, by, products, customers)
    total, count = F.sum(F.col("lines") * F.col("s")), F.sum(F.col("lines") * F.col("n"))
    return rated.groupBy(name).agg(
        F.max("high").alias("max_rating"),
        F.min("low").alias("min_rating"),
        ratio2(total, count).alias("avg_rating"),
        count.alias("reviews"),
    )
