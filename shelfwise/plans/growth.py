"""Customer growth, retention and cohorts.

All of these reduce lines to (customer, month) first; a window per customer then sees at most one row per month.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.columns import month_index, month_of, number, percent2, ratio2

def new_customers_by_month(orders: DataFrame) -> DataFrame:
    """Customers by the month of their first dated line."""
    firsts = orders.filter(F.col("correct_date").isNotNull()).groupBy("customer_id").agg(F.min("correct_date").alias("first"))
    return firsts.groupBy(month_of("first").alias("YearMonth")).agg(F.count("customer_id").alias("New_Customers"))


def monthly_retention(orders: DataFrame) -> DataFrame:
    """Customers per month and how many of them also bought in the following month.

    ``lead`` over a customer's months replaces a self-join on customer and month + 1. Lines without a date form a row of
    their own with nobody retained.
    """
    stamp = F.col("correct_date")
    visits = orders.select("customer_id", F.trunc(stamp, "month").alias("month")).distinct()
    following = F.lead("month").over(Window.partitionBy("customer_id").orderBy("month"))
    stays = F.col("customer_id").isNotNull() & (following == F.add_months("month", 1))
    counted = (
        visits.withColumn("stays", stays)
        .groupBy(F.date_format("month", "yyyy-MM").alias("Current_Month"))
        .agg(F.count("customer_id").alias("Customers_Current"), F.count_if("stays").alias("Retained_Customers"))
    )
    return counted.withColumn(
        "Retention_Rate_Percent", percent2(F.col("Retained_Customers"), F.col("Customers_Current"))
    )


def new_vs_existing_revenue(orders: DataFrame) -> DataFrame:
    """Raw revenue per month, split by whether the month is the customer's first. Undated lines count as existing."""
    spent = (
        orders.filter(F.col("customer_id").isNotNull())
        .groupBy("customer_id", month_of("correct_date").alias("Month"))
        .agg(F.sum("total_amount").alias("revenue"))
    )
    first = F.min("Month").over(Window.partitionBy("customer_id"))
    kind = F.when(F.col("Month") == first, "New Customer").otherwise("Existing Customer")
    return (
        spent.withColumn("Customer_Type", kind)
        .groupBy("Month", "Customer_Type")
        .agg(number(F.sum("revenue")).alias("Total_Revenue"))
    )


def cohorts(orders: DataFrame, integer_averages: bool = False) -> DataFrame:
    """Customers grouped by first month: size, how many came back in a later month, when, and with what revenue.

    Sums over no rows are NULL (a cohort nobody returned from), as in the source. The mean months to repeat is over
    (customer, later month) pairs. Lines shrink to one row per customer and month in two steps, as orders are counted once;
    one more exchange by customer then serves the window and the per-customer sums, and one gathers the cohorts.
    """
    stamp = F.col("correct_date")
    monthly = (
        orders.filter(F.col("customer_id").isNotNull())
        .groupBy("customer_id", month_of(stamp).alias("month"), month_index(stamp).alias("index"))
        .agg(F.sum("new_total_amount").alias("revenue"), F.countDistinct("order_id").alias("orders"))
    )
    placed = monthly.select(
        "customer_id",
        "revenue",
        "orders",
        F.min("month").over(Window.partitionBy("customer_id")).alias("Cohort_Month"),
        (F.col("index") - F.min("index").over(Window.partitionBy("customer_id"))).alias("offset"),
    )
    later, start = F.col("offset") > 0, F.col("offset") == 0
    per_customer = placed.groupBy("customer_id", "Cohort_Month").agg(
        F.count_if(later).alias("later_months"),
        F.sum(F.when(later, F.col("offset"))).alias("later_offsets"),
        F.sum(F.when(start, F.col("orders"))).alias("first_orders"),
        F.sum(F.when(start, F.col("revenue"))).alias("first_revenue"),
        F.sum(F.when(later, F.col("orders"))).alias("later_orders"),
        F.sum(F.when(later, F.col("revenue"))).alias("later_revenue"),
    )
    repeat = F.count_if(F.col("later_months") > 0)
    return per_customer.groupBy("Cohort_Month").agg(
        F.count("*").alias("Cohort_Customers"),
        repeat.alias("Repeat_Customers"),
        percent2(repeat, F.count("*")).alias("Retention_Rate"),
        ratio2(F.sum("later_offsets"), F.sum("later_months"), integer_averages).alias("Avg_Months_to_Repeat"),
        F.sum("first_orders").alias("Total_Orders_Cohort_Customers"),
        number(F.sum("first_revenue")).alias("Total_Revenue_Cohort_Customers"),
        F.sum("later_orders").alias("Total_Orders_Repeat_Customers"),
        number(F.sum("later_revenue")).alias("Total_Revenue_Repeat_Customers"),
    )
