"""One-number KPIs, each as a 1-row query, and ``kpi_summary`` with all of them side by side.

Distinct counts are taken on pre-grouped keys, so a customer or order with very many lines is collapsed on the map side.
``integer_averages`` reproduces the truncated averages a system with integer AVG would return.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.columns import line_cost, line_profit, number, percent2, ratio2
from shelfwise.tables import RetailTables

def _sales() -> Column:
    return F.sum("new_total_amount")


def _money(total: Column) -> Column:
    return number(F.round(total, 2))


def _count(column: str) -> Column:
    return F.countDistinct(column)


def _per_customer(orders: DataFrame) -> DataFrame:
    return orders.groupBy("customer_id").agg(_count("order_id").alias("orders"))


def _share_of_customers(orders: DataFrame, condition: str, name: str) -> DataFrame:
    return _per_customer(orders).agg(percent2(F.count_if(F.expr(condition)), F.count("*")).alias(name))


def categories_per_order(tables: RetailTables) -> DataFrame:
    """(order_id, categories): distinct categories among the order's known products."""
    return (
        tables.orders.select("order_id", "product_id")
        .join(tables.products, "product_id")
        .groupBy("order_id")
        .agg(_count("category").alias("categories"))
    )


def _sold_categories(tables: RetailTables) -> DataFrame:
    return tables.orders.select("product_id").distinct().join(tables.products, "product_id")


def transaction_gaps(orders: DataFrame) -> DataFrame:
    """Per customer: number of gaps between consecutive dated lines, and their calendar days in total.

    Consecutive differences telescope, so the days are last minus first date and no per-customer sort is needed.
    """
    return orders.groupBy("customer_id").agg(*_gaps())


def _gaps() -> list[Column]:
    stamp = F.col("correct_date")
    return [
        F.greatest(F.count(stamp) - 1, F.lit(0)).alias("gaps"),
        F.coalesce(F.date_diff(F.max(stamp).cast("date"), F.min(stamp).cast("date")), F.lit(0)).alias("days"),
    ]


def _lines(build: Callable[[], Column], name: str) -> Callable[[RetailTables, bool], DataFrame]:
    return lambda tables, truncate: tables.orders.agg(build().alias(name))


def _distinct(table: str, column: str, name: str) -> Callable[[RetailTables, bool], DataFrame]:
    return lambda tables, truncate: getattr(tables, table).agg(_count(column).alias(name))


def _distinct_text(table: str, column: str, name: str) -> Callable[[RetailTables, bool], DataFrame]:
    return lambda tables, truncate: getattr(tables, table).agg(F.countDistinct(F.lower(column)).alias(name))


KPIS: dict[str, Callable[[RetailTables, bool], DataFrame]] = {
    "Total_Orders": _distinct("orders", "order_id", "Total_Orders"),
    "Total_Discount": _lines(lambda: _money(F.sum("discount")), "Total_Discount"),
    "Average_Discount_Per_Customer": _lines(
        lambda: ratio2(F.sum("discount"), _count("customer_id")), "Average_Discount_Per_Customer"
    ),
    # Named "per order" in the source, but it is the mean over lines.
    "Average_Discount_Per_Order": _lines(
        lambda: ratio2(F.sum("discount"), F.count("discount")), "Average_Discount_Per_Order"
    ),
    "Average_Order_Value": _lines(lambda: ratio2(_sales(), _count("order_id")), "Average_Order_Value"),
    "Average_Sales_Per_Customer": _lines(lambda: ratio2(_sales(), _count("customer_id")), "Average_Sales_Per_Customer"),
    "Average_Profit_Per_Customer": _lines(
        lambda: ratio2(F.sum(line_profit()), _count("customer_id")), "Average_Profit_Per_Customer"
    ),
    "Avg_Categories_Per_Order": lambda tables, truncate: categories_per_order(tables).agg(
        ratio2(F.sum("categories"), F.count("*"), truncate).alias("Avg_Categories_Per_Order")
    ),
    "Avg_Items_Per_Order": lambda tables, truncate: tables.orders.groupBy("order_id")
    .agg(F.sum("quantity").alias("items"))
    .agg(ratio2(F.sum("items"), F.count("items"), truncate).alias("Avg_Items_Per_Order")),
    "Total_Customers": _distinct("orders", "customer_id", "Total_Customers"),
    "Transactions_Per_Customer": lambda tables, truncate: _per_customer(tables.orders).agg(
        ratio2(F.sum("orders"), F.count("*"), truncate).alias("Transactions_Per_Customer")
    ),
    "Total_Revenue": _lines(lambda: _money(_sales()), "Total_Revenue"),
    "Total_Profit": _lines(lambda: _money(F.sum(line_profit())), "Total_Profit"),
    "Total_Cost": _lines(lambda: _money(F.sum(line_cost())), "Total_Cost"),
    "Total_Quantity": _lines(lambda: F.sum("quantity"), "Total_Quantity"),
    "Total_Products": _distinct("orders", "product_id", "Total_Products"),
    "Total_Categories": lambda tables, truncate: _sold_categories(tables).agg(
        _count("category").alias("Total_Categories")
    ),
    "Total_Stores": _distinct("orders", "delivered_storeid", "Total_Stores"),
    "Total_Locations": _distinct("stores", "seller_city", "Total_Locations"),
    "Total_Regions": _distinct("stores", "seller_state", "Total_Regions"),  # counts states, named regions
    "Total_Channels": _distinct_text("orders", "channel", "Total_Channels"),
    "Total_Payment_Methods": _distinct_text("payments", "payment_type", "Total_Payment_Methods"),
    "Avg_Days_Between_Transactions": lambda tables, truncate: transaction_gaps(tables.orders).agg(
        ratio2(F.sum("days"), F.sum("gaps")).alias("Avg_Days_Between_Transactions")
    ),
    "Profit_Percentage": _lines(lambda: percent2(F.sum(line_profit()), _sales()), "Profit_Percentage"),
    "Discount_Percentage": _lines(lambda: percent2(F.sum("discount"), _sales()), "Discount_Percentage"),
    "Repeat_Purchase_Rate": lambda tables, truncate: _share_of_customers(
        tables.orders, "orders > 1", "Repeat_Purchase_Rate"
    ),
    "Repeat_Customer_Percentage": lambda tables, truncate: _share_of_customers(
        tables.orders, "orders > 1", "Repeat_Customer_Percentage"
    ),
    "One_Time_Buyers_Percentage": lambda tables, truncate: _share_of_customers(
        tables.orders, "orders = 1", "One_Time_Buyers_Percentage"
    ),
}


def kpi(name: str, tables: RetailTables, integer_averages: bool = False) -> DataFrame:
    """One KPI as a 1-row, 1-column DataFrame."""
    return KPIS[name](tables, integer_averages)


def kpi_summary(tables: RetailTables, integer_averages: bool = False) -> DataFrame:
    """All KPIs in one row.

    Three passes over the lines, by customer, by order and by what is sold where, each ending in one struct that the KPIs
    are computed from; every pass reads only its own columns.
    """
    sums = {
        "sales": _sales(),
        "discount": F.sum("discount"),
        "discounts": F.count("discount"),
        "quantity": F.sum("quantity"),
        "cost": F.sum(line_cost()),
        "profit": F.sum(line_profit()),
    }
    per_customer = tables.orders.groupBy("customer_id").agg(
        _count("order_id").alias("orders"), *_gaps(), *[column.alias(name) for name, column in sums.items()]
    )
    customers = per_customer.agg(
        F.struct(
            F.count("customer_id").alias("known"),
            F.count("*").alias("all"),
            F.sum("orders").alias("orders"),
            F.count_if(F.col("orders") > 1).alias("repeat"),
            F.count_if(F.col("orders") == 1).alias("single"),
            *[F.sum(c).alias(c) for c in ("gaps", "days", *sums)],
        )
    ).scalar()
    per_order = (
        tables.orders.groupBy("order_id", "product_id")
        .agg(F.sum("quantity").alias("quantity"))
        .join(tables.products.select(F.col("product_id").alias("_product"), "category"), F.col("product_id") == F.col("_product"), "left")
        .groupBy("order_id")
        .agg(F.sum("quantity").alias("items"), F.count("_product").alias("found"), _count("category").alias("categories"))
    )
    orders = per_order.agg(
        F.struct(
            F.count("order_id").alias("orders"),
            F.sum("items").alias("items"),
            F.count("items").alias("counted"),
            F.sum("categories").alias("categories"),
            F.count_if(F.col("found") > 0).alias("baskets"),
        )
    ).scalar()
    sold = (
        tables.orders.select("product_id", "delivered_storeid", F.lower("channel").alias("channel"))
        .distinct()
        .join(tables.products.select(F.col("product_id").alias("_product"), "category"), F.col("product_id") == F.col("_product"), "left")
        .agg(F.struct(*[_count(c).alias(c) for c in ("product_id", "delivered_storeid", "channel", "category")]))
        .scalar()
    )
    places = tables.stores.agg(
        F.struct(_count("seller_city").alias("cities"), _count("seller_state").alias("states"))
    ).scalar()

    def alone(name: str) -> Column:
        return kpi(name, tables).scalar()

    values = {
        "Total_Orders": orders["orders"],
        "Total_Discount": _money(customers["discount"]),
        "Average_Discount_Per_Customer": ratio2(customers["discount"], customers["known"]),
        "Average_Discount_Per_Order": ratio2(customers["discount"], customers["discounts"]),
        "Average_Order_Value": ratio2(customers["sales"], orders["orders"]),
        "Average_Sales_Per_Customer": ratio2(customers["sales"], customers["known"]),
        "Average_Profit_Per_Customer": ratio2(customers["profit"], customers["known"]),
        "Avg_Categories_Per_Order": ratio2(orders["categories"], orders["baskets"], integer_averages),
        "Avg_Items_Per_Order": ratio2(orders["items"], orders["counted"], integer_averages),
        "Total_Customers": customers["known"],
        "Transactions_Per_Customer": ratio2(customers["orders"], customers["all"], integer_averages),
        "Total_Revenue": _money(customers["sales"]),
        "Total_Profit": _money(customers["profit"]),
        "Total_Cost": _money(customers["cost"]),
        "Total_Quantity": customers["quantity"],
        "Total_Products": sold["product_id"],
        "Total_Categories": sold["category"],
        "Total_Stores": sold["delivered_storeid"],
        "Total_Locations": places["cities"],
        "Total_Regions": places["states"],
        "Total_Channels": sold["channel"],
        "Total_Payment_Methods": alone("Total_Payment_Methods"),
        "Avg_Days_Between_Transactions": ratio2(customers["days"], customers["gaps"]),
        "Profit_Percentage": percent2(customers["profit"], customers["sales"]),
        "Discount_Percentage": percent2(customers["discount"], customers["sales"]),
        "Repeat_Purchase_Rate": percent2(customers["repeat"], customers["all"]),
        "Repeat_Customer_Percentage": percent2(customers["repeat"], customers["all"]),
        "One_Time_Buyers_Percentage": percent2(customers["single"], customers["all"]),
    }
    spark = tables.orders.sparkSession
    return spark.range(1).select(*[value.alias(name) for name, value in values.items()])
