"""Category behaviour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.columns import line_profit, month_of, number, percent2, ratio2


def _category_sums(orders: DataFrame, products: DataFrame, measure) -> DataFrame:
    """``measure`` per category of known products: summed per product first, so the join sees one row per product."""
    per_product = orders.groupBy("product_id").agg(F.sum(measure).alias("total"))
    return per_product.join(products, "product_id").groupBy("category").agg(F.sum("total").alias("total"))


def category_sales(orders: DataFrame, products: DataFrame) -> DataFrame:
    """Sales per category; the share is of all sales, those of unknown products included."""
    overall = orders.agg(F.sum("new_total_amount")).scalar()
    return _category_sums(orders, products, F.col("new_total_amount")).select(
        F.col("category").alias("Category"),
        number(F.col("total")).alias("Total_Sales"),
        percent2(F.col("total"), overall).alias("Percentage_of_Sales"),
    )


def category_profit(orders: DataFrame, products: DataFrame) -> DataFrame:
    """Profit per category and its share of the profit of known products."""
    sums = _category_sums(orders, products, line_profit())
    overall = sums.agg(F.sum("total")).scalar()
    return sums.select(
        F.col("category").alias("Category"),
        number(F.col("total")).alias("Total_Profit"),
        percent2(F.col("total"), overall).alias("Profit_Contribution_Percentage"),
    )


def category_penetration(orders: DataFrame, products: DataFrame) -> DataFrame:
    """Share of a month's orders that contain the category. Lines without a date are left out, as in the source."""
    dated = orders.filter(F.col("correct_date").isNotNull()).select(
        month_of("correct_date").alias("Month"), "order_id", "product_id"
    )
    monthly = dated.groupBy("Month").agg(F.countDistinct("order_id").alias("Total_Orders"))
    by_category = (
        dated.join(products, "product_id")
        .groupBy("Month", F.col("category").alias("Category"))
        .agg(F.countDistinct("order_id").alias("Category_Order_Count"))
    )
    return by_category.join(monthly, "Month").withColumn(
        "Category_Penetration_Percentage", percent2(F.col("Category_Order_Count"), F.col("Total_Orders"))
    )


# The output name per dimension.
PLACE_NAMES = {"seller_state": "Seller_State", "region": "Seller_Region"}


def categories_per_bill(
    orders: DataFrame, products: DataFrame, stores: DataFrame, dim: str, integer_averages: bool = False
) -> DataFrame:
    """Average number of categories per order by month and the store's state or region.

    The source joins the per-order count back to lines, so the mean is weighted by lines; that is kept. Lines are
    counted per (order, month, store) before the join and weigh the count there.
    """
    per_order = (
        orders.select("order_id", "product_id")
        .join(products, "product_id")
        .groupBy("order_id")
        .agg(F.countDistinct("category").alias("categories"))
    )
    lines = orders.groupBy(
        "order_id", month_of("correct_date").alias("Month_Year"), F.col("delivered_storeid").alias("storeid")
    ).agg(F.count("*").alias("lines"))
    by_store = (
        lines.join(per_order, "order_id")
        .groupBy("Month_Year", "storeid")
        .agg(F.sum(F.col("lines") * F.col("categories")).alias("weighted"), F.sum("lines").alias("lines"))
    )
    return (
        by_store.join(stores.select("storeid", dim), "storeid")
        .groupBy("Month_Year", F.col(dim).alias(PLACE_NAMES[dim]))
        .agg(ratio2(F.sum("weighted"), F.sum("lines"), integer_averages).alias("Avg_Categories_Per_Order"))
    )


def first_purchase_categories(orders: DataFrame, products: DataFrame) -> DataFrame:
    """Categories in the lines that carry a customer's very first timestamp."""
    firsts = orders.groupBy(F.col("customer_id").alias("buyer")).agg(F.min("correct_date").alias("first"))
    matches = (F.col("customer_id") == F.col("buyer")) & (F.col("correct_date") == F.col("first"))
    return (
        orders.select("customer_id", "order_id", "product_id", "correct_date")
        .join(firsts, matches)
        .join(products, "product_id")
        .groupBy(F.col("category").alias("Category"))
        .agg(
            F.countDistinct("customer_id").alias("No_Of_Customers"), F.countDistinct("order_id").alias("No_Of_Orders")
        )
    )
