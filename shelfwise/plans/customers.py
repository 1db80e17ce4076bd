"""Customer behaviour: value bands, RFM, channels, buyer types, preferences, demographics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.columns import is_weekend, line_profit, number, percent2, ratio2
from shelfwise.operators.grouping import mode_per_key
from shelfwise.operators.ranking import add_ntiles
from shelfwise.sources.storage import write_once

# Revenue bands and RFM score bands.
HIGH_REVENUE, MEDIUM_REVENUE = 6000, (3000, 5999)
RFM_BUCKETS = 4
RFM_BANDS = {"Premium": (10, 12), "Gold": (7, 9), "Silver": (4, 6)}


def _raw_sales() -> Column:
    return F.sum("total_amount")


def revenue_bands(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Customers by raw revenue band. As in the source, revenue strictly between 5999 and 6000 is Low Value."""
    revenue = F.col("Total_Revenue")
    band = (
        F.when(revenue >= HIGH_REVENUE, "High Value")
        .when(revenue.between(*MEDIUM_REVENUE), "Medium Value")
        .otherwise("Low Value")
    )
    spent = orders.groupBy("customer_id").agg(_raw_sales().alias("Total_Revenue"))
    return spent.join(customers, F.col("customer_id") == F.col("custid"), "left").select(
        F.col("custid").alias("Custid"),
        F.col("customer_city").alias("Customer_City"),
        F.col("customer_state").alias("Customer_State"),
        number(revenue).alias("Total_Revenue"),
        band.alias("Customer_Segment"),
    )


def _rfm(orders: DataFrame, best_is_high: bool) -> DataFrame:
    latest = orders.agg(F.max("correct_date")).scalar()
    per_customer = orders.groupBy("customer_id").agg(
        F.date_diff(latest.cast("date"), F.max("correct_date").cast("date")).alias("recency"),
        F.countDistinct("order_id").alias("frequency"),
        _raw_sales().alias("monetary"),
    )
    scored = add_ntiles(
        write_once(per_customer, "rfm"),
        "customer_id",
        RFM_BUCKETS,
        r=("recency", False),
        f=("frequency", True),
        m=("monetary", True),
    )
    score = F.col("r") + F.col("f") + F.col("m")
    if best_is_high:
        score = F.lit(3 * (RFM_BUCKETS + 1)) - score
    segment = F.lit("Standard")
    for name, (low, high) in RFM_BANDS.items():
        segment = F.when(F.col("RFM_Score").between(low, high), name).otherwise(segment)
    return scored.withColumn("RFM_Score", score).withColumn("Customer_Segment", segment)


def rfm_segments(orders: DataFrame, best_is_high: bool = False) -> DataFrame:
    """Recency, frequency and monetary quartiles summed to a score of 3-12, and a segment per score band.

    In the source quartile 1 is the best, yet high scores get the best segment names; the default keeps that.
    ``best_is_high`` turns the quartiles around so that Premium really means recent, frequent and high-spending.
    """
    return _rfm(orders, best_is_high).select(
        F.col("customer_id").alias("Customer_ID"),
        F.col("recency").alias("Recency"),
        F.col("frequency").alias("Frequency"),
        number(F.col("monetary")).alias("Monetary"),
        "RFM_Score",
        "Customer_Segment",
    )


def rfm_contribution(orders: DataFrame, best_is_high: bool = False) -> DataFrame:
    """README-derived: customers, raw sales and share of sales per RFM segment."""
    total = orders.agg(F.sum("total_amount")).scalar()
    segments = (
        _rfm(orders, best_is_high)
        .groupBy("Customer_Segment")
        .agg(F.count("*").alias("customers"), F.sum("monetary").alias("s"))
    )
    return segments.select(
        "Customer_Segment", "customers", number(F.col("s")).alias("sales"), percent2(F.col("s"), total).alias("sales_pct")
    )


def all_channel_customers(orders: DataFrame) -> DataFrame:
    """Customers seen in every channel, with key figures (``avg_order_value`` is a mean over lines in the source).

    Channels are counted on distinct (customer, channel) pairs, figures on (customer, order) sums; both end up hashed by
    customer, so the semi-join between them moves nothing.
    """
    every = orders.agg(F.countDistinct(F.lower("channel"))).scalar()
    known = orders.filter(F.col("customer_id").isNotNull())
    everywhere = (
        known.select("customer_id", F.lower("channel").alias("channel"))
        .distinct()
        .groupBy("customer_id")
        .agg(F.count("channel").alias("channels"))
        .filter(F.col("channels") == every)
    )
    per_order = known.groupBy("customer_id", "order_id").agg(
        F.sum("quantity").alias("quantity"),
        _raw_sales().alias("sales"),
        F.count("total_amount").alias("lines"),
        F.min("correct_date").alias("first"),
        F.max("correct_date").alias("last"),
    )
    return (
        per_order.groupBy("customer_id")
        .agg(
            F.count("order_id").alias("total_orders"),
            F.sum("quantity").alias("total_quantity"),
            number(F.sum("sales")).alias("total_sales"),
            ratio2(F.sum("sales"), F.sum("lines")).alias("avg_order_value"),
            F.min("first").alias("first_purchase_date"),
            F.max("last").alias("last_purchase_date"),
        )
        .join(everywhere, "customer_id", "left_semi")
    )


def _customer_totals(orders: DataFrame, *extra: Column) -> DataFrame:
    return orders.groupBy("customer_id").agg(
        F.countDistinct("order_id").alias("orders"),
        _raw_sales().alias("sales"),
        F.sum("quantity").alias("quantity"),
        *extra,
    )


def buyer_types(orders: DataFrame, integer_averages: bool = False) -> DataFrame:
    """One-time against repeat buyers. ``avg_order_value`` is a mean of each customer's mean line amount."""
    # The means are rounded to decimals before they are summed: the sum does not depend on the order of its inputs.
    mean_line = (F.sum("total_amount").cast("double") / F.count("total_amount")).cast("decimal(28,6)")
    kind = F.when(F.col("orders") == 1, "One-time Buyer").otherwise("Repeat Buyer")
    total = F.sum("_sales").over(Window.partitionBy())  # of the two rows
    return (
        _customer_totals(orders, mean_line.alias("mean_line"))
        .groupBy(kind.alias("buyer_type"))
        .agg(
            F.sum("sales").alias("_sales"),
            F.count("customer_id").alias("num_customers"),
            F.sum("orders").alias("total_orders"),
            F.sum("quantity").alias("total_quantity"),
            number(F.sum("sales")).alias("total_sales"),
            ratio2(F.sum("sales"), F.count("sales")).alias("avg_sales_per_customer"),
            ratio2(F.sum("mean_line"), F.count("mean_line")).alias("avg_order_value"),
            ratio2(F.sum("orders"), F.count("*"), integer_averages).alias("avg_orders_per_customer"),
        )
        .withColumn("contribution_to_total_sales_percent", percent2(F.col("_sales"), total))
        .drop("_sales")
    )


def discount_seekers(orders: DataFrame) -> DataFrame:
    """Customers who ever got a discount against the others. The discount share counts positive totals only."""
    kind = F.when(F.col("discount") > 0, "Discount Seeker").otherwise("Non-Discount Seeker")
    both = Window.partitionBy()  # the two rows
    seekers = F.sum(F.when(F.col("customer_type") == "Discount Seeker", F.col("_discount"))).over(both)
    return (
        _customer_totals(orders, F.sum("discount").alias("discount"))
        .groupBy(kind.alias("customer_type"))
        .agg(
            F.sum("sales").alias("_sales"),
            F.sum("discount").alias("_discount"),
            F.count("customer_id").alias("num_customers"),
            F.sum("orders").alias("total_orders"),
            F.sum("quantity").alias("total_quantity"),
            number(F.sum("sales")).alias("total_sales"),
            number(F.sum("discount")).alias("total_discount_given"),
            ratio2(F.sum("sales"), F.count("sales")).alias("avg_sales_per_customer"),
            ratio2(F.sum("discount"), F.count("discount")).alias("avg_discount_per_customer"),
        )
        .withColumn("contribution_to_total_sales_percent", percent2(F.col("_sales"), F.sum("_sales").over(both)))
        .withColumn("share_of_total_discount_percent", percent2(F.col("_discount"), seekers))
        .drop("_sales", "_discount")
    )


def customer_preferences(orders: DataFrame, payments: DataFrame, products: DataFrame) -> DataFrame:
    """Most frequent channel, payment type, store and category per customer, and the discount habit.

    Frequencies count lines; for payments, lines times payment rows of the order. Channels and payment types are spelled
    in any case. Ties go to the smallest value.
    """
    lines = orders.groupBy("customer_id", "order_id").agg(F.count("*").alias("lines"))
    paid = payments.groupBy("order_id", "payment_type").agg(F.count("*").alias("rows"))
    by_payment = (
        lines.join(paid, "order_id")
        .groupBy("customer_id", F.lower("payment_type").alias("_kind"))
        .agg(F.sum(F.col("lines") * F.col("rows")).alias("n"), F.min("payment_type").alias("payment_type"))
    )
    habit = F.when(F.sum("discount") > 0, "Discount Lover").otherwise("Non-Discount Buyer")
    habits = orders.groupBy("customer_id").agg(
        ratio2(F.sum("discount"), F.count("discount")).alias("avg_discount_used"), habit.alias("discount_preference")
    )
    result = (
        habits.join(_usual_choices(orders, products), "customer_id", "left")
        .join(mode_per_key(by_payment, "customer_id", "payment_type", "n", "preferred_payment_method"), "customer_id", "left")
    )
    known = F.col("customer_id").isNotNull()  # a missing customer never matches in the source's joins
    return result.select(
        "customer_id",
        "preferred_channel",
        "preferred_payment_method",
        "preferred_store",
        "preferred_category",
        *[F.when(known, F.col(c)).alias(c) for c in ("avg_discount_used", "discount_preference")],
    )


def _usual_choices(orders: DataFrame, products: DataFrame) -> DataFrame:
    """Most frequent channel, store and category per customer from one pass over the lines.

    Lines are counted per combination first; each count then stands for its channel, its store and its category.
    """
    named = products.select(F.col("product_id").alias("_product"), "category")
    counts = (
        orders.groupBy("customer_id", "channel", "delivered_storeid", "product_id")
        .agg(F.count("*").alias("n"))
        .join(named, F.col("product_id") == F.col("_product"), "left")
    )
    none = F.lit(None)

    def entry(what: str, group: Column, text: Column, number_: Column) -> Column:
        return F.struct(
            F.lit(what).alias("what"),
            group.cast("string").alias("group"),
            text.cast("string").alias("text"),
            number_.cast("bigint").alias("id"),
        )

    entries = [
        entry("channel", F.lower("channel"), F.col("channel"), none),
        entry("store", F.col("delivered_storeid"), none, F.col("delivered_storeid")),
        entry("category", F.col("category"), F.col("category"), none),
    ]
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("id"), F.col("text")))
    chosen = (
        counts.withColumn("e", F.explode(F.array(*entries)))
        .filter("e.what <> 'category' or _product is not null")
        .groupBy("customer_id", "e.what", "e.group")
        .agg(F.sum("n").alias("n"), F.min("e.text").alias("text"), F.min("e.id").alias("id"))
        .groupBy("customer_id", "what")
        .agg(best.alias("best"))
    )
    pick = lambda what, field: F.max(F.when(F.col("what") == what, F.col("best")[field]))
    return chosen.groupBy("customer_id").agg(
        pick("channel", "text").alias("preferred_channel"),
        pick("store", "id").alias("preferred_store"),
        pick("category", "text").alias("preferred_category"),
    )


def category_breadth(orders: DataFrame, products: DataFrame, integer_averages: bool = False) -> DataFrame:
    """Customers who bought from one category against several (no known category counts as several, as in the source)."""
    lines = orders.join(products, "product_id")
    per_order = lines.groupBy("customer_id", "order_id", "category").agg(
        _raw_sales().alias("sales"), F.sum("quantity").alias("quantity")
    )
    per_customer = per_order.groupBy("customer_id").agg(
        F.countDistinct("category").alias("categories"),
        F.countDistinct("order_id").alias("orders"),
        F.sum("sales").alias("sales"),
        F.sum("quantity").alias("quantity"),
    )
    kind = F.when(F.col("categories") == 1, "Single Category Buyers").otherwise("Multi Category Buyers")
    return per_customer.groupBy(kind.alias("Customer_Type")).agg(
        F.count("customer_id").alias("Customer_Count"),
        number(F.sum("sales")).alias("Total_Revenue"),
        F.sum("orders").alias("Total_Orders"),
        F.sum("quantity").alias("Total_Quantity"),
        ratio2(F.sum("sales"), F.count("sales")).alias("Avg_Revenue_per_Customer"),
        ratio2(F.sum("orders"), F.count("*"), integer_averages).alias("Avg_Orders_per_Customer"),
    )


def gender_patterns(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """README-derived: customers, orders, quantity, revenue, profit, order value and revenue share per gender.

    Lines of unknown customers form a NULL gender. Lines are summed per (customer, order) before the join.
    """
    total = orders.agg(F.sum("new_total_amount")).scalar()
    per_order = orders.groupBy("customer_id", "order_id").agg(
        F.sum("quantity").alias("quantity"),
        F.sum("new_total_amount").alias("revenue"),
        F.sum(line_profit()).alias("profit"),
    )
    return (
        per_order.join(customers, F.col("customer_id") == F.col("custid"), "left")
        .groupBy("gender")
        .agg(
            F.countDistinct("customer_id").alias("customers"),
            F.countDistinct("order_id").alias("orders"),
            F.sum("quantity").alias("quantity"),
            F.sum("revenue").alias("r"),
            F.sum("profit").alias("p"),
        )
        .select(
            "gender",
            "customers",
            "orders",
            "quantity",
            number(F.col("r")).alias("revenue"),
            number(F.col("p")).alias("profit"),
            ratio2(F.col("r"), F.col("orders")).alias("avg_order_value"),
            percent2(F.col("r"), total).alias("revenue_pct"),
        )
    )


def weekday_weekend_customers(orders: DataFrame) -> DataFrame:
    """README-derived: orders and spend per customer on weekdays and weekends, and the day type with more orders.

    An order's day is its latest timestamp; undated orders count as weekday; equal counts give 'Even'.
    """
    per_order = orders.groupBy("customer_id", "order_id").agg(
        F.max("correct_date").alias("ts"), F.sum("new_total_amount").alias("spend")
    )
    weekend = is_weekend("ts")
    counted = per_order.groupBy("customer_id").agg(
        F.count_if(~weekend).alias("weekday_orders"),
        F.count_if(weekend).alias("weekend_orders"),
        number(F.sum(F.when(~weekend, F.col("spend")).otherwise(0))).alias("weekday_spend"),
        number(F.sum(F.when(weekend, F.col("spend")).otherwise(0))).alias("weekend_spend"),
    )
    dominant = (
        F.when(F.col("weekday_orders") > F.col("weekend_orders"), "Weekday")
        .when(F.col("weekday_orders") < F.col("weekend_orders"), "Weekend")
        .otherwise("Even")
    )
    return counted.withColumn("dominant", dominant)
