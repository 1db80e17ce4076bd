"""Sales by time, product, store, region and payment type.

Lines are aggregated by their own ids first; names from products and stores are joined to those smaller results, so a
best-selling product or store does not skew a join. Unknown ids keep their sales under NULL names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.columns import line_profit, month_of, number, percent2, safe_divide
from shelfwise.operators.ranking import running_totals
from shelfwise.sources.buckets import bucket_count
from shelfwise.sources.storage import write_once

#: Lists of payment types, up to that many different ones, are a table that joins broadcast: lines carry the number of theirs.
MOST_MIXES = 10_000


def _by_store(orders: DataFrame, *measures: Column) -> DataFrame:
    return orders.groupBy(F.col("delivered_storeid").alias("sold_at")).agg(*measures)


def _at_store() -> Column:
    return F.col("sold_at") == F.col("storeid")


def _paid_types(payments: DataFrame, share_weighted: bool) -> DataFrame:
    """Per order a list of its payment types with their weights: their rows or, ``share_weighted``, their shares of the value.

    Payments are dealt out by order once; if an order is hot, they are counted before they move.
    """
    known = payments.filter(F.col("order_id").isNotNull())
    dealt = known.repartition("order_id") if bucket_count(known, "order_id") else known
    per_type = dealt.groupBy("order_id", "payment_type").agg(
        F.count("*").alias("rows"), F.sum("payment_value").alias("value")
    )
    if not share_weighted:
        counted = F.struct("payment_type", F.col("rows").alias("weight"))
        return per_type.groupBy("order_id").agg(F.array_sort(F.collect_list(counted)).alias("paid"))

    def share(part: Column) -> Column:
        by_value = F.try_divide(part["value"].cast("double"), F.col("whole").cast("double"))
        return F.struct(part["payment_type"], F.coalesce(by_value, part["rows"] / F.col("all_rows")).alias("weight"))

    return (
        per_type.groupBy("order_id")
        .agg(
            F.collect_list(F.struct("payment_type", "rows", "value")).alias("parts"),
            F.sum("value").alias("whole"),
            F.sum("rows").alias("all_rows"),
        )
        .select("order_id", F.transform("parts", share).alias("paid"))
    )


def _numbered(paid: DataFrame) -> DataFrame | None:
    """The distinct lists of ``paid`` with a number each, written; None if there are more than ``MOST_MIXES``."""
    lists = paid.select("paid").distinct()
    if lists.limit(MOST_MIXES + 1).count() > MOST_MIXES:
        return None
    return write_once(lists.withColumn("mix", F.monotonically_increasing_id()), "payment-mixes")


def sales_trend(
    orders: DataFrame, products: DataFrame, stores: DataFrame, payments: DataFrame, share_weighted: bool = False
) -> DataFrame:
    """Raw sales by month, category, region, store, channel and payment type.

    An order's sales count once per payment row, as in the source; ``share_weighted`` splits them by payment value
    instead, each part rounded to a millionth, so that they add up to the true total but for that rounding. Payment rows
    are counted per order and type, and the counts multiply the sums: the same numbers without repeating lines.

    Lines carry the list of their order's payment types, or its number where few lists occur, and become a row per type
    only where these are summed. So lines move, not their repetitions: once for the names of their products, once to
    their group. If a month and store hold too many of them they are summed before the second move, in rows per type;
    unknown stores are counted one by one for that, though they share a group per month and category.
    Writes the lists on the way and counts lines and payments when called: pass written tables.
    """
    month = month_of("correct_date").alias("month")
    lines = orders.select(
        "order_id",
        month,
        "product_id",
        "delivered_storeid",
        "channel",
        F.col("total_amount").alias("sales"),
        F.col("quantity").cast("bigint").alias("quantity"),
    )
    paid, mixes = _paid_types(payments, share_weighted), None
    if share_weighted:  # parts are rounded per order, not per line; shares hardly ever repeat
        keys = ["order_id", "month", "product_id", "delivered_storeid", "channel"]
        lines = lines.groupBy(*keys).agg(F.sum("sales").alias("sales"), F.sum("quantity").alias("quantity"))
    else:
        paid = write_once(paid, "payment-lists")
        mixes = _numbered(paid)
    if mixes is not None:
        paid = paid.join(mixes, "paid").drop("paid")

    def weighted(column: str) -> Column:
        if share_weighted:  # a rounded decimal, so that the sum does not depend on the order of its inputs
            return (F.col(column).cast("double") * F.coalesce("weight", F.lit(1.0))).cast("decimal(28,6)")
        return F.col(column) * F.coalesce("weight", F.lit(1))

    named = (
        lines.join(paid, "order_id", "left")
        .drop("order_id")
        .join(products, "product_id", "left")
        .drop("product_id")
        .join(stores.select("storeid", "region"), F.col("delivered_storeid") == F.col("storeid"), "left")
        .drop("delivered_storeid")
    )
    if bucket_count(orders.select(month, "delivered_storeid"), "month", "delivered_storeid"):
        named = named.repartition("month", "category", "storeid")
    if mixes is not None:
        named = named.join(mixes, "mix", "left")
    quantity = F.sum(weighted("quantity"))
    return (
        named.withColumn("part", F.explode_outer("paid"))
        .withColumns({"payment_type": F.col("part.payment_type"), "weight": F.col("part.weight")})
        .groupBy(
            F.col("month").alias("Month"),
            F.col("category").alias("Product_Category"),
            F.col("region").alias("Store_Region"),
            F.col("storeid").alias("StoreID"),
            F.lower("channel").alias("_channel"),
            F.lower("payment_type").alias("_payment"),
        )
        .agg(
            F.min("channel").alias("Channel"),
            F.min("payment_type").alias("payment_type"),
            number(F.sum(weighted("sales"))).alias("Total_Sales"),
            (number(quantity) if share_weighted else quantity.cast("bigint")).alias("Total_Quantity"),
        )
        .drop("_channel", "_payment")
    )


def popular_products(orders: DataFrame, products: DataFrame, stores: DataFrame) -> DataFrame:
    """Products ranked by quantity within their store (region, state, store).

    The rank is one plus the number of products with a larger quantity, taken from a histogram of quantities per store:
    the window sees one row per distinct quantity, not per product, also for the NULL place that all unknown stores share.
    The rank column keeps its source name although it ranks products.
    """
    sold = write_once(
        orders.groupBy("product_id", "delivered_storeid")
        .agg(F.sum("quantity").alias("quantity"), F.sum("total_amount").alias("sales"))
        .join(products.withColumnRenamed("product_id", "known_product"), F.col("product_id") == F.col("known_product"), "left")
        .join(stores, F.col("delivered_storeid") == F.col("storeid"), "left")
        .groupBy("region", "seller_state", "storeid", "category", "known_product")
        .agg(F.sum("quantity").alias("quantity"), F.sum("sales").alias("sales")),
        "popular",
    )
    place = ["region", "seller_state", "storeid"]
    above = Window.partitionBy(*place).orderBy(F.col("quantity").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranks = (
        sold.groupBy(*place, "quantity")
        .agg(F.count("*").alias("products"))
        .select(
            *[F.col(c).alias(f"_{c}") for c in [*place, "quantity"]],
            (F.coalesce(F.sum("products").over(above), F.lit(0)) + 1).alias("Category_Rank"),
        )
    )
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*place, "quantity"]]
    return sold.join(ranks, same).select(
        F.col("region").alias("Region"),
        "seller_state",
        F.col("storeid").alias("StoreID"),
        F.col("category").alias("Product_Category"),
        F.col("known_product").alias("product_id"),
        F.col("quantity").alias("Total_Quantity_Sold"),
        number(F.col("sales")).alias("Total_Sales"),
        "Category_Rank",
    )


def most_expensive_products(orders: DataFrame, products: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` products with the highest unit cost (the source's "price") and their share of raw sales."""
    total = orders.agg(F.sum("total_amount")).scalar()
    per_product = orders.groupBy("product_id").agg(
        F.max("cost_per_unit").alias("price"), F.sum("total_amount").alias("sales")
    )
    top = per_product.filter("price is not null").orderBy(F.col("price").desc(), "product_id").limit(k)
    return top.join(products, "product_id", "left").select(
        F.col("product_id").alias("Product_ID"),
        F.col("category").alias("Category"),
        number(F.col("price")).alias("Price"),
        number(F.col("sales")).alias("Total_Sales"),
        percent2(F.col("sales"), total).alias("Contribution_Percentage"),
    )


def sold_products(orders: DataFrame, products: DataFrame) -> DataFrame:
    """Products that occur in orders, with their category."""
    sold = orders.filter(F.col("product_id").isNotNull()).select("product_id").distinct()
    return sold.join(products, "product_id", "left").select(
        F.col("product_id").alias("Product_ID"), F.col("category").alias("Category")
    )


def _best_and_worst(rows: DataFrame, k: int, tie: list[str]) -> DataFrame:
    """The ``k`` rows with most and with least ``sales``, marked so in ``Category``."""
    worst = rows.orderBy(F.col("sales").asc(), *tie).limit(k).withColumn("Category", F.lit(f"Bottom {k}"))
    best = rows.orderBy(F.col("sales").desc(), *tie).limit(k).withColumn("Category", F.lit(f"Top {k}"))
    return worst.unionByName(best)


def top_bottom_products(orders: DataFrame, products: DataFrame, k: int = 10) -> DataFrame:
    """README-derived: the ``k`` best and ``k`` worst products by raw sales, ties by id; a missing total is the worst."""
    per_product = orders.groupBy("product_id").agg(F.sum("total_amount").alias("sales"), F.sum("quantity").alias("quantity"))
    return (
        _best_and_worst(per_product, k, ["product_id"])
        .join(products.withColumnRenamed("category", "product_category"), "product_id", "left")
        .select(
            "Category",
            F.col("product_id").alias("Product_ID"),
            F.col("product_category").alias("Product_Category"),
            F.col("quantity").alias("Total_Quantity"),
            number(F.col("sales")).alias("Total_Sales"),
        )
    )


def store_category_performance(orders: DataFrame, products: DataFrame, stores: DataFrame) -> DataFrame:
    """README-derived: orders, quantity, sales and profit per store and category, with the share of the store's sales.

    Lines are summed per (store, product) and orders counted per (store, category) on distinct pairs. Unknown stores
    form one NULL store, unknown products a NULL category.
    """
    known = F.col("storeid")
    per_product = orders.groupBy("delivered_storeid", "product_id").agg(
        F.sum("quantity").alias("quantity"), F.sum("new_total_amount").alias("sales"), F.sum(line_profit()).alias("profit")
    )
    place = stores.select("storeid")
    sums = (
        per_product.join(products, "product_id", "left")
        .join(place, F.col("delivered_storeid") == known, "left")
        .groupBy("storeid", "category")
        .agg(*[F.sum(c).alias(c) for c in ("quantity", "sales", "profit")])
    )
    counted = (
        orders.select("delivered_storeid", "product_id", "order_id")
        .distinct()
        .join(products, "product_id", "left")
        .join(place, F.col("delivered_storeid") == known, "left")
        .groupBy(known.alias("_store"), F.col("category").alias("_category"))
        .agg(F.countDistinct("order_id").alias("orders"))
    )
    same = known.eqNullSafe(F.col("_store")) & F.col("category").eqNullSafe(F.col("_category"))
    whole = F.sum("sales").over(Window.partitionBy("storeid"))
    return sums.join(counted, same).select(
        F.col("storeid").alias("StoreID"),
        F.col("category").alias("Product_Category"),
        F.col("orders").alias("Orders"),
        F.col("quantity").alias("Total_Quantity"),
        number(F.col("sales")).alias("Total_Sales"),
        number(F.col("profit")).alias("Total_Profit"),
        percent2(F.col("sales"), whole).alias("Sales_Percentage_of_Store"),
    )


def top_bottom_stores(orders: DataFrame, stores: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best and ``k`` worst stores by raw sales. Unknown stores form one row; a missing total is the worst."""
    per_store = (
        _by_store(orders, F.sum("total_amount").alias("sales"))
        .join(stores, _at_store(), "left")
        .groupBy("storeid", "seller_city", "seller_state", "region")
        .agg(F.sum("sales").alias("sales"))
    )
    tie = ["storeid", "seller_city", "seller_state", "region"]
    return _best_and_worst(per_store, k, tie).select(
        "Category",
        F.col("storeid").alias("StoreID"),
        "seller_city",
        "seller_state",
        F.col("region").alias("Region"),
        number(F.col("sales")).alias("Total_Sales"),
    )


def monthly_sales(orders: DataFrame) -> DataFrame:
    return orders.groupBy(month_of("correct_date").alias("Month")).agg(
        number(F.sum("new_total_amount")).alias("Total_Sales")
    )


def monthly_sales_share(orders: DataFrame) -> DataFrame:
    total = orders.agg(F.sum("new_total_amount")).scalar()
    monthly = orders.groupBy(month_of("correct_date").alias("Month")).agg(F.sum("new_total_amount").alias("sales"))
    return monthly.select(
        "Month",
        number(F.col("sales")).alias("Total_Sales"),
        percent2(F.col("sales"), total).alias("Percentage_Contribution"),
    )


def weekday_sales(orders: DataFrame) -> DataFrame:
    """Sales by weekday; Sunday is day 1. Grouped by day number, the name is added to the eight groups at most."""
    number_of_day = F.dayofweek("correct_date")
    names = F.array(*[F.lit(d) for d in ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")])
    return (
        orders.groupBy(number_of_day.alias("Day_Number"))
        .agg(number(F.sum("new_total_amount")).alias("Total_Sales"))
        .select(F.get(names, F.col("Day_Number") - 1).alias("Day_Name"), "Day_Number", "Total_Sales")
    )


def revenue_per_unit_by_store(orders: DataFrame, stores: DataFrame) -> DataFrame:
    """Average revenue per unit sold, for every store.

    The source statement is unfinished (it names no numerator); ours is the recomputed line amount.
    """
    sums = _by_store(orders, F.sum("new_total_amount").alias("sales"), F.sum("quantity").alias("units"))
    return stores.join(sums, _at_store(), "left").select(
        "seller_city",
        F.col("storeid").alias("StoreID"),
        safe_divide(F.col("sales"), F.col("units")).alias("avg_unit_revenue"),
    )


def pareto(orders: DataFrame, products: DataFrame, by: str = "category", threshold: int = 80) -> DataFrame:
    """README-derived: cumulative share of sales by descending sales; ``by`` is category, product_id or storeid.

    ``in_threshold`` marks the items whose cumulative share does not exceed ``threshold`` percent.
    """
    if by == "category":
        per_product = orders.groupBy("product_id").agg(F.sum("new_total_amount").alias("sales"))
        items = per_product.join(products, "product_id").groupBy("category").agg(F.sum("sales").alias("sales"))
    else:
        column = {"product_id": "product_id", "storeid": "delivered_storeid"}[by]
        items = orders.groupBy(F.col(column).alias(by)).agg(F.sum("new_total_amount").alias("sales"))
    ranked = running_totals(items.withColumnRenamed(by, "item"), "sales", "item")
    whole = ranked.agg(F.struct(F.max("position").alias("n"), F.sum("sales").alias("sales"))).scalar()
    share = percent2(F.col("running_value"), whole["sales"])
    return ranked.select(
        "item",
        number(F.col("sales")).alias("sales"),
        share.alias("cumulative_sales_pct"),
        percent2(F.col("position"), whole["n"]).alias("cumulative_item_pct"),
        (share <= threshold).alias("in_threshold"),
    )


def region_share(orders: DataFrame, stores: DataFrame, by: str = "region") -> DataFrame:
    """README-derived: sales and profit per region (or state) with their shares of the total. Unknown stores: NULL."""
    sums = _by_store(orders, F.sum("new_total_amount").alias("sales"), F.sum(line_profit()).alias("profit"))
    whole = orders.agg(
        F.struct(F.sum("new_total_amount").alias("sales"), F.sum(line_profit()).alias("profit"))
    ).scalar()
    grouped = (
        sums.join(stores, _at_store(), "left").groupBy(by).agg(F.sum("sales").alias("s"), F.sum("profit").alias("p"))
    )
    return grouped.select(
        by,
        number(F.col("s")).alias("sales"),
        number(F.col("p")).alias("profit"),
        percent2(F.col("s"), whole["sales"]).alias("sales_pct"),
        percent2(F.col("p"), whole["profit"]).alias("profit_pct"),
    )


def payment_mix(payments: DataFrame) -> DataFrame:
    """README-derived: orders and value per payment type (spelled in any case) with the type's share of the value."""
    total = payments.agg(F.sum("payment_value")).scalar()
    grouped = payments.groupBy(F.lower("payment_type").alias("_kind")).agg(
        F.min("payment_type").alias("payment_type"),
        F.countDistinct("order_id").alias("orders"),
        F.sum("payment_value").alias("v"),
    )
    return grouped.select(
        "payment_type", "orders", number(F.col("v")).alias("value"), percent2(F.col("v"), total).alias("value_pct")
    )


def store_payment_mix(orders: DataFrame, payment_summary: DataFrame) -> DataFrame:
    """README-derived: per store, the payments of the orders it took part in, by type, with the share within the store.

    An order delivered from several stores counts in each of them.
    """
    kinds = ("Voucher", "UPI/Cash", "Credit card", "Debit card")
    sold = orders.select("order_id", F.col("delivered_storeid").alias("storeid")).distinct()
    sums = (
        sold.join(payment_summary, "order_id")
        .groupBy("storeid")
        .agg(
            *[F.sum(f"`{k}`").alias(f"v_{i}") for i, k in enumerate(kinds)],
            *[F.count_if(F.col(f"`{k}`") > 0).alias(f"n_{i}") for i, k in enumerate(kinds)],
        )
    )
    whole = sum((F.col(f"v_{i}") for i in range(1, len(kinds))), F.col("v_0"))
    entries = [
        F.struct(F.lit(k).alias("payment_type"), F.col(f"n_{i}").alias("orders"), F.col(f"v_{i}").alias("v"))
        for i, k in enumerate(kinds)
    ]
    return sums.select("storeid", whole.alias("whole"), F.explode(F.array(*entries)).alias("e")).select(
        "storeid",
        "e.payment_type",
        "e.orders",
        number(F.col("e.v")).alias("value"),
        percent2(F.col("e.v"), F.col("whole")).alias("value_pct"),
    )
