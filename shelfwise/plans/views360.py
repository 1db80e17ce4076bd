"""The wide store, order and customer views."""

from __future__ import annotations

from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.columns import is_weekend, line_cost, line_profit, number, percent2, safe_divide, whole_average
from shelfwise.operators.grouping import first_per_key, total_order
from shelfwise.operators.ranking import add_ntiles, exact_percentile, exact_percentiles
from shelfwise.sources.storage import write_once

# The profit percentile that counts as high, spend segments, discount classes (upper limits in percent).
HIGH_PROFIT = Fraction(3, 4)
SPEND_SEGMENTS = ("Low", "Medium", "High")
DISCOUNT_CLASSES = {"No Discount": 0, "Low": 5, "Medium": 10}


def _line_sums() -> list[Column]:
    """The measures all three views sum from lines."""
    return [
        F.sum("quantity").alias("qty"),
        F.sum("new_total_amount").alias("amount"),
        F.sum("discount").alias("discount"),
        F.count_if(F.col("discount") > 0).alias("discounted"),
        F.sum(line_cost()).alias("cost"),
        F.sum(line_profit()).alias("profit"),
    ]


def _reaches(column: str, threshold) -> Column:
    """``column >= threshold``; an absent threshold (no rows at all) is never reached."""
    return F.coalesce(F.col(column) >= F.lit(threshold), F.lit(False))


def day_part(ts: str, afternoon_until: int, evening_until: int) -> Column:
    """Part of the day by hour. The store and the order view draw the lines differently; no timestamp means Night."""
    hour = F.hour(ts)
    return (
        F.when(hour.between(6, 11), "Morning")
        .when(hour.between(12, afternoon_until), "Afternoon")
        .when(hour.between(afternoon_until + 1, evening_until), "Evening")
        .otherwise("Night")
    )


PLACE = ["storeid", "seller_city"]


def _at_place(per_store: DataFrame, stores: DataFrame) -> DataFrame:
    """Name the store of rows keyed by ``delivered_storeid``; all unknown ids share the NULL place."""
    return per_store.join(
        stores.select(*PLACE), F.col("delivered_storeid") == F.col("storeid"), "left"
    )


def _distinct_at_place(orders: DataFrame, stores: DataFrame, column: str, alias: str) -> DataFrame:
    """Distinct values per place, from distinct (store, value) pairs."""
    pairs = orders.select("delivered_storeid", column).distinct()
    return _at_place(pairs, stores).groupBy(*PLACE).agg(F.countDistinct(column).alias(alias))


def _join_places(left: DataFrame, right: DataFrame) -> DataFrame:
    renamed = right.withColumnsRenamed({c: f"_{c}" for c in PLACE})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in PLACE]
    return left.join(renamed, same).drop(*[f"_{c}" for c in PLACE])


def store360(
    orders: DataFrame, products: DataFrame, stores: DataFrame, review_scores: DataFrame, integer_averages: bool = False
) -> DataFrame:
    """One row per store with sales, profit, flags and per-visit averages.

    ``integer_averages`` cuts the mean rating to a whole number; give it scores per order that are (``average_review``).

    Only stores with orders appear; orders of unknown stores share one NULL row, whose visit columns are empty (0 for the
    two sums) as they match no store. A visit is a distinct (order, customer, store, timestamp).

    Money is summed straight per store. Visits and distinct counts run as separate narrow aggregates over ids only, so
    no wide row is repeated per distinct count; everything meets again at one row per store.
    """
    weekend, mean = is_weekend("correct_date"), whole_average if integer_averages else safe_divide
    money = orders.groupBy("delivered_storeid").agg(
        *_line_sums(),
        F.max("correct_date").alias("last"),
        F.sum(F.when(weekend, F.col("new_total_amount")).otherwise(0)).alias("weekend_sales"),
        F.sum(F.when(~weekend, F.col("new_total_amount")).otherwise(0)).alias("weekday_sales"),
    )
    sums = ("qty", "amount", "discount", "discounted", "cost", "profit", "weekend_sales", "weekday_sales")
    per_place = _at_place(money, stores).groupBy(*PLACE).agg(*[F.sum(c).alias(c) for c in sums], F.max("last").alias("last"))

    visits = orders.groupBy("order_id", "customer_id", "delivered_storeid", "correct_date").agg(
        F.max(F.col("new_total_amount").isNotNull()).alias("priced"), F.max(line_profit().isNotNull()).alias("costed")
    )
    visited = (
        _at_place(visits.join(review_scores, "order_id", "left"), stores)
        .groupBy(*PLACE)
        .agg(
            F.count("order_id").alias("visits"),
            F.count_if("priced").alias("priced_visits"),
            F.count_if("costed").alias("costed_visits"),
            # A mean of decimals: it does not depend on the order of its inputs.
            mean(F.sum(F.col("average_score").cast("decimal(20,10)")), F.count("average_score")).alias("rating"),
        )
    )
    assortment = (
        _at_place(orders.select("delivered_storeid", "product_id").distinct().join(products, "product_id", "left"), stores)
        .groupBy(*PLACE)
        .agg(F.countDistinct("product_id").alias("items"), F.countDistinct("category").alias("categories"))
    )
    parts = [
        visited,
        assortment,
        _distinct_at_place(orders, stores, "order_id", "orders"),
        _distinct_at_place(orders, stores, "customer_id", "customers"),
    ]
    base = write_once(reduce(_join_places, parts, per_place), "store360")
    high = exact_percentile(base, "profit", HIGH_PROFIT)
    known = F.col("storeid").isNotNull()

    def per(total: str, count: str) -> Column:
        return F.when(known, safe_divide(F.col(total), F.col(count)))

    return base.select(
        "storeid",
        F.col("seller_city").alias("Location"),
        F.col("orders").alias("No_of_Orders"),
        F.col("items").alias("No_of_Items"),
        F.col("qty").alias("Total_Qty"),
        number(F.col("amount")).alias("Total_Amount"),
        number(F.col("discount")).alias("Total_Discount"),
        F.col("discounted").alias("Items_With_Discount"),
        number(F.col("cost")).alias("Total_Cost"),
        number(F.col("profit")).alias("Total_Profit"),
        F.when(F.col("profit") < 0, 1).otherwise(0).alias("Flag_Loss_Making"),
        F.when(_reaches("profit", high), 1).otherwise(0).alias("Orders_with_High_Profit"),
        F.col("categories").alias("Distinct_Categories"),
        F.when(is_weekend("last"), 1).otherwise(0).alias("Weekend_Trans_Flag"),
        number(F.when(known, F.col("weekend_sales")).otherwise(0)).alias("Weekend_Sales"),
        number(F.when(known, F.col("weekday_sales")).otherwise(0)).alias("Weekday_Sales"),
        per("amount", "priced_visits").alias("Average_Order_Value"),
        per("profit", "costed_visits").alias("Average_Profit_Per_Transaction"),
        per("profit", "customers").alias("Average_Profit_Per_Customer"),
        per("visits", "customers").alias("Average_Customer_Visits"),
        F.when(known, F.col("rating")).alias("Average_Rating_Per_Customer"),
    )


def _order_sums(orders: DataFrame, products: DataFrame) -> DataFrame:
    """Per order: sums straight from the lines, distinct counts from (order, product) pairs; both hashed by order."""
    known = orders.filter(F.col("order_id").isNotNull())
    sums = known.groupBy("order_id").agg(*_line_sums(), F.max("correct_date").alias("last"))
    variety = (
        known.select("order_id", "product_id")
        .distinct()
        .join(products, "product_id", "left")
        .groupBy("order_id")
        .agg(F.count("product_id").alias("items"), F.countDistinct("category").alias("categories"))
    )
    return sums.join(variety, "order_id")


def orders360(orders: DataFrame, products: DataFrame) -> DataFrame:
    """One row per order with sums, profit flags, weekend flag and part of the day (evening ends at 21 here).

    Runs jobs when called: the sums are written before the percentile is looked for.
    """
    base = write_once(_order_sums(orders, products), "orders360")
    high = exact_percentile(base, "profit", HIGH_PROFIT)
    weekday = F.dayofweek("last")
    return base.select(
        "order_id",
        F.col("items").alias("No_of_items"),
        F.col("qty").alias("Total_Qty"),
        number(F.col("amount")).alias("Total_Amount"),
        number(F.col("discount")).alias("Total_Discount"),
        F.col("discounted").alias("Items_with_Discount"),
        number(F.col("cost")).alias("Total_Cost"),
        number(F.col("profit")).alias("Total_Profit"),
        F.when(F.col("profit") < 0, "Negative").otherwise("Positive").alias("Flag_Loss_Making"),
        F.when(_reaches("profit", high), "High").otherwise("Moderate").alias("Orders_with_High_Profit"),
        F.col("categories").alias("Distinct_Categories"),
        F.when(weekday == 1, "Sunday").when(weekday == 7, "Saturday").otherwise("Weekday").alias("Weekend_Trans_Flag"),
        day_part("last", 16, 21).alias("Hours_Flag"),
    )


def orders360_feedback(orders: DataFrame, products: DataFrame, review_scores: DataFrame) -> DataFrame:
    """README-derived: the order view with the order's average review score."""
    return orders360(orders, products).join(review_scores, "order_id", "left")


def discount_class(orders: DataFrame) -> DataFrame:
    """README-derived: discount as percent of an order's undiscounted value, in classes (limits are our choice)."""
    per_order = orders.groupBy("order_id").agg(
        F.sum(F.col("quantity") * F.col("discount")).alias("given"),
        F.sum(F.col("quantity") * F.col("mrp")).alias("value"),
    )
    percent = percent2(F.col("given"), F.col("value"))
    label = F.lit("High")
    for name, limit in reversed(DISCOUNT_CLASSES.items()):
        label = F.when(F.col("discount_pct") <= limit, name).otherwise(label)
    return per_order.select("order_id", percent.alias("discount_pct")).withColumn(
        "discount_class", F.when(F.col("discount_pct").isNotNull(), label)
    )


def _payment_flags() -> dict[str, Column]:
    return {
        "voucher": F.col("Voucher") > 0,
        "upi": F.col("`UPI/Cash`") > 0,
        "credit": F.col("`Credit card`") > 0,
        "debit": F.col("`Debit card`") > 0,
    }


def _preferred_payment() -> Column:
    """The kind that beats all later ones in the order voucher, credit, debit; a tie falls through, UPI is the rest."""
    voucher, credit, debit, upi = (F.col(f"paid_{k}") for k in ("voucher", "credit", "debit", "upi"))
    return (
        F.when(voucher > F.greatest(credit, debit, upi), "Voucher")
        .when(credit > F.greatest(debit, upi), "Credit Card")
        .when(debit > upi, "Debit Card")
        .otherwise("UPI")
    )


def _buyer_orders(
    orders: DataFrame, payment_summary: DataFrame, reviews: DataFrame, dedupe_reviews: bool
) -> tuple[DataFrame, DataFrame]:
    """(per order review figures, per (customer, order) sums with them and the order's payments).

    ``copies`` is how often joining reviews to lines would repeat each line of the order.
    """
    score = F.col("customer_satisfaction_score")
    rated = reviews.groupBy("order_id").agg(
        (F.lit(1) if dedupe_reviews else F.count("*")).cast("bigint").alias("copies"),
        (F.count(score) if not dedupe_reviews else F.max(F.when(score.isNotNull(), 1).otherwise(0)))
        .cast("bigint")
        .alias("scored"),
        (F.sum(score).cast("double") if not dedupe_reviews else F.avg(score)).alias("score_sum"),
    )
    lines = (
        orders.filter(F.col("customer_id").isNotNull())
        .groupBy("customer_id", "order_id")
        .agg(
            *_line_sums(),
            F.count("*").alias("lines"),
            F.count_if(F.col("new_total_amount") < line_cost()).alias("losses"),
            F.min("correct_date").alias("first"),
            F.max("correct_date").alias("last"),
        )
    )
    joined = lines.join(payment_summary, "order_id", "left").join(rated, "order_id", "left")
    return rated, joined.withColumn("copies", F.coalesce("copies", F.lit(1)))


def _buyer_totals(buyer_orders: DataFrame, latest: Column, extra: list[Column]) -> DataFrame:
    """Per customer sums, repeated per review where the source does so, and the ``extra`` ones in the same pass."""
    copies = F.col("copies")
    flags = _payment_flags()
    kinds = {k: F.coalesce(v, F.lit(False)) for k, v in flags.items()}
    first_kind = {
        "voucher": kinds["voucher"],
        "upi": kinds["upi"] & ~kinds["voucher"],
        "credit": kinds["credit"] & ~kinds["voucher"] & ~kinds["upi"],
        "debit": kinds["debit"] & ~kinds["voucher"] & ~kinds["upi"] & ~kinds["credit"],
    }
    used = reduce(lambda a, b: a + b, [F.max(v.cast("int")) for v in first_kind.values()])
    return buyer_orders.groupBy(F.col("customer_id").alias("buyer")).agg(
        F.min("first").alias("First_Transaction_Date"),
        F.max("last").alias("Last_Transaction_Date"),
        F.date_diff(latest.cast("date"), F.max("last").cast("date")).alias("Inactive_Days"),
        F.count("order_id").alias("Frequency"),
        F.sum("amount").alias("monetary"),
        F.sum("profit").alias("profit_sum"),
        F.sum("discount").alias("discount_sum"),
        F.sum("qty").alias("Total_Quantity"),
        F.sum(F.col("discounted") * copies).alias("Transactions_with_Discount"),
        F.sum(F.col("losses") * copies).alias("Transactions_with_Loss"),
        used.cast("bigint").alias("Different_Payment_Types"),
        *[
            F.sum(F.when(v, F.col("lines") * copies).otherwise(0)).alias(f"paid_{k}") for k, v in kinds.items()
        ],
        *extra,
    )


def _purchase_sums(integer_averages: bool = False) -> list[Column]:
    """The "first purchase" figures, which in the source cover all purchases and repeat per review."""
    copies, total, rows = F.col("copies"), F.sum(F.col("lines") * F.col("score_sum")), F.sum(F.col("lines") * F.col("scored"))
    mean = whole_average(total.cast("decimal(38,10)"), rows) if integer_averages else safe_divide(total, rows)
    return [
        F.sum(F.col("qty") * copies).alias("First_Purchase_Qty"),
        F.sum(F.col("amount") * copies).alias("first_amount"),
        mean.alias("Average_Satisfaction_Score"),
    ]


def _first_lines(orders: DataFrame) -> DataFrame:
    """Lines that carry their customer's first timestamp."""
    firsts = orders.groupBy(F.col("customer_id").alias("_buyer")).agg(F.min("correct_date").alias("_first"))
    matches = (F.col("customer_id") == F.col("_buyer")) & (F.col("correct_date") == F.col("_first"))
    return orders.join(firsts, matches).select(*orders.columns)


def _counts(orders: DataFrame, column: Column, alias: str) -> DataFrame:
    """Distinct values per customer, distinct pairs first so that both steps pre-aggregate."""
    pairs = orders.select(F.col("customer_id").alias("buyer"), column.alias("v")).distinct()
    return pairs.groupBy("buyer").agg(F.count("v").alias(alias))


def _categories(orders: DataFrame, products: DataFrame, rated: DataFrame) -> DataFrame:
    """Per customer: number of categories and the one with most lines (lines repeat per review as in the source)."""
    per_order = (
        orders.select("customer_id", "order_id", "product_id")
        .join(products.filter(F.col("category").isNotNull()), "product_id")
        .groupBy("customer_id", "order_id", "category")
        .agg(F.count("*").alias("lines"))
    )
    weighted = (
        per_order.join(rated.select("order_id", "copies"), "order_id", "left")
        .groupBy(F.col("customer_id").alias("buyer"), "category")
        .agg(F.sum(F.col("lines") * F.coalesce("copies", F.lit(1))).alias("w"))
    )
    ranked = F.min(F.struct((-F.col("w")).alias("w"), F.col("category"))).getField("category")
    return weighted.groupBy("buyer").agg(
        F.count("*").alias("Distinct_Categories_Purchased"), ranked.alias("Top_Category")
    )


def customer360(
    customers: DataFrame,
    orders: DataFrame,
    products: DataFrame,
    payment_summary: DataFrame,
    stores: DataFrame,
    reviews: DataFrame,
    dedupe_reviews: bool = False,
    first_purchase_only: bool = False,
    percentile_segments: bool = False,
    integer_averages: bool = False,
) -> DataFrame:
    """One row per customer who bought something: activity, money, variety, payment habits, spend segment.

    Known oddities of the source are the default: joining raw reviews repeats lines (counts of discounted, loss-making
    and paid lines, top category, the First_Purchase_* sums), and the First_Purchase_* columns cover all purchases.
    ``dedupe_reviews`` counts every line once; ``first_purchase_only`` restricts those columns to lines with the
    customer's first timestamp; for a buyer without any they are NULL. The spend segment is NTILE(3) over all customers,
    buyers or not; with ``percentile_segments`` it follows from where the spend of buyers has its 1/3 and 2/3 percentiles
    (equal spends then always share a segment). ``integer_averages`` cuts the mean satisfaction to a whole number. A customer listed twice counts once, with the first by the other columns.

    Runs jobs when called: the view is written before customers are put in order. Nothing is repeated physically: lines are summed per (customer, order), reviews and payments per order, and the
    products of the two give the repeated figures. All parts end up hashed by customer, so joining them is local.
    """
    latest = orders.agg(F.max("correct_date")).scalar()
    rated, buyer_orders = _buyer_orders(orders, payment_summary, reviews, dedupe_reviews)
    totals = _buyer_totals(buyer_orders, latest, [] if first_purchase_only else _purchase_sums(integer_averages))
    kept = orders.filter(F.col("customer_id").isNotNull())
    first_lines = _first_lines(kept) if first_purchase_only else kept
    # What, how and where a customer buys, from one pass: distinct combinations first, then distinct counts of them.
    habits = (
        kept.select(
            F.col("customer_id").alias("buyer"), "product_id", F.lower("channel").alias("channel"), "delivered_storeid"
        )
        .distinct()
        .join(stores.select("storeid", "seller_city"), F.col("delivered_storeid") == F.col("storeid"), "left")
        .groupBy("buyer")
        .agg(
            F.countDistinct("product_id").alias("Distinct_Items_Purchased"),
            F.countDistinct("channel").alias("Channels_Used"),
            F.countDistinct("delivered_storeid").alias("Distinct_Stores"),
            F.countDistinct("seller_city").alias("Distinct_Cities"),
        )
    )
    parts = [
        totals,
        habits,
        _categories(kept, products, rated),
    ]
    if first_purchase_only:
        first_orders = _buyer_orders(first_lines, payment_summary, reviews, dedupe_reviews)[1]
        parts.append(first_orders.groupBy(F.col("customer_id").alias("buyer")).agg(*_purchase_sums(integer_averages)))
        variety = _categories(first_lines, products, rated)
        parts += [
            _counts(first_lines, F.col("product_id"), "First_Purchase_Distinct_Items"),
            variety.select("buyer", F.col("Distinct_Categories_Purchased").alias("First_Purchase_Distinct_Categories")),
        ]
    buyers = reduce(lambda a, b: a.join(b, "buyer", "left"), parts)
    if not first_purchase_only:
        buyers = buyers.withColumn("First_Purchase_Distinct_Items", F.col("Distinct_Items_Purchased")).withColumn(
            "First_Purchase_Distinct_Categories", F.col("Distinct_Categories_Purchased")
        )
    single = first_per_key(customers, ["custid"], total_order(customers, [], ["custid"]))
    everyone = write_once(single.join(buyers, F.col("custid") == F.col("buyer"), "left"), "customer360")
    segment = F.element_at(F.array(*[F.lit(s) for s in SPEND_SEGMENTS]), F.col("tile"))
    if percentile_segments:
        parts = len(SPEND_SEGMENTS)
        limits = exact_percentiles(everyone, "monetary", [Fraction(k, parts) for k in range(1, parts)])
        tile = reduce(lambda a, b: a + b, [F.when(F.col("monetary") > F.lit(x), 1).otherwise(0) for x in limits], F.lit(1))
        tiled = everyone.withColumn("tile", F.when(F.col("monetary").isNotNull(), tile))
    else:
        tiled = add_ntiles(everyone, "custid", len(SPEND_SEGMENTS), tile=("monetary", False))
    first_categories = F.when(
        F.col("First_Purchase_Qty").isNotNull(), F.coalesce("First_Purchase_Distinct_Categories", F.lit(0))
    )
    return (
        tiled.filter(F.col("Total_Quantity").isNotNull())
        .fillna(0, ["Distinct_Categories_Purchased"])
        .withColumn("First_Purchase_Distinct_Categories", first_categories)
        .select(
            "custid",
            "customer_city",
            "customer_state",
            "gender",
            "Top_Category",
            "First_Transaction_Date",
            "Last_Transaction_Date",
            "Inactive_Days",
            "Frequency",
            number(F.col("monetary")).alias("Monetary"),
            number(F.col("profit_sum")).alias("Profit"),
            number(F.col("discount_sum")).alias("Discount"),
            "Total_Quantity",
            "Distinct_Items_Purchased",
            "Distinct_Categories_Purchased",
            "Transactions_with_Discount",
            "Transactions_with_Loss",
            "Channels_Used",
            "Distinct_Stores",
            "Distinct_Cities",
            "Different_Payment_Types",
            F.col("paid_voucher").alias("Transactions_Paid_with_Voucher"),
            F.col("paid_credit").alias("Transactions_Paid_with_Credit_Card"),
            F.col("paid_debit").alias("Transactions_Paid_with_Debit_Card"),
            F.col("paid_upi").alias("Transactions_Paid_with_UPI"),
            _preferred_payment().alias("Preferred_Payment_Method"),
            "First_Purchase_Qty",
            number(F.col("first_amount")).alias("First_Purchase_Amount"),
            "First_Purchase_Distinct_Items",
            "First_Purchase_Distinct_Categories",
            "Average_Satisfaction_Score",
            segment.alias("Customer_Segment"),
        )
    )
