"""Builds the six retail input tables from the TPC-H-like star tables (see FIXTURES.md). Whole tables, no sampling."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.tables import RetailTables

# Fixed values of the test mapping.
PAYMENT_TYPES = ("Voucher", "UPI/Cash", "Credit_card", "Debit_card")
DATE_FORMATS = ("MM/dd/yyyy HH:mm", "dd/MM/yyyy HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")
UNKNOWN_STORE_OFFSET = 100_000
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
PROSPECT_OFFSET, WALK_IN_OFFSET = 1_000_000_000, 2_000_000_000


def _pick(index: Column, values: list[Column]) -> Column:
    chosen = F.when(index == 0, values[0])
    for position, value in enumerate(values[1:], start=1):
        chosen = chosen.when(index == position, value)
    return chosen


def _spelled(kind: Column) -> Column:
    """Some payment types in small, some in capital letters."""
    spelling = F.col("l_orderkey") % 13
    return F.when(spelling == 0, F.lower(kind)).when(spelling == 1, F.upper(kind)).otherwise(kind)


def _bill_date(key: Column) -> Column:
    """The four notations in turn; of some orders a text that is no date, or one that only looks like the four."""
    iso, odd = F.date_format("billed", DATE_FORMATS[2]), key % 101
    return (
        F.when((odd == 0) | (F.col("o_custkey") % 499 == 7), "n/a")
        .when(odd == 1, F.concat(F.date_format("billed", DATE_FORMATS[3]), F.lit("+02:00")))
        .when(odd == 2, F.date_format("billed", "M/d/yyyy h:mm a"))
        .when(odd == 3, F.concat(F.lit(" "), iso))
        .when(odd == 4, F.concat(F.lit("1"), iso))
        .otherwise(_pick(key % 4, [F.date_format("billed", f) for f in DATE_FORMATS]))
    )


def star_tables(spark: SparkSession, sf_dir: str, buckets: int | None = None) -> RetailTables:
    """The retail tables of a folder; the order lines dealt out by order into ``buckets`` partitions, if given."""

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")

    return RetailTables(
        orders=_orders(table("lineitem"), table("orders"), table("part"), buckets),
        customers=_customers(table("customer"), table("supplier"), table("nation")),
        products=table("part").select(
            F.col("p_partkey").alias("product_id"),
            F.when(F.col("p_partkey") % 50 == 0, "#N/A").otherwise(F.col("p_type")).alias("category"),
        ),
        stores=_stores(table("supplier"), table("nation"), table("region")),
        payments=table("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            _spelled(_pick(F.col("l_partkey") % 4, [F.lit(t) for t in PAYMENT_TYPES])).alias("payment_type"),
            (F.col("l_extendedprice").cast("decimal(18,2)") + F.when(F.col("l_orderkey") % 50 == 0, 5).otherwise(0))
            .cast("decimal(18,2)")
            .alias("payment_value"),
        ),
        reviews=_reviews(table("orders")),
    )


def _orders(lineitem: DataFrame, orders: DataFrame, part: DataFrame, buckets: int | None) -> DataFrame:
    """Lines of known orders and parts. Prices come first: the join with the orders then leaves lines dealt out by order."""
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    billed = F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), ((key + line) % 24).cast("int"))
    price, buyer = F.col("p_retailprice").cast("decimal(12,2)"), F.col("o_custkey")
    discount = F.when(buyer % 37 == 5, 0).otherwise(F.col("l_discount")).cast("decimal(4,2)")
    channel = (
        F.when(F.col("o_orderstatus") == "O", "Online")
        .when(F.col("o_orderstatus") == "P", "Phone")
        .when(key % 2 == 0, "Instore")
        .otherwise("instore")
    )
    priced = lineitem.join(part, F.col("l_partkey") == F.col("p_partkey"))
    if buckets:
        priced, orders = priced.repartition(buckets, "l_orderkey"), orders.repartition(buckets, "o_orderkey")
    return (
        priced.join(orders, key == F.col("o_orderkey"))
        .withColumn("billed", billed)
        .select(
            key.alias("order_id"),
            line.alias("line_no"),
            F.when(buyer % 43 == 6, key + WALK_IN_OFFSET)
            .otherwise(buyer + F.when((key % 97 == 0) & (line == 1), 1).otherwise(0))
            .alias("customer_id"),
            F.when(buyer % 41 == 3, buyer % 7 + 1).otherwise(F.col("l_partkey")).alias("product_id"),
            F.when(F.col("l_suppkey") % 50 == 49, F.col("l_suppkey") + UNKNOWN_STORE_OFFSET)
            .otherwise(F.col("l_suppkey"))
            .alias("delivered_storeid"),
            channel.alias("channel"),
            _bill_date(key).alias("bill_date_timestamp"),
            F.col("l_quantity").cast("int").alias("quantity"),
            price.cast("decimal(18,4)").alias("mrp"),
            (price * discount).cast("decimal(18,4)").alias("discount"),
            (price * F.lit("0.95").cast("decimal(3,2)")).cast("decimal(18,4)").alias("cost_per_unit"),
            F.col("l_extendedprice").cast("decimal(18,2)").alias("total_amount"),
        )
    )


def _customers(customer: DataFrame, supplier: DataFrame, nation: DataFrame) -> DataFrame:
    """The customers, one of them listed twice, and one prospect per supplier who never bought anything."""
    people = customer.select(F.col("c_custkey").alias("custid"), F.col("c_nationkey").alias("n_nationkey")).unionByName(
        supplier.select(
            (F.col("s_suppkey") + PROSPECT_OFFSET).alias("custid"), F.col("s_nationkey").alias("n_nationkey")
        )
    )
    twice = F.when(F.col("custid") == 11, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return people.join(nation, "n_nationkey").withColumn("copy", F.explode(twice)).select(
        "custid",
        F.concat(F.lit("CITY_"), F.col("custid") % 60 + F.col("copy")).alias("customer_city"),
        F.col("n_name").alias("customer_state"),
        F.when(F.col("custid") % 3 == 0, "M").otherwise("F").alias("gender"),
    )


def _stores(supplier: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    """The suppliers as stores; store 0 is listed twice, under two cities."""
    twice = F.when(F.col("s_suppkey") == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (
        supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .withColumn("copy", F.explode(twice))
        .select(
            F.col("s_suppkey").alias("storeid"),
            F.concat(F.lit("CITY_"), F.col("s_suppkey") % 40 + F.col("copy")).alias("seller_city"),
            F.col("n_name").alias("seller_state"),
            F.col("r_name").alias("region"),
        )
    )


def _reviews(orders: DataFrame) -> DataFrame:
    key = F.col("o_orderkey")
    first = F.when(key % 11 != 0, (key % 5 + 1).cast("int"))
    second = (key % 3 + 1).cast("int")
    third = (key % 4 + 2).cast("int")
    scores = (
        F.when(key % 77 == 0, F.array(first, second, third))
        .when(key % 7 == 0, F.array(first, second))
        .otherwise(F.array(first))
    )
    return orders.select(key.alias("order_id"), F.explode(scores).alias("customer_satisfaction_score"))


def mixed_case(tables: RetailTables) -> RetailTables:
    """The same tables with names spelled in capitals, small letters or as they are, by the row's id."""

    def spelled(df: DataFrame, key: str, names: tuple[str, ...]) -> DataFrame:
        turn = F.col(key) % 3
        return df.withColumns(
            {n: F.when(turn == 0, F.upper(n)).when(turn == 1, F.lower(n)).otherwise(F.col(n)) for n in names}
        )

    return replace(
        tables,
        customers=spelled(tables.customers, "custid", ("customer_city", "customer_state", "gender")),
        products=spelled(tables.products, "product_id", ("category",)),
        stores=spelled(tables.stores, "storeid", ("seller_city", "seller_state", "region")),
    )
