"""Market basket: categories bought together.

An order counts for (A, B) when some product of A precedes, by product id, some product of B in the order. Joining lines
to lines would cost k^2 or k^3 rows per order, so an order is first reduced to a short sequence of categories that has the
same subsequences as the full list of its products in id order:

* pairs only need each category's first and last product;
* triples also need, per category, the first product after each category's first product.

The sequence length depends on the number of categories, never on the number of lines. Equal sequences are then counted,
and pairs and triples are read off once per distinct sequence, weighted by the number of orders that share it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ends(orders: DataFrame, products: DataFrame) -> DataFrame:
    """Per (order, category): first and last product and the number of distinct ones (an upper bound is enough)."""
    known = products.filter(F.col("category").isNotNull())
    return (
        orders.filter(F.col("order_id").isNotNull())
        .select("order_id", "product_id")
        .join(known, "product_id")
        .groupBy("order_id", "category")
        .agg(
            F.min("product_id").alias("first"),
            F.max("product_id").alias("last"),
            F.count("product_id").alias("lines"),
        )
    )


def _per_order(orders: DataFrame, products: DataFrame) -> DataFrame:
    """One row per order with its categories and their ends: all that later steps need, so that the lines are read once."""
    entry = F.struct("category", "first", "last", "lines")
    return _ends(orders, products).groupBy("order_id").agg(F.collect_list(entry).alias("categories"))


def _point(at: Column, category: Column) -> Column:
    return F.struct(at.alias("at"), category.alias("category"))


def _end_points() -> Column:
    """First and last product of every category of the order."""
    return F.flatten(
        F.transform(
            "categories",
            lambda c: F.array_distinct(F.array(_point(c["first"], c["category"]), _point(c["last"], c["category"]))),
        )
    )


def _inner_points(orders: DataFrame, products: DataFrame, per_order: DataFrame) -> DataFrame:
    """Per order: of every category and gap between two categories' first products, the first product in that gap.

    Only categories with three lines or more in an order can have a product strictly between their ends.
    """
    wide = per_order.select(
        F.col("order_id").alias("_order"),
        F.array_sort(F.transform("categories", lambda c: c["first"])).alias("starts"),
        F.explode(F.filter("categories", lambda c: c["lines"] > 2)).alias("w"),
    ).select("_order", "starts", F.col("w.category").alias("_category"), "w.first", "w.last")
    product = F.col("product_id")
    inside = (product > F.col("first")) & (product < F.col("last"))
    gap = F.size(F.filter("starts", lambda start: start < product))
    return (
        orders.select("order_id", "product_id")
        .join(products, "product_id")
        .join(wide, (F.col("order_id") == F.col("_order")) & (F.col("category") == F.col("_category")) & inside)
        .groupBy("order_id", "category", gap.alias("gap"))
        .agg(F.min("product_id").alias("at"))
        .groupBy(F.col("order_id").alias("_order"))
        .agg(F.collect_list(F.struct("at", "category")).alias("inner"))
    )


def _sequences(points: DataFrame) -> DataFrame:
    """(points) per order to (sequence, orders): each order's categories by product id, equal ones counted."""
    per_order = points.select(F.transform(F.array_sort("points"), lambda p: p["category"]).alias("sequence"))
    return per_order.filter(F.size("sequence") > 1).groupBy("sequence").agg(F.count("*").alias("orders"))


def _after(sequence: str, value: str) -> Column:
    """The part of ``sequence`` behind the first occurrence of ``value``."""
    return F.slice(F.col(sequence), (F.array_position(sequence, F.col(value)) + 1).cast("int"), F.size(sequence))


def _steps(sequences: DataFrame, length: int) -> DataFrame:
    """All distinct subsequences of ``length`` different categories, one step at a time."""
    frame = sequences.withColumnRenamed("sequence", "rest")
    names: list[str] = []
    for step in range(1, length + 1):
        name = f"Category_{step}"
        options = F.array_distinct("rest")
        for earlier in names:
            options = F.array_remove(options, F.col(earlier))
        frame = frame.select("orders", *names, "rest", F.explode(options).alias(name)).withColumn(
            "rest", _after("rest", name)
        )
        names.append(name)
    return frame.select("orders", *names)


def _top(steps: DataFrame, length: int, k: int) -> DataFrame:
    names = [f"Category_{i}" for i in range(1, length + 1)]
    count = F.sum("orders").alias("Times_Bought_Together")
    return steps.groupBy(*names).agg(count).orderBy(F.col("Times_Bought_Together").desc(), *names).limit(k)


def _combinations(sequences: DataFrame, length: int, unordered: bool) -> DataFrame:
    """Category combinations per distinct sequence; ``unordered`` forgets the product order: one entry per set."""
    if unordered:
        distinct = sequences.withColumn("sequence", F.array_sort(F.array_distinct("sequence")))
        sequences = distinct.groupBy("sequence").agg(F.sum("orders").alias("orders"))
    return _steps(sequences, length)


def category_pairs(orders: DataFrame, products: DataFrame, k: int = 10, unordered: bool = False) -> DataFrame:
    """The ``k`` category pairs found in most orders.

    Pairs follow product id, not name, so (A, B) and (B, A) both occur, as in the source; ``unordered`` merges them.
    """
    points = _per_order(orders, products).select(_end_points().alias("points"))
    return _top(_combinations(_sequences(points), 2, unordered), 2, k)


def category_triples(orders: DataFrame, products: DataFrame, k: int = 10, unordered: bool = False) -> DataFrame:
    """The ``k`` triples of different categories found in most orders, in product id order unless ``unordered``."""
    per_order = _per_order(orders, products)
    points = _end_points()
    if not unordered:
        per_order = per_order.join(_inner_points(orders, products, per_order), F.col("order_id") == F.col("_order"), "left")
        points = F.when(F.col("inner").isNull(), points).otherwise(F.concat(points, "inner"))
    sequences = _sequences(per_order.select(points.alias("points")))
    return _top(_combinations(sequences, 3, unordered), 3, k)
