"""README-derived: data-quality profile of the raw tables, in long form (table, rule, column, rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.columns import parse_bill_date, same_text
from shelfwise.plans.clean import BAD_CATEGORY
from shelfwise.tables import RetailTables

# Keys expected to be unique, and (table, column, parent table, parent column) references.
UNIQUE_KEYS = {
    "orders": ["order_id", "product_id"],
    "customers": ["custid"],
    "products": ["product_id"],
    "stores": ["storeid"],
}
REFERENCES = (
    ("orders", "customer_id", "customers", "custid"),
    ("orders", "product_id", "products", "product_id"),
    ("orders", "delivered_storeid", "stores", "storeid"),
    ("payments", "order_id", "orders", "order_id"),
    ("reviews", "order_id", "orders", "order_id"),
)


def _long(counts: DataFrame, table: str, rule: str, columns: list[str]) -> DataFrame:
    """A 1-row frame with one count per column, turned into rows."""
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("rows")) for c in columns])
    return counts.select(F.lit(table).alias("table"), F.lit(rule).alias("rule"), F.inline(entries))


def row_rules(df: DataFrame, table: str) -> DataFrame:
    """Rules that look at one row at a time, all in one pass: missing values, unreadable dates, placeholders."""
    rules = [("missing", c, F.col(c).isNull()) for c in df.columns]
    if table == "orders":
        text = F.col("bill_date_timestamp")
        rules.append(("unreadable", "bill_date_timestamp", text.isNotNull() & parse_bill_date(text).isNull()))
    if table == "products":
        rules.append(("placeholder", "category", same_text(F.col("category"), BAD_CATEGORY)))
    counts = df.agg(*[F.count_if(condition).alias(f"n_{i}") for i, (_, _, condition) in enumerate(rules)])
    entries = [
        F.struct(F.lit(rule).alias("rule"), F.lit(column).alias("column"), F.col(f"n_{i}").alias("rows"))
        for i, (rule, column, _) in enumerate(rules)
    ]
    return counts.select(F.lit(table).alias("table"), F.inline(F.array(*entries)))


def duplicate_keys(df: DataFrame, table: str, keys: list[str]) -> DataFrame:
    """Surplus rows beyond the first per key, missing keys grouped together."""
    name = "+".join(keys)
    surplus = F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint")
    counts = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(surplus.alias(name))
    entry = F.array(F.struct(F.lit(name).alias("column"), F.col(f"`{name}`").alias("rows")))
    return counts.select(F.lit(table).alias("table"), F.lit("duplicate").alias("rule"), F.inline(entry))


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_column: str, table: str) -> DataFrame:
    """Rows whose non-missing reference has no parent. Rows are counted per id before the anti-join."""
    ids = child.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    parents = parent.select(F.col(parent_column).alias(column)).distinct()
    lost = ids.join(parents, column, "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias(column))
    return _long(lost, table, "orphan", [column])


def quality_profile(tables: RetailTables, rejects: DataFrame | None = None) -> DataFrame:
    """Missing values, duplicate keys, unreadable dates, placeholder categories and orphan ids of the raw tables.

    ``rejects`` are the counts of an import (``sources.imports``), which are listed with the others.
    """
    frames = tables.present()
    parts = [row_rules(df, name) for name, df in frames.items()]
    parts += [duplicate_keys(frames[name], name, keys) for name, keys in UNIQUE_KEYS.items()]
    parts += [orphans(frames[t], c, frames[p], pc, t) for t, c, p, pc in REFERENCES]
    if rejects is not None:
        parts.append(rejects)
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
