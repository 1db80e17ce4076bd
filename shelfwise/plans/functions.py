"""The analyses as SQL table functions: ``SELECT * FROM cohorts()`` and the like.

Registering makes the tables known to ``spark.sql`` and, for every analysis that builds its plan without running jobs, a temporary
function that returns its result. A call is expanded into the analysis' plan, so filters and column choices around it
are optimised together with it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from shelfwise.plans import basket, category, customers, growth, ratings, sales
from shelfwise.tables import RetailTables

FUNCTIONS: dict[str, Callable[[RetailTables], DataFrame]] = {
    "new_customers_by_month": lambda t: growth.new_customers_by_month(t.orders),
    "monthly_retention": lambda t: growth.monthly_retention(t.orders),
    "new_vs_existing_revenue": lambda t: growth.new_vs_existing_revenue(t.orders),
    "cohorts": lambda t: growth.cohorts(t.orders),
    "monthly_sales": lambda t: sales.monthly_sales(t.orders),
    "monthly_sales_share": lambda t: sales.monthly_sales_share(t.orders),
    "weekday_sales": lambda t: sales.weekday_sales(t.orders),
    "top_bottom_stores": lambda t: sales.top_bottom_stores(t.orders, t.stores),
    "payment_mix": lambda t: sales.payment_mix(t.payments),
    "revenue_bands": lambda t: customers.revenue_bands(t.orders, t.customers),
    "buyer_types": lambda t: customers.buyer_types(t.orders),
    "discount_seekers": lambda t: customers.discount_seekers(t.orders),
    "customer_preferences": lambda t: customers.customer_preferences(t.orders, t.payments, t.products),
    "category_breadth": lambda t: customers.category_breadth(t.orders, t.products),
    "gender_patterns": lambda t: customers.gender_patterns(t.orders, t.customers),
    "category_sales": lambda t: category.category_sales(t.orders, t.products),
    "category_profit": lambda t: category.category_profit(t.orders, t.products),
    "category_penetration": lambda t: category.category_penetration(t.orders, t.products),
    "first_purchase_categories": lambda t: category.first_purchase_categories(t.orders, t.products),
    "category_pairs": lambda t: basket.category_pairs(t.orders, t.products),
    "rating_by_month": lambda t: ratings.average_rating(t.orders, t.reviews, "month", t.products, t.customers),
}
_VIEW = "shelfwise_{}"


def register_functions(tables: RetailTables) -> list[str]:
    """Register the tables as views and every analysis as a table function without arguments; the functions' names.

    Registering again binds the functions to the new tables.
    """
    spark = tables.orders.sparkSession
    tables.register_views()
    for name, build in FUNCTIONS.items():
        result, view = build(tables), _VIEW.format(name)
        result.createOrReplaceTempView(view)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in result.schema.fields)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}() RETURNS TABLE ({columns}) RETURN SELECT * FROM {view}")
    return list(FUNCTIONS)
