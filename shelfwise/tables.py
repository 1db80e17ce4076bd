"""The retail data model: table schemas and the bundle of tables the analyses take."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

# Schemas of the input tables. Ids may be strings instead of longs: nothing in the analyses does arithmetic on them.
SCHEMAS: dict[str, str] = {
    "orders": (
        "order_id bigint, line_no int, customer_id bigint, product_id bigint, delivered_storeid bigint, "
        "channel string, bill_date_timestamp string, quantity int, mrp decimal(18,4), discount decimal(18,4), "
        "cost_per_unit decimal(18,4), total_amount decimal(18,2)"
    ),
    "customers": "custid bigint, customer_city string, customer_state string, gender string",
    "products": "product_id bigint, category string",
    "stores": "storeid bigint, seller_city string, seller_state string, region string",
    "payments": "order_id bigint, payment_type string, payment_value decimal(18,2)",
    "reviews": "order_id bigint, customer_satisfaction_score int",
}

# Names under which the tables are offered to spark.sql().
SQL_NAMES: dict[str, str] = {
    "orders": "Orders",
    "customers": "Customers",
    "products": "Product_info",
    "stores": "stores_info",
    "payments": "OrderPayments",
    "reviews": "OrderReview_Ratings",
    "payment_summary": "ordpay_summary",
    "review_scores": "rev_avg_score",
}


@dataclass(frozen=True)
class RetailTables:
    """One DataFrame per table.

    ``orders`` has one row per order *line*. After repair it also carries ``correct_date`` (timestamp without zone)
    and ``new_total_amount``; ``payment_summary`` and ``review_scores`` exist only after repair.
    """

    orders: DataFrame
    customers: DataFrame
    products: DataFrame
    stores: DataFrame
    payments: DataFrame
    reviews: DataFrame
    payment_summary: DataFrame | None = None
    review_scores: DataFrame | None = None

    def present(self) -> dict[str, DataFrame]:
        return {name: df for name in SQL_NAMES if (df := getattr(self, name)) is not None}

    def register_views(self) -> None:
        """Make every table available to ``spark.sql`` under its SQL name."""
        for name, df in self.present().items():
            df.createOrReplaceTempView(SQL_NAMES[name])
