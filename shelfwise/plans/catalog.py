"""Every analysis by name, bound to the star tables of a folder: the registry behind ``__spark_entry__``."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from shelfwise.plans import basket, category, clean, customers, growth, kpi, late, quality, ratings, sales, sketches, views360
from shelfwise.plans.state import CustomerState
from shelfwise.sources.buckets import bucket_count, partition_by_rows, save_bucketed, write_by_key
from shelfwise.sources.session import tune
from shelfwise.sources.star import TABLES, mixed_case, star_tables
from shelfwise.sources.storage import dealt_by_one_key, listing, shared_dir, write_once
from shelfwise.tables import RetailTables

# The period the registered queries keep (inside the range of the test tables, so that some lines drop out).
START, END = "1995-02-01", "2001-06-30"
Query = Callable[[SparkSession, str], DataFrame]

def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, the type every result uses for money."""
    columns = [
        F.col(f"`{f.name}`").cast("double").alias(f.name) if isinstance(f.dataType, DecimalType) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ]
    return df.select(*columns)


class Bound:
    """The star tables of a folder as retail tables, and what queries have written of them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        # The order lines, a join of three star tables, are written: the import step. The others are cheap projections.
        # The join deals them out by order (payments are lines of the same table), and so they stay for all repairs.
        payments = star_tables(spark, sf_dir).payments
        self.rows = payments.count()
        partition_by_rows(spark, self.rows)
        self.buckets = bucket_count(payments, "order_id")
        built = star_tables(spark, sf_dir, self.buckets)
        lines = built.orders
        written = write_by_key(lines, "raw-orders", "order_id", self.buckets) if self.buckets else write_once(lines, "raw-orders")
        self.raw = replace(built, orders=written)
        self._written: dict[str, DataFrame] = {}

    @cached_property
    def clean(self) -> RetailTables:
        """The repaired tables: repaired and written on first use, then only read."""
        return clean.write_repaired(self.raw, START, END)

    @cached_property
    def folded(self) -> RetailTables:
        """The repaired tables with names in mixed spelling, brought to one spelling each and written."""
        names = clean.fold_names(mixed_case(self.clean))
        return replace(names, **{t: write_once(getattr(names, t), f"folded-{t}") for t in clean.NAMES})

    @cached_property
    def late_lines(self) -> DataFrame:
        """Repaired lines of a store to which the fifth and later lines of every order came in two late portions."""
        lines = self.raw.orders
        place = f"{shared_dir(lines.sparkSession)}/late-{uuid.uuid4().hex}"
        stored = late.store_lines(lines.filter("line_no < 5"), place, START, END)
        late.add_late_lines(stored, lines.filter("line_no > 5"))
        late.add_late_lines(stored, lines.filter("line_no = 5"))
        return stored.repaired.read()

    @cached_property
    def state(self) -> CustomerState:
        """State of first purchases, from one increment per quarter of the year, one of which comes twice, the middle ones merged."""
        lines = self.clean.orders
        held = CustomerState(lines.sparkSession, f"{shared_dir(lines.sparkSession)}/state-{uuid.uuid4().hex}")
        quarter = F.coalesce(F.quarter("correct_date"), F.lit(0))
        for n in (2, 3, 2):
            held.add(f"quarter{n}", lines.filter(quarter == n))
        held.compact("merged")
        for n in (4, 1, 0, 3):  # the first quarter is late, the third was merged before
            held.add(f"quarter{n}", lines.filter(quarter == n))
        return held

    def bucketed(self, key: str) -> RetailTables:
        """The repaired tables with lines bucketed by a key."""
        if key not in self._written:
            name, lines = f"lines_by_{key}_{uuid.uuid4().hex}", self.clean.orders
            buckets = bucket_count(lines, key)
            self._written[key] = save_bucketed(lines, name, key, buckets)[0] if buckets else write_once(lines, name, key)
        return replace(self.clean, orders=self._written[key])

    def _step(self, label: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A step of the repair chain that later ones read twice, dealt out by order like the raw lines."""
        if label not in self._written:
            step = build()
            self._written[label] = write_by_key(step, label, "order_id", self.buckets) if self.buckets else write_once(step, label)
        return self._written[label]

    def dated(self) -> DataFrame:
        """Raw lines with their dates; read anew from the texts each time, unless ``keep_dated`` was called."""
        return self._written.get("step-dated") or clean.parse_bill_dates(self.raw.orders)

    def keep_dated(self) -> None:
        """Write the dated lines, for queries that take them several times: reading the texts is most of their work."""
        self._step("step-dated", self.dated)

    def priced(self) -> DataFrame:
        """A filter and a product: cheaper to repeat than to write."""
        return clean.add_line_amount(clean.filter_date_range(self.dated(), START, END))

    def surplus(self) -> DataFrame:
        """What collapsing drops. Bucketed lines stay in their buckets when those that occur once are dropped."""
        with dealt_by_one_key(self.raw.orders.sparkSession) if self.buckets else contextlib.nullcontext():
            return clean.collapse_lines_preview(self.priced())

    def collapsed(self) -> DataFrame:
        return self._step("step-collapsed", lambda: clean.collapse_lines(self.priced()))

    def placed(self) -> DataFrame:
        return self._step("step-placed", lambda: clean.unify_store(self.collapsed()))

    def stamped(self) -> DataFrame:
        return self._step("step-stamped", lambda: clean.unify_timestamp(self.placed()))

    def summary(self) -> DataFrame:
        return clean.pivot_payments(self.raw.payments)


_BOUND: dict[tuple[str, str], tuple[str, Bound]] = {}


def bound(spark: SparkSession, sf_dir: str) -> Bound:
    """The tables of a folder in this application; bound anew when its files are no longer those of the last call."""
    key, now = (spark.sparkContext.applicationId, sf_dir), listing(spark, sf_dir, TABLES)
    if _BOUND.get(key, ("",))[0] != now:
        _BOUND[key] = (now, Bound(spark, sf_dir))
    held = _BOUND[key][1]
    partition_by_rows(spark, held.rows)
    return held


REPAIRS: dict[str, Callable[[Bound], DataFrame]] = {
    "c01_parse_bill_dates": lambda r: r.dated(),
    "c02_filter_date_range": lambda r: clean.filter_date_range(r.dated(), START, END),
    "c03_dedupe_stores": lambda r: clean.dedupe_stores(r.raw.stores),
    "c04_list_categories": lambda r: clean.list_categories(r.raw.products),
    "c04_fix_category": lambda r: clean.fix_category(r.raw.products),
    "c05_pivot_payments": lambda r: r.summary(),
    "c06_average_review": lambda r: clean.average_review(r.raw.reviews),
    "c06_average_review_integer": lambda r: clean.average_review(r.raw.reviews, integer_averages=True),
    "c07_add_line_amount": lambda r: r.priced(),
    "c08_audit_amounts": lambda r: clean.audit_amounts(r.priced(), r.summary()),
    "c09_collapse_lines": lambda r: r.collapsed(),
    "c10_unify_store": lambda r: r.placed(),
    "c11_unify_timestamp": lambda r: r.stamped(),
    "c12_drop_orphan_payments": lambda r: clean.drop_orphan_payments(r.summary(), r.stamped()),
    "c13_unify_customer": lambda r: clean.unify_customer(r.stamped()),
}

# What each repair would change (the source's "to check" half).
PREVIEWS: dict[str, Callable[[Bound], DataFrame]] = {
    "c02_outside_period": lambda r: clean.filter_date_range_preview(r.dated(), START, END),
    "c03_duplicate_stores": lambda r: clean.dedupe_stores_preview(r.raw.stores),
    "c04_category_changes": lambda r: clean.fix_category_preview(r.raw.products),
    "c09_surplus_lines": lambda r: r.surplus(),
    "c10_store_changes": lambda r: clean.unify_store_preview(r.collapsed()),
    "c11_timestamp_changes": lambda r: clean.unify_timestamp_preview(r.placed()),
    "c12_orphan_payments": lambda r: clean.drop_orphan_payments_preview(r.summary(), r.stamped()),
    "c13_customer_changes": lambda r: clean.unify_customer_preview(r.stamped()),
}


def _repair_counts(steps: Bound) -> DataFrame:
    steps.keep_dated()
    counts = [
        clean.changed_rows(build(steps)).select(F.lit(name).alias("repair"), "rows_affected")
        for name, build in PREVIEWS.items()
    ]
    return reduce(DataFrame.unionByName, counts)


ANALYSES: dict[str, Callable[[RetailTables], DataFrame]] = {
    "clean_all_orders": lambda t: t.orders,
    "v1_store360": lambda t: views360.store360(t.orders, t.products, t.stores, t.review_scores),
    "v1_store360_integer": lambda t: views360.store360(
        t.orders, t.products, t.stores, clean.average_review(t.reviews, integer_averages=True), integer_averages=True
    ),
    "v3_customer360_integer": lambda t: views360.customer360(
        t.customers, t.orders, t.products, t.payment_summary, t.stores, t.reviews, integer_averages=True
    ),
    "v2_orders360": lambda t: views360.orders360(t.orders, t.products),
    "v3_customer360": lambda t: views360.customer360(
        t.customers, t.orders, t.products, t.payment_summary, t.stores, t.reviews
    ),
    "v3_customer360_corrected": lambda t: views360.customer360(
        t.customers,
        t.orders,
        t.products,
        t.payment_summary,
        t.stores,
        t.reviews,
        dedupe_reviews=True,
        first_purchase_only=True,
    ),
    "v3_customer360_percentile_segments": lambda t: views360.customer360(
        t.customers, t.orders, t.products, t.payment_summary, t.stores, t.reviews, percentile_segments=True
    ),
    "kpi_summary": kpi.kpi_summary,
    "g1_new_customers_by_month": lambda t: growth.new_customers_by_month(t.orders),
    "g2_monthly_retention": lambda t: growth.monthly_retention(t.orders),
    "g3_new_vs_existing_revenue": lambda t: growth.new_vs_existing_revenue(t.orders),
    "h1_cohorts": lambda t: growth.cohorts(t.orders),
    "l1_sales_trend": lambda t: sales.sales_trend(t.orders, t.products, t.stores, t.payments),
    "l1_sales_trend_share_weighted": lambda t: sales.sales_trend(
        t.orders, t.products, t.stores, t.payments, share_weighted=True
    ),
    "l2_popular_products": lambda t: sales.popular_products(t.orders, t.products, t.stores),
    "l3_most_expensive_products": lambda t: sales.most_expensive_products(t.orders, t.products),
    "l4_sold_products": lambda t: sales.sold_products(t.orders, t.products),
    "l5_top_bottom_stores": lambda t: sales.top_bottom_stores(t.orders, t.stores),
    "l6_top_bottom_products": lambda t: sales.top_bottom_products(t.orders, t.products),
    "l7_store_category_performance": lambda t: sales.store_category_performance(t.orders, t.products, t.stores),
    "t1_monthly_sales_share": lambda t: sales.monthly_sales_share(t.orders),
    "t2_monthly_sales": lambda t: sales.monthly_sales(t.orders),
    "t3_weekday_sales": lambda t: sales.weekday_sales(t.orders),
    "t4_revenue_per_unit_by_store": lambda t: sales.revenue_per_unit_by_store(t.orders, t.stores),
    "p01_pareto_categories": lambda t: sales.pareto(t.orders, t.products, "category"),
    "p01_pareto_products": lambda t: sales.pareto(t.orders, t.products, "product_id"),
    "p01_pareto_stores": lambda t: sales.pareto(t.orders, t.products, "storeid"),
    "p03_region_share": lambda t: sales.region_share(t.orders, t.stores, "region"),
    "p03_state_share": lambda t: sales.region_share(t.orders, t.stores, "seller_state"),
    "p04_payment_mix": lambda t: sales.payment_mix(t.payments),
    "p04_store_payment_mix": lambda t: sales.store_payment_mix(t.orders, t.payment_summary),
    "b1_revenue_bands": lambda t: customers.revenue_bands(t.orders, t.customers),
    "b2_rfm_segments": lambda t: customers.rfm_segments(t.orders),
    "b2_rfm_segments_best_is_high": lambda t: customers.rfm_segments(t.orders, best_is_high=True),
    "b3_all_channel_customers": lambda t: customers.all_channel_customers(t.orders),
    "b4_buyer_types": lambda t: customers.buyer_types(t.orders),
    "b5_discount_seekers": lambda t: customers.discount_seekers(t.orders),
    "b6_customer_preferences": lambda t: customers.customer_preferences(t.orders, t.payments, t.products),
    "b7_category_breadth": lambda t: customers.category_breadth(t.orders, t.products),
    "p02_gender_patterns": lambda t: customers.gender_patterns(t.orders, t.customers),
    "p05_discount_class": lambda t: views360.discount_class(t.orders),
    "p06_weekday_weekend_customers": lambda t: customers.weekday_weekend_customers(t.orders),
    "p07_rfm_contribution": lambda t: customers.rfm_contribution(t.orders),
    "p10_orders360_feedback": lambda t: views360.orders360_feedback(t.orders, t.products, t.review_scores),
    "a1_category_sales": lambda t: category.category_sales(t.orders, t.products),
    "a2_category_profit": lambda t: category.category_profit(t.orders, t.products),
    "a3_category_penetration": lambda t: category.category_penetration(t.orders, t.products),
    "a4_categories_per_bill_by_state": lambda t: category.categories_per_bill(
        t.orders, t.products, t.stores, "seller_state"
    ),
    "a5_categories_per_bill_by_region": lambda t: category.categories_per_bill(t.orders, t.products, t.stores, "region"),
    "a6_first_purchase_categories": lambda t: category.first_purchase_categories(t.orders, t.products),
    "x1_category_pairs": lambda t: basket.category_pairs(t.orders, t.products),
    "x1_category_pairs_unordered": lambda t: basket.category_pairs(t.orders, t.products, unordered=True),
    "k29_distinct_counts_by_month": lambda t: sketches.distinct_counts_by_month(t.orders),
    "x2_category_triples": lambda t: basket.category_triples(t.orders, t.products),
    "x2_category_triples_unordered": lambda t: basket.category_triples(t.orders, t.products, unordered=True),
}
ANALYSES |= {
    f"kpi_{name.lower()}": (lambda t, name=name: kpi.kpi(name, t))  # each KPI as its own 1-row query
    for name in kpi.KPIS
}

# The same analyses over names in mixed spelling, folded on load.
FOLDED = (
    "v1_store360", "l1_sales_trend", "a1_category_sales", "a2_category_profit", "a3_category_penetration",
    "a4_categories_per_bill_by_state", "a5_categories_per_bill_by_region", "a6_first_purchase_categories",
    "p02_gender_patterns", "p03_region_share", "p03_state_share",
)

# Analyses over tables that are stored in another way; they give the results of those they are named after.
STORED: dict[str, Callable[[Bound], DataFrame]] = {
    "clean_all_orders_late_lines": lambda b: b.late_lines,
    "g1_new_customers_by_month_state": lambda b: growth.new_customers_by_month(b.state.firsts()),
    "g3_new_vs_existing_revenue_state": lambda b: growth.new_vs_existing_revenue(b.state.sums()),
    "h1_cohorts_state": lambda b: growth.cohorts(b.state.sums()),
    "a6_first_purchase_categories_state": lambda b: category.first_purchase_categories(b.state.firsts(), b.clean.products),
    "v2_orders360_bucketed": lambda b: ANALYSES["v2_orders360"](b.bucketed("order_id")),
    "x1_category_pairs_bucketed": lambda b: ANALYSES["x1_category_pairs"](b.bucketed("order_id")),
    "b6_customer_preferences_bucketed": lambda b: ANALYSES["b6_customer_preferences"](b.bucketed("customer_id")),
    **{f"{name}_folded": (lambda b, name=name: ANALYSES[name](b.folded)) for name in FOLDED},
}

for _number, _by in enumerate(ratings.DIMENSIONS, start=1):
    ANALYSES[f"r{_number}_average_rating_by_{_by}"] = lambda t, by=_by: ratings.average_rating(
        t.orders, t.reviews, by, t.products, t.customers
    )
    ANALYSES[f"p08_rating_extremes_by_{_by}"] = lambda t, by=_by: ratings.rating_extremes(
        t.orders, t.reviews, by, t.products, t.customers
    )


def all_queries() -> dict[str, Query]:
    def repair(build: Callable[[Bound], DataFrame]) -> Query:
        return lambda spark, sf_dir: plain(build(bound(tune(spark), sf_dir)))

    def analysis(build: Callable[[RetailTables], DataFrame]) -> Query:
        return lambda spark, sf_dir: plain(build(bound(tune(spark), sf_dir).clean))

    return {
        **{name: repair(build) for name, build in REPAIRS.items()},
        **{name: repair(build) for name, build in PREVIEWS.items()},
        "repair_counts": repair(_repair_counts),
        **{name: analysis(build) for name, build in ANALYSES.items()},
        **{name: repair(build) for name, build in STORED.items()},
        "p09_quality_profile": repair(lambda r: quality.quality_profile(r.raw)),
    }
