"""Hand-made rows for the traps, and invariants over the smallest test data."""

from dataclasses import replace
from decimal import Decimal

import pytest
from conftest import rows
from pyspark.sql import functions as F

from shelfwise.functions.columns import percent2, ratio2
from shelfwise.plans import catalog, category, clean, customers, growth, kpi, quality, ratings, sales, views360
from shelfwise.tables import RetailTables

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small(spark):
    return catalog.bound(spark, SMALL).clean


@pytest.fixture(scope="module")
def tiny(make):
    """Two stores, one unknown; customers 1-4 of whom 4 never buys; order 3 has no payment and no review."""
    lines = make.lines(
        {"order": 1, "cust": 1, "prod": 1, "store": 1, "qty": 2, "discount": 1, "ts": "2022-01-01 07:00:00"},
        {"order": 1, "cust": 1, "prod": 2, "store": 1, "qty": 1, "ts": "2022-01-01 07:00:00"},
        {"order": 2, "cust": 1, "prod": 3, "store": 99, "qty": 1, "cost": 20, "ts": "2022-03-02 19:00:00"},
        {"order": 3, "cust": 2, "prod": 1, "store": 2, "qty": 1, "channel": "Instore", "ts": None},
        {"order": 4, "cust": 3, "prod": 9, "store": 2, "qty": 1, "channel": "instore", "ts": "2022-02-07 17:00:00"},
    )
    payments = make.table(
        "payments",
        [(1, "Voucher", Decimal(10)), (1, "Credit_card", Decimal(18)), (2, "Debit_card", Decimal(10)),
         (4, "UPI/Cash", Decimal(10))],
    )
    reviews = make.table("reviews", [(1, 5), (1, 2), (2, None), (4, 3)])
    return RetailTables(
        orders=lines,
        customers=make.table("customers", [(i, "city", f"state{i % 2}", "F" if i < 3 else "M") for i in range(1, 5)]),
        products=make.table("products", [(1, "A"), (2, "B"), (3, None)]),
        stores=make.table("stores", [(1, "x", "s", "North"), (2, "y", "s", "South"), (3, "z", "t", "South")]),
        payments=payments,
        reviews=reviews,
        payment_summary=clean.pivot_payments(payments),
        review_scores=clean.average_review(reviews),
    )


def customer_view(t, **options):
    df = views360.customer360(t.customers, t.orders, t.products, t.payment_summary, t.stores, t.reviews, **options)
    return {r.custid: r for r in df.collect()}


def test_exact_rounding(spark):
    cases = [(201, 20000, 1.01), (-201, 20000, -1.01), (201, -20000, -1.01), (1, 3, 33.33), (1, 0, None), (None, 5, None)]
    df = spark.createDataFrame([(i, n, d) for i, (n, d, _) in enumerate(cases)], "i int, n int, d int")
    got = dict(df.select("i", percent2(F.col("n"), F.col("d"))).collect())
    assert [got[i] for i in range(len(cases))] == [c[2] for c in cases]
    assert df.filter("i = 3").select(ratio2(F.col("n") * 8, F.col("d"), truncate=True)).first()[0] == 2.0


def test_revenue_bands(make):
    amounts = ["2999.99", "3000", "5999", "5999.5", "6000"]
    lines = make.lines(*[{"cust": i, "amount": a} for i, a in enumerate(amounts, start=1)])
    people = make.table("customers", [(i, "c", "s", "F") for i in range(1, 5)])
    got = rows(customers.revenue_bands(lines, people), "Total_Revenue", "Custid", "Customer_Segment")
    assert got == [
        (2999.99, 1, "Low Value"), (3000.0, 2, "Medium Value"), (5999.0, 3, "Medium Value"), (5999.5, 4, "Low Value"),
        (6000.0, None, "High Value"),
    ]


def test_cohort_without_return_has_null_sums(make):
    lines = make.lines(
        {"cust": 1, "order": 1, "ts": "2022-01-31"}, {"cust": 1, "order": 2, "ts": "2022-02-01"},
        {"cust": 2, "order": 3, "ts": "2022-05-01"}, {"cust": 3, "order": 4, "ts": None}, {"cust": None, "order": 5},
    )
    got = {r.Cohort_Month: tuple(r)[1:] for r in growth.cohorts(lines).collect()}
    assert got == {
        "2022-01": (1, 1, 100.0, 1.0, 1, 10.0, 1, 10.0),
        "2022-05": (1, 0, 0.0, None, 1, 10.0, None, None),
        None: (1, 0, 0.0, None, None, None, None, None),
    }


def test_retention_and_new_customers(make):
    lines = make.lines(
        {"cust": 1, "ts": "2021-12-31"}, {"cust": 1, "ts": "2022-01-01"}, {"cust": 2, "ts": "2021-12-05"},
        {"cust": 2, "ts": "2022-02-05"}, {"cust": 3, "ts": None},
    )
    assert rows(growth.monthly_retention(lines)) == [
        (None, 1, 0, 0.0), ("2021-12", 2, 1, 50.0), ("2022-01", 1, 0, 0.0), ("2022-02", 1, 0, 0.0),
    ]
    assert rows(growth.new_customers_by_month(lines)) == [("2021-12", 2)]
    split = rows(growth.new_vs_existing_revenue(lines))
    assert (None, "Existing Customer", 10.0) in split and ("2022-01", "Existing Customer", 10.0) in split


def test_days_between_equals_lag(make):
    from pyspark.sql import Window

    stamps = ["2022-01-01 23:00:00", "2022-01-02 01:00:00", "2022-01-09", None, "2022-01-02 05:00:00"]
    lines = make.lines(*[{"cust": i % 2, "ts": s} for i, s in enumerate(stamps * 3)])
    before = F.lag("correct_date").over(Window.partitionBy("customer_id").orderBy("correct_date"))
    gap = F.date_diff(F.col("correct_date").cast("date"), before.cast("date"))
    want = lines.select(gap.alias("g")).agg(F.sum("g"), F.count("g")).first()
    got = kpi.transaction_gaps(lines).agg(F.sum("days"), F.sum("gaps")).first()
    assert tuple(got) == tuple(want)


def test_store_view_of_unknown_stores(tiny):
    got = {r.storeid: r for r in views360.store360(tiny.orders, tiny.products, tiny.stores, tiny.review_scores).collect()}
    assert set(got) == {1, 2, None}
    assert (got[None].Weekend_Sales, got[None].Weekday_Sales) == (0.0, 0.0)
    assert got[None].Average_Order_Value is None and got[None].Average_Customer_Visits is None
    assert got[None].Total_Amount == 10.0 and got[None].Flag_Loss_Making == 1
    assert got[1].Weekend_Sales == 28.0 and got[1].Average_Order_Value == 28.0 and got[1].Weekend_Trans_Flag == 1
    assert got[1].Average_Rating_Per_Customer == 3.5
    assert got[2].Average_Customer_Visits == 1.0 and got[2].Distinct_Categories == 1


def test_order_view_bands(tiny):
    got = {r.order_id: r for r in views360.orders360(tiny.orders, tiny.products).collect()}
    assert [got[i].Hours_Flag for i in (1, 2, 3, 4)] == ["Morning", "Evening", "Night", "Evening"]
    assert [got[i].Weekend_Trans_Flag for i in (1, 2, 3, 4)] == ["Saturday", "Weekday", "Weekday", "Weekday"]
    assert got[2].Flag_Loss_Making == "Negative" and got[1].Orders_with_High_Profit == "High"
    assert got[1].Distinct_Categories == 2 and got[2].Distinct_Categories == 0
    linked = views360.orders360_feedback(tiny.orders, tiny.products, tiny.review_scores)
    assert {r.order_id: r.average_score for r in linked.collect()} == {1: 3.5, 2: None, 3: None, 4: 3.0}


def test_customer_view(tiny):
    got = customer_view(tiny)
    assert set(got) == {1, 2, 3}  # customer 4 bought nothing, yet counts for the spend segments
    one = got[1]
    assert one.Transactions_with_Discount == 2  # one discounted line, repeated by two reviews
    assert one.Transactions_Paid_with_Voucher == 4 and one.Transactions_Paid_with_Debit_Card == 1
    # Voucher ties with credit card and so loses; credit card need only beat the kinds after it.
    assert one.Preferred_Payment_Method == "Credit Card"
    assert one.Different_Payment_Types == 2 and one.Distinct_Stores == 2 and one.Distinct_Cities == 1
    assert one.First_Purchase_Qty == 7 and one.Frequency == 2 and one.Monetary == 38.0
    assert one.Average_Satisfaction_Score == 3.5 and one.Inactive_Days == 0
    assert got[2].Preferred_Payment_Method == "UPI" and got[2].Different_Payment_Types == 0
    assert got[2].Inactive_Days is None and got[3].Distinct_Categories_Purchased == 0
    assert {c: r.Customer_Segment for c, r in got.items()} == {1: "High", 2: "Low", 3: "Medium"}


def test_customer_view_corrected(tiny):
    got = customer_view(tiny, dedupe_reviews=True, first_purchase_only=True)
    assert set(got) == {1, 2, 3}  # customer 2 has no dated line, hence no first purchase, and stays
    assert [got[2][c] for c in got[2].asDict() if c.startswith("First_Purchase")] == [None] * 4
    assert got[2].Total_Quantity == 1 and got[3].First_Purchase_Distinct_Categories == 0
    assert got[1].Transactions_with_Discount == 1 and got[1].First_Purchase_Qty == 3
    assert got[1].First_Purchase_Distinct_Items == 2 and got[1].Distinct_Items_Purchased == 3


def test_customer_listed_twice_comes_out_once(tiny, make):
    again = tiny.customers.unionByName(make.table("customers", [(1, "another city", "state9", "M")] * 3))
    twice = customer_view(replace(tiny, customers=again))
    once = customer_view(tiny)
    assert {c: r.Customer_Segment for c, r in twice.items()} == {c: r.Customer_Segment for c, r in once.items()}
    view = views360.customer360(again, tiny.orders, tiny.products, tiny.payment_summary, tiny.stores, tiny.reviews)
    assert view.count() == 3


def test_percentile_segments_keep_equal_spends_together(make, tiny):
    lines = make.lines(*[{"order": i, "cust": i % 4 + 1, "amount": 10, "nta": 10} for i in range(4)])
    view = views360.customer360(
        tiny.customers, lines, tiny.products, tiny.payment_summary, tiny.stores, tiny.reviews, percentile_segments=True
    )
    assert {r.Customer_Segment for r in view.collect()} == {"Low"}


def test_payment_types_in_any_spelling(make, tiny):
    pay = make.table(
        "payments",
        [(1, "Voucher", Decimal(1)), (1, "voucher", Decimal(2)), (2, "VOUCHER", Decimal(3)), (2, "Debit_card", Decimal(4))],
    )
    assert rows(sales.payment_mix(pay)) == [("Debit_card", 1, 4.0, 40.0), ("VOUCHER", 2, 6.0, 60.0)]
    cards = make.table(
        "payments",
        [(1, "Credit_card", Decimal(1)), (1, "credit_card", Decimal(1)), (1, "Debit_card", Decimal(1)), (1, "Debit_card", Decimal(1))],
    )
    got = {r.customer_id: r for r in customers.customer_preferences(tiny.orders, cards, tiny.products).collect()}
    assert got[1].preferred_payment_method == "Credit_card"


def test_labels_follow_k(tiny):
    assert set(r.Category for r in sales.top_bottom_stores(tiny.orders, tiny.stores, k=2).collect()) == {"Top 2", "Bottom 2"}
    best = sales.top_bottom_products(tiny.orders, tiny.products, k=1).collect()
    assert sorted((r.Category, r.Product_ID) for r in best) == [("Bottom 1", 2), ("Top 1", 1)]


def test_store_category_performance(tiny):
    got = {(r.StoreID, r.Product_Category): r for r in sales.store_category_performance(tiny.orders, tiny.products, tiny.stores).collect()}
    assert set(got) == {(1, "A"), (1, "B"), (None, None), (2, "A"), (2, None)}
    assert got[1, "A"].Orders == 1 and got[1, "A"].Total_Sales == 18.0 and got[2, "A"].Sales_Percentage_of_Store == 50.0
    assert got[1, "B"].Sales_Percentage_of_Store == 35.71


def test_share_weighted_trend_adds_up(tiny):
    trend = sales.sales_trend(tiny.orders, tiny.products, tiny.stores, tiny.payments, share_weighted=True)
    total = tiny.orders.agg(F.sum("total_amount")).first()[0]
    assert abs(trend.agg(F.sum("Total_Sales")).first()[0] - float(total)) < 1e-4


@pytest.mark.parametrize("numbered", [True, False])
@pytest.mark.parametrize("even", [True, False])
def test_trend_in_every_layout(make, tiny, monkeypatch, numbered, even):
    """Lists of payment types numbered or not, keys dealt out or hot: payments and lines without key or type, lines without payment."""
    monkeypatch.setattr(sales, "MOST_MIXES", 10_000 if numbered else 0)
    if not even:
        monkeypatch.setattr(sales, "bucket_count", lambda *_: None)
    lines = make.lines(
        {"order": 1, "prod": 1, "store": 1, "qty": 2}, {"order": 1, "prod": 1, "store": 1, "qty": 3, "channel": "ONLINE"},
        {"order": 2, "prod": 2, "store": 98, "qty": 1}, {"order": 3, "prod": 2, "store": 99, "qty": 4},
        {"order": 4, "prod": 7, "store": None, "qty": 1, "ts": None}, {"order": None, "prod": None, "store": 2, "qty": 5},
        {"order": 5, "prod": 1, "store": 2, "qty": None, "amount": None},
    )
    pay = make.table(
        "payments",
        [(1, "Voucher", Decimal(1)), (1, "voucher", Decimal(2)), (1, "Debit_card", Decimal(4)), (1, None, Decimal(1)),
         (2, "Voucher", Decimal(0)), (2, "Voucher", None), (3, "Voucher", Decimal(9)), (None, "Voucher", Decimal(9)),
         (4, None, None), (4, None, Decimal(3)), (5, "Voucher", Decimal(1)), (6, "Voucher", Decimal(1))],
    )
    got = sales.sales_trend(lines, tiny.products, tiny.stores, pay)
    month, key = "2022-01", lambda r: tuple((v is not None, str(v)) for v in r)
    assert rows(got) == sorted(
        [
            (month, "A", "North", 1, "ONLINE", "Voucher", 100.0, 10),
            (month, "A", "North", 1, "ONLINE", "Debit_card", 50.0, 5),
            (month, "A", "North", 1, "ONLINE", None, 50.0, 5),
            (month, "B", None, None, "Online", "Voucher", 60.0, 6),
            (None, None, None, None, "Online", None, 20.0, 2),
            (month, None, "South", 2, "Online", None, 50.0, 5),
            (month, "A", "South", 2, "Online", "Voucher", None, None),
        ],
        key=key,
    )
    shares = sales.sales_trend(lines, tiny.products, tiny.stores, pay, share_weighted=True)
    assert rows(shares) == sorted(
        [
            (month, "A", "North", 1, "ONLINE", "Voucher", 18.75, 1.875),
            (month, "A", "North", 1, "ONLINE", "Debit_card", 25.0, 2.5),
            (month, "A", "North", 1, "ONLINE", None, 6.25, 0.625),
            (month, "B", None, None, "Online", "Voucher", 50.0, 5.0),
            (None, None, None, None, "Online", None, 10.0, 1.0),
            (month, None, "South", 2, "Online", None, 50.0, 5.0),
            (month, "A", "South", 2, "Online", "Voucher", None, None),
        ],
        key=key,
    )


def test_tied_debit_falls_to_upi(make, tiny):
    lines = make.lines({"order": 1, "cust": 1})
    pay = clean.pivot_payments(make.table("payments", [(1, "UPI/Cash", Decimal(1)), (1, "Debit_card", Decimal(1))]))
    view = views360.customer360(tiny.customers, lines, tiny.products, pay, tiny.stores, tiny.reviews)
    assert view.first().Preferred_Payment_Method == "UPI"


def test_few_stores_are_top_and_bottom(make, tiny):
    lines = make.lines({"store": 1, "amount": None}, {"store": 2, "amount": 5}, {"store": 99, "amount": 7})
    got = sales.top_bottom_stores(lines, tiny.stores)
    assert rows(got, "Category", "StoreID", "Total_Sales") == sorted(
        [(c, s, t) for c in ("Bottom 10", "Top 10") for s, t in ((1, None), (2, 5.0), (None, 7.0))],
        key=lambda r: tuple((v is not None, str(v)) for v in r),
    )
    worst = sales.top_bottom_stores(lines, tiny.stores, k=1)
    assert rows(worst, "Category", "StoreID") == [("Bottom 1", 1), ("Top 1", None)]


def test_sales_repeat_per_payment_unless_weighted(tiny):
    repeated = sales.sales_trend(tiny.orders, tiny.products, tiny.stores, tiny.payments)
    assert repeated.agg(F.sum("Total_Sales")).first()[0] == 90.0
    weighted = sales.sales_trend(tiny.orders, tiny.products, tiny.stores, tiny.payments, share_weighted=True)
    assert weighted.agg(F.round(F.sum("Total_Sales"), 6)).first()[0] == 60.0
    assert {r.Channel for r in repeated.collect()} == {"Online", "Instore", "instore"}


def test_ranks_have_gaps(make, tiny):
    lines = make.lines(
        *[{"prod": p, "store": 1, "qty": q} for p, q in ((1, 5), (2, 5), (3, 4))], {"prod": 9, "store": 1, "qty": 9}
    )
    got = sales.popular_products(lines, tiny.products, tiny.stores)
    assert rows(got, "product_id", "Category_Rank") == [(None, 1), (1, 2), (2, 2), (3, 4)]


def test_preferences_and_channels(tiny):
    got = {r.customer_id: r for r in customers.customer_preferences(tiny.orders, tiny.payments, tiny.products).collect()}
    assert got[1].preferred_payment_method == "Credit_card"  # two lines each for both kinds: smallest name
    assert got[1].discount_preference == "Discount Lover" and got[2].discount_preference == "Non-Discount Buyer"
    assert got[2].preferred_payment_method is None and got[3].preferred_category is None
    assert kpi.kpi("Total_Channels", tiny).first()[0] == 2
    assert customers.all_channel_customers(tiny.orders).count() == 0


def test_ratings_weigh_by_lines(tiny):
    got = rows(ratings.average_rating(tiny.orders, tiny.reviews, "month"))
    assert got == [("2022-01", 3.5, 4), ("2022-02", 3.0, 1)]
    assert rows(ratings.average_rating(tiny.orders, tiny.reviews, "category", tiny.products)) == [("A", 3.5, 2), ("B", 3.5, 2)]
    whole = ratings.average_rating(tiny.orders, tiny.reviews, "month", integer_averages=True)
    assert rows(whole, "Avg_Rating") == [(3.0,), (3.0,)]
    extremes = ratings.rating_extremes(tiny.orders, tiny.reviews, "store")
    assert rows(extremes) == [(1, 5, 2, 3.5, 4), (2, 3, 3, 3.0, 1)]


def test_zero_denominators_give_null(make):
    free = make.lines({"qty": 0, "mrp": 0, "amount": 0})
    nothing = make.lines({"qty": 1, "mrp": 0}).filter("false")
    for lines in (free, nothing):
        tables = RetailTables(lines, *[make.table(n, []) for n in ("customers", "products", "stores", "payments", "reviews")])
        row = kpi.kpi_summary(tables).first()
        assert row.Profit_Percentage is None and row.Discount_Percentage is None
        assert row.Avg_Days_Between_Transactions is None
        assert sales.monthly_sales_share(lines).filter("Percentage_Contribution is not null").count() == 0
        assert category.category_sales(lines, tables.products).count() == 0
        assert customers.rfm_segments(lines).count() == lines.count()


def test_quality_profile_counts(make):
    orders = make.lines({"text": "n/a", "prod": 5}, {"text": "01/02/2022", "prod": 5}, {"text": None, "cust": None})
    tables = RetailTables(
        orders.drop("correct_date", "new_total_amount"),
        make.table("customers", [(1, "c", "s", None)]),
        make.table("products", [(5, "#N/A")]),
        make.table("stores", [(1, "a", "s", "r"), (1, "b", "s", "r"), (1, "c", "s", "r")]),
        make.table("payments", [(1, "Voucher", Decimal(1)), (8, "Voucher", Decimal(1)), (8, "Voucher", None)]),
        make.table("reviews", []),
    )
    got = {(r.table, r.rule, r.column): r.rows for r in quality.quality_profile(tables).collect()}
    assert got["orders", "missing", "customer_id"] == 1 and got["customers", "missing", "gender"] == 1
    assert got["orders", "duplicate", "order_id+product_id"] == 1 and got["stores", "duplicate", "storeid"] == 2
    assert got["orders", "unreadable", "bill_date_timestamp"] == 1 and got["products", "placeholder", "category"] == 1
    assert got["payments", "orphan", "order_id"] == 2 and got["orders", "orphan", "product_id"] == 1


def test_invariants(small):
    one, many, customers_total = (
        kpi.kpi(n, small).first()[0]
        for n in ("One_Time_Buyers_Percentage", "Repeat_Purchase_Rate", "Total_Customers")
    )
    assert one + many == pytest.approx(100, abs=0.011)
    cohorts = growth.cohorts(small.orders)
    assert cohorts.agg(F.sum("Cohort_Customers")).first()[0] == customers_total
    segments = customers.rfm_contribution(small.orders).agg(F.sum("customers"), F.sum("sales_pct")).first()
    assert segments[0] == customers_total and segments[1] == pytest.approx(100, abs=0.05)
    curve = sales.pareto(small.orders, small.products, "product_id").orderBy("cumulative_item_pct").collect()
    shares = [r.cumulative_sales_pct for r in curve]
    assert shares == sorted(shares) and shares[-1] == 100 and curve[-1].cumulative_item_pct == 100
    profit = category.category_profit(small.orders, small.products)
    assert profit.agg(F.sum("Profit_Contribution_Percentage")).first()[0] == pytest.approx(100, abs=0.05)


def test_summary_equals_single_kpis(small):
    summary = kpi.kpi_summary(small).first().asDict()
    assert list(summary) == list(kpi.KPIS)
    for name in ("Total_Orders", "Average_Order_Value", "Avg_Categories_Per_Order", "Repeat_Purchase_Rate"):
        assert kpi.kpi(name, small).first()[0] == summary[name]


def test_first_purchase_categories(tiny):
    assert rows(category.first_purchase_categories(tiny.orders, tiny.products)) == [("A", 1, 1), ("B", 1, 1)]
