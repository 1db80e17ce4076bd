"""The check query per registered name."""

from __future__ import annotations

import re

from shelfwise.oracle.base import (
    COST,
    DATED_LINE,
    END,
    LINE,
    MONTH,
    PAYMENT_SUMMARY,
    PROFIT,
    RAW_LINE,
    START,
    big,
    dbl,
    folded,
    pct2,
    ratio2,
    with_tables,
)
from shelfwise.plans.catalog import STORED

NTA = "new_total_amount"


def _repair() -> dict[str, str]:
    flagged = "fixable AND {0} <> {1}"
    previews = {
        "c02_outside_period": (
            "l1",
            f"SELECT {DATED_LINE} FROM l1 WHERE NOT correct_date BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'",
        ),
        "c03_duplicate_stores": (
            "s0",
            """SELECT *, row_number() OVER (PARTITION BY storeid ORDER BY seller_city, seller_state, region) AS rn
               FROM s0 QUALIFY rn > 1""",
        ),
        "c04_category_changes": (
            "p0", "SELECT *, 'Others' AS new_category FROM p0 WHERE lower(category) = '#n/a'",
        ),
        "c09_surplus_lines": ("l9n", f"SELECT {LINE}, rn FROM l9n WHERE rn > 1"),
        "c10_store_changes": (
            "l10n",
            f"SELECT {LINE}, PreferredStore FROM l10n WHERE {flagged.format('delivered_storeid', 'PreferredStore')}",
        ),
        "c11_timestamp_changes": (
            "l11n",
            f"SELECT {LINE}, FirstBillTS FROM l11n WHERE {flagged.format('correct_date', 'FirstBillTS')}",
        ),
        "c12_orphan_payments": (
            "ops1 l11",
            f"SELECT {PAYMENT_SUMMARY} FROM ops1 ANTI JOIN l11 USING (order_id)",
        ),
        "c13_customer_changes": (
            "l13n",
            """SELECT order_id, customer_id AS old_customer_id, winner AS new_customer_id FROM l13n WHERE conflict""",
        ),
    }
    counts = " UNION ALL ".join(
        f"SELECT '{name}' AS repair, count(*) AS rows_affected FROM ({sql})" for name, (_, sql) in previews.items()
    )
    needs = " ".join(n for n, _ in previews.values())
    return {
        "c01_parse_bill_dates": with_tables("l1", f"SELECT {DATED_LINE} FROM l1"),
        "c02_filter_date_range": with_tables("l2", f"SELECT {DATED_LINE} FROM l2"),
        "c03_dedupe_stores": with_tables("s", "SELECT * FROM s"),
        "c04_list_categories": with_tables("p0", "SELECT DISTINCT category FROM p0"),
        "c04_fix_category": with_tables("p", "SELECT * FROM p"),
        "c05_pivot_payments": with_tables("ops1", f"SELECT {PAYMENT_SUMMARY} FROM ops1"),
        "c06_average_review": with_tables("ras", "SELECT * FROM ras"),
        "c06_average_review_integer": with_tables(
            "rev",
            """SELECT order_id, CAST(sum(customer_satisfaction_score) // count(customer_satisfaction_score) AS DOUBLE)
                   AS average_score FROM rev GROUP BY order_id""",
        ),
        "c07_add_line_amount": with_tables("l7", f"SELECT {LINE} FROM l7"),
        "c08_audit_amounts": with_tables(
            "l7 ops1",
            f"""SELECT order_id, {dbl('sum_ta')} AS sum_ta, {dbl('pd_amt')} AS pd_amt,
                       {dbl('abs(pd_amt - sum_ta)')} AS diff
                FROM (SELECT order_id, sum(total_amount)::DECIMAL(28,2) AS sum_ta FROM l7 GROUP BY ALL)
                JOIN (SELECT order_id, Total_Amount::DECIMAL(28,2) AS pd_amt FROM ops1) USING (order_id)
                WHERE abs(pd_amt - sum_ta) > 1""",
        ),
        "c09_collapse_lines": with_tables("l9", f"SELECT {LINE} FROM l9"),
        "c10_unify_store": with_tables("l10", f"SELECT {LINE} FROM l10"),
        "c11_unify_timestamp": with_tables("l11", f"SELECT {LINE} FROM l11"),
        "c12_drop_orphan_payments": with_tables("ops", f"SELECT {PAYMENT_SUMMARY} FROM ops"),
        "c13_unify_customer": with_tables("o", f"SELECT {LINE} FROM o"),
        "clean_all_orders": with_tables("o", f"SELECT {LINE} FROM o"),
        "repair_counts": with_tables(needs, counts),
        **{name: with_tables(n, sql) for name, (n, sql) in previews.items()},
    }


def _views() -> dict[str, str]:
    store = f"""
        WITH line AS (
            SELECT o.*, s.storeid, s.seller_city, category, {COST} AS cost, {PROFIT} AS profit
            FROM o LEFT JOIN p USING (product_id) LEFT JOIN s ON delivered_storeid = s.storeid
        ), base AS (
            SELECT storeid, seller_city, count(DISTINCT order_id) AS orders, count(DISTINCT product_id) AS items,
                   sum(quantity) AS qty, sum({NTA}) AS amount, sum(discount) AS discount,
                   count(*) FILTER (discount > 0) AS discounted, sum(cost) AS cost, sum(profit) AS profit,
                   count(DISTINCT category) AS categories, max(correct_date) AS last
            FROM line GROUP BY ALL
        ), limits AS (
            SELECT list(profit ORDER BY profit) AS v, count(profit) - 1 AS top FROM base
        ), high AS (
            SELECT (v[3 * top // 4 + 1] * (4 - 3 * top % 4)
                    + coalesce(v[3 * top // 4 + 2], 0) * (3 * top % 4)) AS quadruple FROM limits
        ), visit AS (
            SELECT order_id, customer_id, delivered_storeid AS place, correct_date, sum({NTA}) AS amount,
                   sum({PROFIT}) AS profit, coalesce(dayofweek(correct_date) IN (0, 6), false) AS weekend
            FROM o GROUP BY ALL
        ), visits AS (
            SELECT place, sum(amount) FILTER (weekend) AS weekend_sales, sum(amount) FILTER (NOT weekend) AS weekday_sales,
                   {dbl('sum(amount)')} / count(amount) AS aov, {dbl('sum(profit)')} / count(profit) AS ppt,
                   {dbl('sum(profit)')} / nullif(count(DISTINCT customer_id), 0) AS ppc,
                   {dbl('count(order_id)')} / nullif(count(DISTINCT customer_id), 0) AS per_customer,
                   {dbl('sum(CAST(average_score AS DECIMAL(20,10)))')} / nullif(count(average_score), 0) AS rating
            FROM visit LEFT JOIN ras USING (order_id) GROUP BY place
        )
        SELECT storeid, seller_city AS "Location", orders AS "No_of_Orders", items AS "No_of_Items",
               {big('qty')} AS "Total_Qty", {dbl('amount')} AS "Total_Amount", {dbl('discount')} AS "Total_Discount",
               discounted AS "Items_With_Discount", {dbl('cost')} AS "Total_Cost", {dbl('profit')} AS "Total_Profit",
               CAST(profit < 0 AS INTEGER) AS "Flag_Loss_Making",
               CAST(4 * profit >= quadruple AS INTEGER) AS "Orders_with_High_Profit",
               categories AS "Distinct_Categories",
               CAST(coalesce(dayofweek(last) IN (0, 6), false) AS INTEGER) AS "Weekend_Trans_Flag",
               {dbl('coalesce(weekend_sales, 0)')} AS "Weekend_Sales", {dbl('coalesce(weekday_sales, 0)')} AS "Weekday_Sales",
               aov AS "Average_Order_Value", ppt AS "Average_Profit_Per_Transaction",
               ppc AS "Average_Profit_Per_Customer", per_customer AS "Average_Customer_Visits",
               rating AS "Average_Rating_Per_Customer"
        FROM base CROSS JOIN high LEFT JOIN visits ON storeid = place"""
    order = f"""
        WITH base AS (
            SELECT order_id, count(DISTINCT product_id) AS items, sum(quantity) AS qty, sum({NTA}) AS amount,
                   sum(discount) AS discount, count(*) FILTER (discount > 0) AS discounted, sum({COST}) AS cost,
                   sum({PROFIT}) AS profit, count(DISTINCT category) AS categories, max(correct_date) AS last
            FROM o LEFT JOIN p USING (product_id) WHERE order_id IS NOT NULL GROUP BY order_id
        ), limits AS (
            SELECT list(profit ORDER BY profit) AS v, count(profit) - 1 AS top FROM base
        ), high AS (
            SELECT (v[3 * top // 4 + 1] * (4 - 3 * top % 4)
                    + coalesce(v[3 * top // 4 + 2], 0) * (3 * top % 4)) AS quadruple FROM limits
        )
        SELECT order_id, items AS "No_of_items", {big('qty')} AS "Total_Qty", {dbl('amount')} AS "Total_Amount",
               {dbl('discount')} AS "Total_Discount", discounted AS "Items_with_Discount", {dbl('cost')} AS "Total_Cost",
               {dbl('profit')} AS "Total_Profit", if(profit < 0, 'Negative', 'Positive') AS "Flag_Loss_Making",
               if(4 * profit >= quadruple, 'High', 'Moderate') AS "Orders_with_High_Profit",
               categories AS "Distinct_Categories",
               CASE dayofweek(last) WHEN 0 THEN 'Sunday' WHEN 6 THEN 'Saturday' ELSE 'Weekday' END AS "Weekend_Trans_Flag",
               CASE WHEN hour(last) BETWEEN 6 AND 11 THEN 'Morning' WHEN hour(last) BETWEEN 12 AND 16 THEN 'Afternoon'
                    WHEN hour(last) BETWEEN 17 AND 21 THEN 'Evening' ELSE 'Night' END AS "Hours_Flag"
        FROM base CROSS JOIN high"""
    head, tail = order.split("SELECT order_id, items AS", 1)
    feedback = f"{head}SELECT order_id, average_score, items AS{tail} LEFT JOIN ras USING (order_id)"
    whole = "floor(CAST(sum({0}) AS DOUBLE) / nullif(count({0}), 0))"
    whole_scores = "(SELECT order_id, sum(customer_satisfaction_score) // count(customer_satisfaction_score) AS average_score FROM rev GROUP BY order_id)"
    store_rating = f"{dbl('sum(CAST(average_score AS DECIMAL(20,10)))')} / nullif(count(average_score), 0)"
    customer = _customer_view(first_only=False, dedupe=False)
    return {
        "v1_store360_integer": with_tables(
            "o p s rev",
            store.replace(store_rating, whole.format("average_score")).replace("JOIN ras", f"JOIN {whole_scores} AS ras"),
        ),
        "v3_customer360_integer": with_tables(
            "main_c o p s ops rev",
            customer.replace(f"{dbl('sum(score)')} / nullif(count(score), 0)", whole.format("score")),
        ),
        "v1_store360": with_tables("o p s ras", store),
        "v2_orders360": with_tables("o p", order),
        "v3_customer360": with_tables("main_c o p s ops rev", customer),
        "v3_customer360_corrected": with_tables("main_c o p s ops rev", _customer_view(first_only=True, dedupe=True)),
        "v3_customer360_percentile_segments": with_tables(
            "main_c o p s ops rev", _customer_view(first_only=False, dedupe=False, percentiles=True)
        ),
        "p05_discount_class": with_tables(
            "o",
            f"""SELECT order_id, pct AS discount_pct,
                       CASE WHEN pct <= 0 THEN 'No Discount' WHEN pct <= 5 THEN 'Low' WHEN pct <= 10 THEN 'Medium'
                            WHEN pct > 10 THEN 'High' END AS discount_class
                FROM (SELECT order_id, {pct2('sum(quantity * discount)', 'sum(quantity * mrp)')} AS pct
                      FROM o GROUP BY ALL)""",
        ),
        "p10_orders360_feedback": with_tables("o p ras", feedback),
    }


def _customer_view(first_only: bool, dedupe: bool, percentiles: bool = False) -> str:
    """Line-by-line joins on purpose: the repeated rows are what the Spark side must reproduce without repeating them."""
    reviews = (
        "(SELECT order_id, avg(customer_satisfaction_score) AS customer_satisfaction_score FROM rev GROUP BY order_id)"
        if dedupe
        else "rev"
    )
    first = "WHERE correct_date = first_ts" if first_only else ""
    tile = "ntile(3) OVER (ORDER BY monetary NULLS FIRST, cust)"
    if percentiles:
        cut = "(SELECT (v[{0} * top // 3 + 1] * (3 - {0} * top % 3) + coalesce(v[{0} * top // 3 + 2], 0) * ({0} * top % 3)) FROM cuts)"
        tile = f"1 + CAST(3 * monetary > {cut.format(1)} AS INT) + CAST(3 * monetary > {cut.format(2)} AS INT)"
    return f"""
        WITH cu AS (
            SELECT * FROM main_c
            QUALIFY row_number() OVER (PARTITION BY custid ORDER BY customer_city, customer_state, gender) = 1
        ), wide AS (
            SELECT cu.custid AS cust, o.*, category, ops.Voucher AS voucher, "UPI/Cash" AS upi, "Credit card" AS credit,
                   "Debit card" AS debit, seller_city, customer_satisfaction_score AS score,
                   min(correct_date) OVER (PARTITION BY cu.custid) AS first_ts
            FROM cu LEFT JOIN o ON cu.custid = o.customer_id LEFT JOIN p USING (product_id)
                   LEFT JOIN ops ON ops.order_id = o.order_id LEFT JOIN s ON storeid = delivered_storeid
                   LEFT JOIN {reviews} AS r ON r.order_id = o.order_id
        ), once AS (
            SELECT custid AS cust, min(correct_date) AS first_at, max(correct_date) AS last_at,
                   datediff('day', max(correct_date), (SELECT max(correct_date) FROM o)) AS idle,
                   count(DISTINCT order_id) AS freq, sum({NTA}) AS monetary, sum({PROFIT}) AS profit,
                   sum(discount) AS discount, sum(quantity) AS qty, count(DISTINCT product_id) AS items
            FROM cu LEFT JOIN o ON custid = customer_id GROUP BY custid
        ), cuts AS (
            SELECT list(monetary ORDER BY monetary) FILTER (monetary IS NOT NULL) AS v, count(monetary) - 1 AS top FROM once
        ), spend AS (
            SELECT cust, {tile} AS tile FROM once
        ), favourite AS (
            SELECT cust, category FROM wide WHERE category IS NOT NULL GROUP BY cust, category
            QUALIFY row_number() OVER (PARTITION BY cust ORDER BY count(*) DESC, category) = 1
        ), many AS (
            SELECT cust, count(DISTINCT category) AS categories, count(*) FILTER (discount > 0) AS discounted,
                   count(*) FILTER ({NTA} < {COST}) AS losses, count(DISTINCT lower(channel)) AS channels,
                   count(DISTINCT delivered_storeid) AS stores, count(DISTINCT seller_city) AS cities,
                   count(DISTINCT CASE WHEN voucher > 0 THEN 1 WHEN upi > 0 THEN 2 WHEN credit > 0 THEN 3
                                       WHEN debit > 0 THEN 4 END) AS kinds,
                   count(*) FILTER (voucher > 0) AS v, count(*) FILTER (credit > 0) AS cr,
                   count(*) FILTER (debit > 0) AS d, count(*) FILTER (upi > 0) AS u
            FROM wide GROUP BY cust
        ), bought AS (
            SELECT cust, sum(quantity) AS qty, sum({NTA}) AS amount, count(DISTINCT product_id) AS items,
                   count(DISTINCT category) AS categories, {dbl('sum(score)')} / nullif(count(score), 0) AS score
            FROM wide {first} GROUP BY cust
        )
        SELECT custid, customer_city, customer_state, gender, favourite.category AS "Top_Category",
               first_at AS "First_Transaction_Date", last_at AS "Last_Transaction_Date",
               CAST(idle AS INTEGER) AS "Inactive_Days", freq AS "Frequency", {dbl('monetary')} AS "Monetary",
               {dbl('profit')} AS "Profit", {dbl('once.discount')} AS "Discount", {big('once.qty')} AS "Total_Quantity",
               once.items AS "Distinct_Items_Purchased", many.categories AS "Distinct_Categories_Purchased",
               discounted AS "Transactions_with_Discount", losses AS "Transactions_with_Loss", channels AS "Channels_Used",
               stores AS "Distinct_Stores", cities AS "Distinct_Cities", kinds AS "Different_Payment_Types",
               v AS "Transactions_Paid_with_Voucher", cr AS "Transactions_Paid_with_Credit_Card",
               d AS "Transactions_Paid_with_Debit_Card", u AS "Transactions_Paid_with_UPI",
               CASE WHEN v > greatest(cr, d, u) THEN 'Voucher' WHEN cr > greatest(d, u) THEN 'Credit Card'
                    WHEN d > u THEN 'Debit Card' ELSE 'UPI' END AS "Preferred_Payment_Method",
               {big('bought.qty')} AS "First_Purchase_Qty", {dbl('bought.amount')} AS "First_Purchase_Amount",
               bought.items AS "First_Purchase_Distinct_Items", bought.categories AS "First_Purchase_Distinct_Categories",
               bought.score AS "Average_Satisfaction_Score", ['Low', 'Medium', 'High'][tile] AS "Customer_Segment"
        FROM cu JOIN once ON once.cust = custid JOIN spend ON spend.cust = custid JOIN many ON many.cust = custid
             LEFT JOIN bought ON bought.cust = custid LEFT JOIN favourite ON favourite.cust = custid
        WHERE once.qty IS NOT NULL"""


def _kpis() -> dict[str, str]:
    lines = {
        "Total_Orders": "count(DISTINCT order_id)",
        "Total_Discount": dbl("round(sum(discount), 2)"),
        "Average_Discount_Per_Customer": ratio2("sum(discount)", "count(DISTINCT customer_id)"),
        "Average_Discount_Per_Order": ratio2("sum(discount)", "count(discount)"),
        "Average_Order_Value": ratio2(f"sum({NTA})", "count(DISTINCT order_id)"),
        "Average_Sales_Per_Customer": ratio2(f"sum({NTA})", "count(DISTINCT customer_id)"),
        "Average_Profit_Per_Customer": ratio2(f"sum({PROFIT})", "count(DISTINCT customer_id)"),
        "Total_Customers": "count(DISTINCT customer_id)",
        "Total_Revenue": dbl(f"round(sum({NTA}), 2)"),
        "Total_Profit": dbl(f"round(sum({PROFIT}), 2)"),
        "Total_Cost": dbl(f"round(sum({COST}), 2)"),
        "Total_Quantity": big("sum(quantity)"),
        "Total_Products": "count(DISTINCT product_id)",
        "Total_Stores": "count(DISTINCT delivered_storeid)",
        "Total_Channels": "count(DISTINCT lower(channel))",
        "Profit_Percentage": pct2(f"sum({PROFIT})", f"sum({NTA})"),
        "Discount_Percentage": pct2("sum(discount)", f"sum({NTA})"),
    }
    one = {name: ("o", f"SELECT {expression} AS {name} FROM o") for name, expression in lines.items()}
    per_customer = "(SELECT customer_id, count(DISTINCT order_id) AS n FROM o GROUP BY ALL)"
    one |= {
        "Avg_Categories_Per_Order": (
            "o p",
            f"""SELECT {ratio2('sum(n)', 'count(n)')} AS Avg_Categories_Per_Order
                FROM (SELECT order_id, count(DISTINCT category) AS n FROM o JOIN p USING (product_id) GROUP BY order_id)""",
        ),
        "Avg_Items_Per_Order": (
            "o",
            f"""SELECT {ratio2('sum(n)', 'count(n)')} AS Avg_Items_Per_Order
                FROM (SELECT sum(quantity) AS n FROM o GROUP BY order_id)""",
        ),
        "Transactions_Per_Customer": (
            "o",
            f"SELECT {ratio2('sum(n)', 'count(n)')} AS Transactions_Per_Customer FROM {per_customer}",
        ),
        "Total_Categories": (
            "o p",
            "SELECT count(DISTINCT category) AS Total_Categories FROM p WHERE product_id IN (SELECT product_id FROM o)",
        ),
        "Total_Locations": ("s", "SELECT count(DISTINCT seller_city) AS Total_Locations FROM s"),
        "Total_Regions": ("s", "SELECT count(DISTINCT seller_state) AS Total_Regions FROM s"),
        "Total_Payment_Methods": ("pay", "SELECT count(DISTINCT lower(payment_type)) AS Total_Payment_Methods FROM pay"),
        "Avg_Days_Between_Transactions": (
            "o",
            f"""SELECT {ratio2('sum(gap)', 'count(gap)')} AS Avg_Days_Between_Transactions
                FROM (SELECT datediff('day', lag(correct_date) OVER (PARTITION BY customer_id
                                                                     ORDER BY correct_date NULLS FIRST), correct_date) AS gap
                      FROM o)""",
        ),
    }
    for name, condition in {
        "Repeat_Purchase_Rate": "n > 1",
        "Repeat_Customer_Percentage": "n > 1",
        "One_Time_Buyers_Percentage": "n = 1",
    }.items():
        one[name] = (
            "o",
            f"SELECT {pct2(f'count(*) FILTER ({condition})', 'count(*)')} AS {name} FROM {per_customer}",
        )
    result = {f"kpi_{name.lower()}": with_tables(needs, sql) for name, (needs, sql) in one.items()}
    columns = ", ".join(f"({sql}) AS {name}" for name, (_, sql) in one.items())
    result["kpi_summary"] = with_tables("o p s pay", f"SELECT {columns}")
    return result


def _growth() -> dict[str, str]:
    cohort = f"""
        WITH first AS (
            SELECT customer_id, min(date_trunc('month', correct_date)) AS start
            FROM o WHERE customer_id IS NOT NULL GROUP BY customer_id
        ), monthly AS (
            SELECT customer_id, start, datediff('month', start, date_trunc('month', correct_date)) AS age,
                   count(DISTINCT order_id) AS n, sum({NTA}) AS revenue
            FROM o JOIN first USING (customer_id) GROUP BY ALL
        )
        SELECT strftime(start, '%Y-%m') AS "Cohort_Month", count(DISTINCT customer_id) AS "Cohort_Customers",
               count(DISTINCT customer_id) FILTER (age > 0) AS "Repeat_Customers",
               {pct2('count(DISTINCT customer_id) FILTER (age > 0)', 'count(DISTINCT customer_id)')} AS "Retention_Rate",
               {ratio2('sum(age) FILTER (age > 0)', 'count(*) FILTER (age > 0)')} AS "Avg_Months_to_Repeat",
               {big('sum(n) FILTER (age = 0)')} AS "Total_Orders_Cohort_Customers",
               {dbl('sum(revenue) FILTER (age = 0)')} AS "Total_Revenue_Cohort_Customers",
               {big('sum(n) FILTER (age > 0)')} AS "Total_Orders_Repeat_Customers",
               {dbl('sum(revenue) FILTER (age > 0)')} AS "Total_Revenue_Repeat_Customers"
        FROM monthly GROUP BY start"""
    return {
        "g1_new_customers_by_month": with_tables(
            "o",
            """SELECT strftime(f, '%Y-%m') AS "YearMonth", count(customer_id) AS "New_Customers"
               FROM (SELECT customer_id, min(correct_date) AS f FROM o GROUP BY ALL) WHERE f IS NOT NULL GROUP BY 1""",
        ),
        "g2_monthly_retention": with_tables(
            "o",
            f"""WITH m AS (SELECT DISTINCT customer_id, date_trunc('month', correct_date) AS mon FROM o)
                SELECT strftime(a.mon, '%Y-%m') AS "Current_Month", count(DISTINCT a.customer_id) AS "Customers_Current",
                       count(DISTINCT b.customer_id) AS "Retained_Customers",
                       {pct2('count(DISTINCT b.customer_id)', 'count(DISTINCT a.customer_id)')} AS "Retention_Rate_Percent"
                FROM m a LEFT JOIN m b ON a.customer_id = b.customer_id AND b.mon = a.mon + INTERVAL 1 MONTH
                GROUP BY a.mon""",
        ),
        "g3_new_vs_existing_revenue": with_tables(
            "o",
            f"""SELECT {MONTH} AS "Month",
                       CASE WHEN {MONTH} = strftime(f, '%Y-%m') THEN 'New Customer' ELSE 'Existing Customer' END
                           AS "Customer_Type",
                       {dbl('sum(total_amount)')} AS "Total_Revenue"
                FROM o JOIN (SELECT customer_id, min(correct_date) AS f FROM o GROUP BY ALL) USING (customer_id)
                GROUP BY 1, 2""",
        ),
        "h1_cohorts": with_tables("o", cohort),
        "k29_distinct_counts_by_month": with_tables(
            "o",
            f"""SELECT {MONTH} AS "Month", count(DISTINCT customer_id) AS customers, count(DISTINCT order_id) AS orders,
                       count(DISTINCT product_id) AS products, true AS customers_close, true AS orders_close,
                       true AS products_close
                FROM o GROUP BY 1""",
        ),
    }


def _sales() -> dict[str, str]:
    trend = f"""
        SELECT {MONTH} AS "Month", category AS "Product_Category", region AS "Store_Region", storeid AS "StoreID",
               min(channel) AS "Channel", min(payment_type) AS payment_type, {{sales}} AS "Total_Sales",
               {{quantity}} AS "Total_Quantity"
        FROM o LEFT JOIN p USING (product_id) LEFT JOIN s ON storeid = delivered_storeid
             LEFT JOIN {{paid}} AS y ON y.order_id = o.order_id
        GROUP BY 1, 2, 3, 4, lower(channel), lower(payment_type)"""
    stores = """SELECT storeid, seller_city, seller_state, region, sum(total_amount) AS sales
                FROM o LEFT JOIN s ON storeid = delivered_storeid GROUP BY ALL"""
    picked = """SELECT '{0}' AS "Category", storeid AS "StoreID", seller_city, seller_state, region AS "Region",
                       CAST(sales AS DOUBLE) AS "Total_Sales"
                FROM (SELECT * FROM t ORDER BY sales {1}, storeid NULLS FIRST LIMIT 10)"""

    def pareto(items: str) -> str:
        return f"""
            WITH i AS ({items}),
            r AS (SELECT item, sales, sum(sales) OVER w AS run, row_number() OVER w AS n, sum(sales) OVER () AS whole,
                         count(*) OVER () AS items
                  FROM i WINDOW w AS (ORDER BY sales DESC, item NULLS FIRST ROWS UNBOUNDED PRECEDING))
            SELECT item, {dbl('sales')} AS sales, {pct2('run', 'whole')} AS cumulative_sales_pct,
                   {pct2('n', 'items')} AS cumulative_item_pct, {pct2('run', 'whole')} <= 80 AS in_threshold FROM r"""

    def share(column: str) -> str:
        return f"""
            SELECT {column}, {dbl(f'sum({NTA})')} AS sales, {dbl(f'sum({PROFIT})')} AS profit,
                   {pct2(f'sum({NTA})', f'(SELECT sum({NTA}) FROM o)')} AS sales_pct,
                   {pct2(f'sum({PROFIT})', f'(SELECT sum({PROFIT}) FROM o)')} AS profit_pct
            FROM o LEFT JOIN s ON storeid = delivered_storeid GROUP BY {column}"""

    return {
        "l1_sales_trend": with_tables(
            "o p s pay",
            trend.format(sales=dbl("sum(total_amount)"), quantity=big("sum(quantity)"), paid="pay"),
        ),
        "l1_sales_trend_share_weighted": with_tables(
            "o p s pay",
            f"""WITH paid AS (
                    SELECT order_id, payment_type, coalesce({dbl('sum(payment_value)')}
                           / nullif({dbl('sum(sum(payment_value)) OVER (PARTITION BY order_id)')}, 0),
                           {dbl('count(*)')} / {dbl('sum(count(*)) OVER (PARTITION BY order_id)')}) AS weight
                    FROM pay GROUP BY order_id, payment_type
                ), line AS (
                    SELECT order_id, {MONTH} AS month, product_id, delivered_storeid, channel,
                           sum(total_amount) AS sales, sum(quantity) AS quantity
                    FROM o GROUP BY ALL
                )
                SELECT month AS "Month", category AS "Product_Category", region AS "Store_Region", storeid AS "StoreID",
                       min(channel) AS "Channel", min(payment_type) AS payment_type,
                       {dbl(f"sum(CAST({dbl('sales')} * coalesce(weight, 1) AS DECIMAL(28,6)))")} AS "Total_Sales",
                       {dbl(f"sum(CAST({dbl('quantity')} * coalesce(weight, 1) AS DECIMAL(28,6)))")} AS "Total_Quantity"
                FROM line LEFT JOIN paid USING (order_id) LEFT JOIN p USING (product_id)
                     LEFT JOIN s ON storeid = delivered_storeid
                GROUP BY 1, 2, 3, 4, lower(channel), lower(payment_type)""",
        ),
        "l6_top_bottom_products": with_tables(
            "o p",
            f"""WITH t AS (SELECT product_id, sum(total_amount) AS sales, sum(quantity) AS qty FROM o GROUP BY ALL),
                     e AS (SELECT 'Bottom 10' AS which, * FROM (SELECT * FROM t ORDER BY sales ASC NULLS FIRST,
                                                                product_id NULLS FIRST LIMIT 10)
                           UNION ALL SELECT 'Top 10', * FROM (SELECT * FROM t ORDER BY sales DESC NULLS LAST,
                                                              product_id NULLS FIRST LIMIT 10))
                SELECT which AS "Category", product_id AS "Product_ID", category AS "Product_Category",
                       {big('qty')} AS "Total_Quantity", {dbl('sales')} AS "Total_Sales"
                FROM e LEFT JOIN p USING (product_id)""",
        ),
        "l7_store_category_performance": with_tables(
            "o p s",
            f"""WITH t AS (SELECT storeid, category, count(DISTINCT order_id) AS n, sum(quantity) AS qty, sum({NTA}) AS sales,
                                  sum({PROFIT}) AS profit
                           FROM o LEFT JOIN p USING (product_id) LEFT JOIN s ON storeid = delivered_storeid GROUP BY ALL)
                SELECT storeid AS "StoreID", category AS "Product_Category", n AS "Orders", {big('qty')} AS "Total_Quantity",
                       {dbl('sales')} AS "Total_Sales", {dbl('profit')} AS "Total_Profit",
                       {pct2('sales', 'sum(sales) OVER (PARTITION BY storeid)')} AS "Sales_Percentage_of_Store"
                FROM t""",
        ),
        "l2_popular_products": with_tables(
            "o p s",
            f"""SELECT region AS "Region", seller_state, storeid AS "StoreID", category AS "Product_Category",
                       p.product_id, {big('sum(quantity)')} AS "Total_Quantity_Sold",
                       {dbl('sum(total_amount)')} AS "Total_Sales",
                       rank() OVER (PARTITION BY storeid ORDER BY sum(quantity) DESC NULLS LAST) AS "Category_Rank"
                FROM o LEFT JOIN p USING (product_id) LEFT JOIN s ON storeid = delivered_storeid
                GROUP BY region, seller_state, storeid, category, p.product_id""",
        ),
        "l3_most_expensive_products": with_tables(
            "o p",
            f"""SELECT product_id AS "Product_ID", category AS "Category", {dbl('max(cost_per_unit)')} AS "Price",
                       {dbl('sum(total_amount)')} AS "Total_Sales",
                       {pct2('sum(total_amount)', '(SELECT sum(total_amount) FROM o)')} AS "Contribution_Percentage"
                FROM o LEFT JOIN p USING (product_id) GROUP BY product_id, category
                ORDER BY max(cost_per_unit) DESC NULLS LAST, product_id LIMIT 10""",
        ),
        "l4_sold_products": with_tables(
            "o p",
            """SELECT DISTINCT product_id AS "Product_ID", category AS "Category"
               FROM o LEFT JOIN p USING (product_id) WHERE product_id IS NOT NULL""",
        ),
        "l5_top_bottom_stores": with_tables(
            "o s",
            f"""WITH t AS ({stores}) {picked.format('Bottom 10', 'ASC NULLS FIRST')}
                UNION ALL {picked.format('Top 10', 'DESC NULLS LAST')}""",
        ),
        "t1_monthly_sales_share": with_tables(
            "o",
            f"""SELECT {MONTH} AS "Month", {dbl(f'sum({NTA})')} AS "Total_Sales",
                       {pct2(f'sum({NTA})', f'(SELECT sum({NTA}) FROM o)')} AS "Percentage_Contribution"
                FROM o GROUP BY 1""",
        ),
        "t2_monthly_sales": with_tables(
            "o", f"""SELECT {MONTH} AS "Month", {dbl(f'sum({NTA})')} AS "Total_Sales" FROM o GROUP BY 1"""
        ),
        "t3_weekday_sales": with_tables(
            "o",
            f"""SELECT dayname(correct_date) AS "Day_Name", CAST(dayofweek(correct_date) + 1 AS INTEGER) AS "Day_Number",
                       {dbl(f'sum({NTA})')} AS "Total_Sales"
                FROM o GROUP BY 1, 2""",
        ),
        "t4_revenue_per_unit_by_store": with_tables(
            "o s",
            f"""SELECT seller_city, storeid AS "StoreID",
                       {dbl(f'sum({NTA})')} / nullif({dbl('sum(quantity)')}, 0) AS avg_unit_revenue
                FROM s LEFT JOIN o ON storeid = delivered_storeid GROUP BY seller_city, storeid""",
        ),
        "p01_pareto_categories": with_tables(
            "o p", pareto(f"SELECT category AS item, sum({NTA}) AS sales FROM o JOIN p USING (product_id) GROUP BY 1")
        ),
        "p01_pareto_products": with_tables("o", pareto(f"SELECT product_id AS item, sum({NTA}) AS sales FROM o GROUP BY 1")),
        "p01_pareto_stores": with_tables(
            "o", pareto(f"SELECT delivered_storeid AS item, sum({NTA}) AS sales FROM o GROUP BY 1")
        ),
        "p03_region_share": with_tables("o s", share("region")),
        "p03_state_share": with_tables("o s", share("seller_state")),
        "p04_payment_mix": with_tables(
            "pay",
            f"""SELECT min(payment_type) AS payment_type, count(DISTINCT order_id) AS orders,
                       {dbl('sum(payment_value)')} AS value,
                       {pct2('sum(payment_value)', '(SELECT sum(payment_value) FROM pay)')} AS value_pct
                FROM pay GROUP BY lower(payment_type)""",
        ),
        "p04_store_payment_mix": with_tables(
            "o ops",
            f"""WITH sold AS (
                    SELECT DISTINCT delivered_storeid AS storeid, ops.* FROM o JOIN ops USING (order_id)
                ), long AS (
                    SELECT storeid, kind AS payment_type, amount
                    FROM (UNPIVOT sold ON Voucher, "UPI/Cash", "Credit card", "Debit card"
                          INTO NAME kind VALUE amount)
                )
                SELECT storeid, payment_type, count(*) FILTER (amount > 0) AS orders, {dbl('sum(amount)')} AS value,
                       {pct2('sum(amount)', 'sum(sum(amount)) OVER (PARTITION BY storeid)')} AS value_pct
                FROM long GROUP BY storeid, payment_type""",
        ),
    }


def _customers() -> dict[str, str]:
    rfm = """
        WITH base AS (
            SELECT customer_id, datediff('day', max(correct_date), (SELECT max(correct_date) FROM o)) AS recency,
                   count(DISTINCT order_id) AS frequency, sum(total_amount) AS monetary
            FROM o GROUP BY customer_id
        ), scored AS (
            SELECT *, ntile(4) OVER (ORDER BY recency NULLS FIRST, customer_id)
                      + ntile(4) OVER (ORDER BY frequency DESC NULLS LAST, customer_id)
                      + ntile(4) OVER (ORDER BY monetary DESC NULLS LAST, customer_id) AS score
            FROM base
        ), named AS (
            SELECT *, CASE WHEN score >= 10 THEN 'Premium' WHEN score >= 7 THEN 'Gold' WHEN score >= 4 THEN 'Silver'
                           ELSE 'Standard' END AS segment
            FROM (SELECT * REPLACE ({score} AS score) FROM scored)
        )"""
    rfm_rows = f"""
        SELECT customer_id AS "Customer_ID", CAST(recency AS INTEGER) AS "Recency", frequency AS "Frequency",
               {dbl('monetary')} AS "Monetary", CAST(score AS INTEGER) AS "RFM_Score", segment AS "Customer_Segment"
        FROM named"""
    source_rfm = rfm.replace("{score}", "score")
    turned_rfm = rfm.replace("{score}", "15 - score")
    totals = """SELECT customer_id, count(DISTINCT order_id) AS n, sum(total_amount) AS sales, sum(quantity) AS qty,
                       sum(discount) AS given,
                       CAST(CAST(sum(total_amount) AS DOUBLE) / count(total_amount) AS DECIMAL(28,6)) AS mean_line
                FROM o GROUP BY customer_id"""

    def mode(value: str, source: str, alias: str) -> str:
        return f"""(SELECT customer_id, {value} AS {alias} FROM {source} GROUP BY customer_id, {value}
                    QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY count(*) DESC, {value} NULLS FIRST) = 1)"""

    preferences = f"""
        WITH ch AS (SELECT customer_id, c AS preferred_channel
                    FROM (SELECT customer_id, min(channel) AS c, count(*) AS n FROM o GROUP BY customer_id, lower(channel))
                    QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY n DESC, c NULLS FIRST) = 1),
             y AS (SELECT customer_id, k AS preferred_payment_method
                   FROM (SELECT customer_id, min(payment_type) AS k, count(*) AS n FROM o JOIN pay USING (order_id)
                         GROUP BY customer_id, lower(payment_type))
                   QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY n DESC, k NULLS FIRST) = 1),
             st AS {mode('delivered_storeid', 'o', 'preferred_store')},
             ct AS {mode('category', 'o JOIN p USING (product_id)', 'preferred_category')}
        SELECT customer_id, preferred_channel, preferred_payment_method, preferred_store, preferred_category,
               {ratio2('given', 'n')} AS avg_discount_used,
               if(given > 0, 'Discount Lover', 'Non-Discount Buyer') AS discount_preference
        FROM (SELECT customer_id, sum(discount) AS given, count(discount) AS n FROM o GROUP BY customer_id)
             LEFT JOIN ch USING (customer_id) LEFT JOIN y USING (customer_id) LEFT JOIN st USING (customer_id)
             LEFT JOIN ct USING (customer_id)"""
    return {
        "b1_revenue_bands": with_tables(
            "o c",
            f"""SELECT custid AS "Custid", customer_city AS "Customer_City", customer_state AS "Customer_State",
                       {dbl('r')} AS "Total_Revenue",
                       CASE WHEN r >= 6000 THEN 'High Value' WHEN r >= 3000 AND r <= 5999 THEN 'Medium Value'
                            ELSE 'Low Value' END AS "Customer_Segment"
                FROM (SELECT customer_id, sum(total_amount) AS r FROM o GROUP BY ALL) LEFT JOIN c ON custid = customer_id""",
        ),
        "b2_rfm_segments": with_tables("o", source_rfm + rfm_rows),
        "b2_rfm_segments_best_is_high": with_tables("o", turned_rfm + rfm_rows),
        "b3_all_channel_customers": with_tables(
            "o",
            f"""SELECT customer_id, count(DISTINCT order_id) AS total_orders, {big('sum(quantity)')} AS total_quantity,
                       {dbl('sum(total_amount)')} AS total_sales,
                       {ratio2('sum(total_amount)', 'count(total_amount)')} AS avg_order_value,
                       min(correct_date) AS first_purchase_date, max(correct_date) AS last_purchase_date
                FROM o WHERE customer_id IS NOT NULL GROUP BY customer_id
                HAVING count(DISTINCT lower(channel)) = (SELECT count(DISTINCT lower(channel)) FROM o)""",
        ),
        "b4_buyer_types": with_tables(
            "o",
            f"""WITH t AS ({totals})
                SELECT if(n = 1, 'One-time Buyer', 'Repeat Buyer') AS buyer_type, count(customer_id) AS num_customers,
                       {big('sum(n)')} AS total_orders, {big('sum(qty)')} AS total_quantity,
                       {dbl('sum(sales)')} AS total_sales,
                       {ratio2('sum(sales)', 'count(sales)')} AS avg_sales_per_customer,
                       {ratio2('sum(mean_line)', 'count(mean_line)')} AS avg_order_value,
                       {ratio2('sum(n)', 'count(n)')} AS avg_orders_per_customer,
                       {pct2('sum(sales)', '(SELECT sum(sales) FROM t)')} AS contribution_to_total_sales_percent
                FROM t GROUP BY 1""",
        ),
        "b5_discount_seekers": with_tables(
            "o",
            f"""WITH t AS ({totals})
                SELECT if(given > 0, 'Discount Seeker', 'Non-Discount Seeker') AS customer_type,
                       count(customer_id) AS num_customers, {big('sum(n)')} AS total_orders,
                       {big('sum(qty)')} AS total_quantity, {dbl('sum(sales)')} AS total_sales,
                       {dbl('sum(given)')} AS total_discount_given,
                       {ratio2('sum(sales)', 'count(sales)')} AS avg_sales_per_customer,
                       {ratio2('sum(given)', 'count(given)')} AS avg_discount_per_customer,
                       {pct2('sum(sales)', '(SELECT sum(sales) FROM t)')} AS contribution_to_total_sales_percent,
                       {pct2('sum(given)', '(SELECT sum(given) FROM t WHERE given > 0)')} AS share_of_total_discount_percent
                FROM t GROUP BY 1""",
        ),
        "b6_customer_preferences": with_tables("o pay p", preferences),
        "b7_category_breadth": with_tables(
            "o p",
            f"""SELECT if(cats = 1, 'Single Category Buyers', 'Multi Category Buyers') AS "Customer_Type",
                       count(customer_id) AS "Customer_Count", {dbl('sum(sales)')} AS "Total_Revenue",
                       {big('sum(n)')} AS "Total_Orders", {big('sum(qty)')} AS "Total_Quantity",
                       {ratio2('sum(sales)', 'count(sales)')} AS "Avg_Revenue_per_Customer",
                       {ratio2('sum(n)', 'count(n)')} AS "Avg_Orders_per_Customer"
                FROM (SELECT customer_id, count(DISTINCT category) AS cats, sum(total_amount) AS sales,
                             count(DISTINCT order_id) AS n, sum(quantity) AS qty
                      FROM o JOIN p USING (product_id) GROUP BY customer_id)
                GROUP BY 1""",
        ),
        "p02_gender_patterns": with_tables(
            "o c",
            f"""SELECT gender, count(DISTINCT customer_id) AS customers, count(DISTINCT order_id) AS orders,
                       {big('sum(quantity)')} AS quantity, {dbl(f'sum({NTA})')} AS revenue,
                       {dbl(f'sum({PROFIT})')} AS profit,
                       {ratio2(f'sum({NTA})', 'count(DISTINCT order_id)')} AS avg_order_value,
                       {pct2(f'sum({NTA})', f'(SELECT sum({NTA}) FROM o)')} AS revenue_pct
                FROM o LEFT JOIN c ON custid = customer_id GROUP BY gender""",
        ),
        "p06_weekday_weekend_customers": with_tables(
            "o",
            f"""WITH d AS (
                    SELECT customer_id, order_id, sum({NTA}) AS spend,
                           coalesce(dayofweek(max(correct_date)) IN (0, 6), false) AS we
                    FROM o GROUP BY customer_id, order_id
                ), t AS (
                    SELECT customer_id, count(*) FILTER (NOT we) AS weekday_orders, count(*) FILTER (we) AS weekend_orders,
                           {dbl('coalesce(sum(spend) FILTER (NOT we), 0)')} AS weekday_spend,
                           {dbl('coalesce(sum(spend) FILTER (we), 0)')} AS weekend_spend
                    FROM d GROUP BY customer_id
                )
                SELECT *, CASE sign(weekday_orders - weekend_orders) WHEN 1 THEN 'Weekday' WHEN 0 THEN 'Even'
                          ELSE 'Weekend' END AS dominant
                FROM t""",
        ),
        "p07_rfm_contribution": with_tables(
            "o",
            source_rfm
            + f"""
                SELECT segment AS "Customer_Segment", count(*) AS customers, {dbl('sum(monetary)')} AS sales,
                       {pct2('sum(monetary)', '(SELECT sum(total_amount) FROM o)')} AS sales_pct
                FROM named GROUP BY segment""",
        ),
    }


def _categories() -> dict[str, str]:
    basket = """
        WITH i AS (SELECT DISTINCT order_id, product_id, category FROM o JOIN p USING (product_id)
                   WHERE category IS NOT NULL AND order_id IS NOT NULL)"""
    pairs = basket + """
        SELECT {0} AS "Category_1", {1} AS "Category_2", count(DISTINCT a.order_id) AS "Times_Bought_Together"
        FROM i a JOIN i b ON a.order_id = b.order_id AND a.product_id < b.product_id AND a.category <> b.category
        GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 10"""
    names = "list_sort([a.category, b.category, c3.category])[{0}]"
    triples = basket + """
        SELECT {0} AS "Category_1", {1} AS "Category_2", {2} AS "Category_3",
               count(DISTINCT a.order_id) AS "Times_Bought_Together"
        FROM i a JOIN i b ON a.order_id = b.order_id AND a.product_id < b.product_id AND a.category <> b.category
             JOIN i c3 ON c3.order_id = b.order_id AND b.product_id < c3.product_id
                  AND c3.category NOT IN (a.category, b.category)
        GROUP BY 1, 2, 3 ORDER BY 4 DESC, 1, 2, 3 LIMIT 10"""

    def per_bill(column: str, name: str) -> str:
        return with_tables(
            "o p s",
            f"""SELECT {MONTH} AS "Month_Year", {column} AS "{name}",
                       {ratio2('sum(n)', 'count(n)')} AS "Avg_Categories_Per_Order"
                FROM o JOIN (SELECT order_id, count(DISTINCT category) AS n FROM o JOIN p USING (product_id)
                             GROUP BY order_id) USING (order_id)
                     JOIN s ON storeid = delivered_storeid
                GROUP BY 1, 2""",
        )

    return {
        "a1_category_sales": with_tables(
            "o p",
            f"""SELECT category AS "Category", {dbl(f'sum({NTA})')} AS "Total_Sales",
                       {pct2(f'sum({NTA})', f'(SELECT sum({NTA}) FROM o)')} AS "Percentage_of_Sales"
                FROM o JOIN p USING (product_id) GROUP BY category""",
        ),
        "a2_category_profit": with_tables(
            "o p",
            f"""SELECT category AS "Category", {dbl('t')} AS "Total_Profit",
                       {pct2('t', 'sum(t) OVER ()')} AS "Profit_Contribution_Percentage"
                FROM (SELECT category, sum({PROFIT}) AS t FROM o JOIN p USING (product_id) GROUP BY category)""",
        ),
        "a3_category_penetration": with_tables(
            "o p",
            f"""SELECT "Month", category AS "Category", "Category_Order_Count", "Total_Orders",
                       {pct2('"Category_Order_Count"', '"Total_Orders"')} AS "Category_Penetration_Percentage"
                FROM (SELECT {MONTH} AS "Month", category, count(DISTINCT order_id) AS "Category_Order_Count"
                      FROM o JOIN p USING (product_id) GROUP BY 1, 2)
                JOIN (SELECT {MONTH} AS "Month", count(DISTINCT order_id) AS "Total_Orders" FROM o GROUP BY 1)
                     USING ("Month")""",
        ),
        "a4_categories_per_bill_by_state": per_bill("seller_state", "Seller_State"),
        "a5_categories_per_bill_by_region": per_bill("region", "Seller_Region"),
        "a6_first_purchase_categories": with_tables(
            "o p",
            """SELECT category AS "Category", count(DISTINCT customer_id) AS "No_Of_Customers",
                      count(DISTINCT order_id) AS "No_Of_Orders"
               FROM o JOIN (SELECT customer_id, min(correct_date) AS correct_date FROM o GROUP BY ALL)
                           USING (customer_id, correct_date)
                    JOIN p USING (product_id)
               GROUP BY category""",
        ),
        "x1_category_pairs": with_tables("o p", pairs.format("a.category", "b.category")),
        "x1_category_pairs_unordered": with_tables(
            "o p", pairs.format("least(a.category, b.category)", "greatest(a.category, b.category)")
        ),
        "x2_category_triples": with_tables("o p", triples.format("a.category", "b.category", "c3.category")),
        "x2_category_triples_unordered": with_tables("o p", triples.format(*[names.format(n) for n in (1, 2, 3)])),
    }


def _ratings() -> dict[str, str]:
    dimensions = {
        "month": (MONTH, "Month_Year", "", "o rev"),
        "category": ("category", "Category", "JOIN p USING (product_id)", "o p rev"),
        "state": ("customer_state", "Customer_State", "JOIN c ON custid = customer_id", "o c rev"),
        "store": ("delivered_storeid", "Store_ID", "", "o rev"),
    }
    result = {}
    score = "customer_satisfaction_score"
    for i, (by, (column, name, join, needs)) in enumerate(dimensions.items(), start=1):
        rows = f"FROM o JOIN rev USING (order_id) {join} WHERE {score} IS NOT NULL GROUP BY 1"
        mean = ratio2(f"sum({score})", "count(*)")
        result[f"r{i}_average_rating_by_{by}"] = with_tables(
            needs, f'SELECT {column} AS "{name}", {mean} AS "Avg_Rating", count(*) AS "Total_Reviews" {rows}'
        )
        result[f"p08_rating_extremes_by_{by}"] = with_tables(
            needs,
            f"""SELECT {column} AS "{name}", max({score}) AS max_rating, min({score}) AS min_rating, {mean} AS avg_rating,
                       count(*) AS reviews {rows}""",
        )
    return result


def _quality() -> dict[str, str]:
    tables = {
        "orders": ("l0", "order_id line_no customer_id product_id delivered_storeid channel bill_date_timestamp quantity "
                   "mrp discount cost_per_unit total_amount"),
        "customers": ("c", "custid customer_city customer_state gender"),
        "products": ("p0", "product_id category"),
        "stores": ("s0", "storeid seller_city seller_state region"),
        "payments": ("pay", "order_id payment_type payment_value"),
        "reviews": ("rev", "order_id customer_satisfaction_score"),
    }
    row = "SELECT '{0}' AS \"table\", '{1}' AS rule, '{2}' AS \"column\", {3} AS rows FROM {4}"
    parts = [
        row.format(table, "missing", column, f"count(*) FILTER ({column} IS NULL)", cte)
        for table, (cte, columns) in tables.items()
        for column in columns.split()
    ]
    for table, keys in {
        "orders": "order_id, product_id",
        "customers": "custid",
        "products": "product_id",
        "stores": "storeid",
    }.items():
        cte = tables[table][0]
        parts.append(
            row.format(
                table, "duplicate", keys.replace(", ", "+"), f"count(*) - (SELECT count(*) FROM (SELECT DISTINCT {keys} FROM {cte}))", cte
            )
        )
    for table, column, parent, key in (
        ("orders", "customer_id", "customers", "custid"),
        ("orders", "product_id", "products", "product_id"),
        ("orders", "delivered_storeid", "stores", "storeid"),
        ("payments", "order_id", "orders", "order_id"),
        ("reviews", "order_id", "orders", "order_id"),
    ):
        orphan = f"{tables[table][0]} AS child ANTI JOIN {tables[parent][0]} AS parent ON child.{column} = parent.{key}"
        parts.append(row.format(table, "orphan", column, f"count(child.{column})", orphan))
    parts.append(
        row.format(
            "orders", "unreadable", "bill_date_timestamp",
            "count(*) FILTER (bill_date_timestamp IS NOT NULL AND correct_date IS NULL)", "l1",
        )
    )
    parts.append(row.format("products", "placeholder", "category", "count(*) FILTER (lower(category) = '#n/a')", "p0"))
    return {"p09_quality_profile": with_tables("l0 l1 c p0 s0 pay rev", " UNION ALL ".join(parts))}


def _stored(found: dict[str, str]) -> dict[str, str]:
    """Queries over tables stored in another way: the SQL of the query they are named after."""
    ending = re.compile("_(late_lines|state|bucketed|folded)$")
    plain = {name: ending.sub("", name) for name in STORED}
    return {name: folded(found[of]) if name.endswith("_folded") else found[of] for name, of in plain.items()}


def all_queries() -> dict[str, str]:
    found = {
        **_repair(), **_views(), **_kpis(), **_growth(), **_sales(), **_customers(), **_categories(), **_ratings(),
        **_quality(),
    }
    return found | _stored(found)
