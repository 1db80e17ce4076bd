"""The shared start of every check query: the six input tables and their repair, as CTEs over the star tables."""

from __future__ import annotations

from shelfwise.plans.catalog import END, START


def dbl(expression: str) -> str:
    return f"CAST({expression} AS DOUBLE)"


def big(expression: str) -> str:
    return f"CAST({expression} AS BIGINT)"


def ratio2(num: str, den: str) -> str:
    """num / den to 2 places, half away from zero, in whole numbers."""
    n = f"CAST(CAST({num} AS DECIMAL(28,4)) * 10000 AS HUGEINT)"
    d = f"CAST(CAST({den} AS DECIMAL(28,4)) * 10000 AS HUGEINT)"
    return f"CAST(sign({n}) * sign({d}) * ((abs({n}) * 200 + abs({d})) // (2 * abs({d}))) AS DOUBLE) / 100"


def pct2(part: str, whole: str) -> str:
    return ratio2(f"100 * ({part})", whole)


COST = "quantity * cost_per_unit"
PROFIT = f"new_total_amount - {COST}"
INSTORE = "lower(channel) = 'instore'"
MONTH = "strftime(correct_date, '%Y-%m')"

CTES: dict[str, str] = {
    "l0": """
        SELECT l_orderkey AS order_id, l_linenumber AS line_no,
               CASE WHEN o_custkey % 43 = 6 THEN 2000000000 + l_orderkey
                    ELSE o_custkey + CASE WHEN l_orderkey % 97 = 0 AND l_linenumber = 1 THEN 1 ELSE 0 END END AS customer_id,
               CASE WHEN o_custkey % 41 = 3 THEN o_custkey % 7 + 1 ELSE l_partkey END AS product_id,
               CASE WHEN l_suppkey % 50 = 49 THEN 100000 + l_suppkey ELSE l_suppkey END AS delivered_storeid,
               CASE o_orderstatus WHEN 'O' THEN 'Online' WHEN 'P' THEN 'Phone'
                    ELSE CASE WHEN l_orderkey % 2 = 0 THEN 'Instore' ELSE 'instore' END END AS channel,
               CASE WHEN l_orderkey % 101 = 0 OR o_custkey % 499 = 7 THEN 'n/a'
                    WHEN l_orderkey % 101 = 1 THEN strftime(billed, '%Y-%m-%dT%H:%M:%S') || '+02:00'
                    WHEN l_orderkey % 101 = 2 THEN strftime(billed, '%-m/%-d/%Y %-I:%M %p')
                    WHEN l_orderkey % 101 = 3 THEN ' ' || strftime(billed, '%Y-%m-%d %H:%M:%S')
                    WHEN l_orderkey % 101 = 4 THEN '1' || strftime(billed, '%Y-%m-%d %H:%M:%S')
                    ELSE [strftime(billed, '%m/%d/%Y %H:%M'), strftime(billed, '%d/%m/%Y %H:%M'),
                          strftime(billed, '%Y-%m-%d %H:%M:%S'), strftime(billed, '%Y-%m-%dT%H:%M:%S')][l_orderkey % 4 + 1]
                    END AS bill_date_timestamp,
               CAST(l_quantity AS INTEGER) AS quantity,
               CAST(p_retailprice AS DECIMAL(12,2))::DECIMAL(18,4) AS mrp,
               (CAST(p_retailprice AS DECIMAL(12,2)) * CASE WHEN o_custkey % 37 = 5 THEN 0
                   ELSE CAST(l_discount AS DECIMAL(4,2)) END)::DECIMAL(18,4) AS discount,
               (CAST(p_retailprice AS DECIMAL(12,2)) * 0.95::DECIMAL(3,2))::DECIMAL(18,4) AS cost_per_unit,
               CAST(l_extendedprice AS DECIMAL(18,2)) AS total_amount
        FROM (SELECT *, o_orderdate + to_hours((l_orderkey + l_linenumber) % 24) AS billed
              FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)""",
    "c": """
        SELECT custid, 'CITY_' || (custid % 60 + copy) AS customer_city, n_name AS customer_state,
               CASE WHEN custid % 3 = 0 THEN 'M' ELSE 'F' END AS gender
        FROM (SELECT c_custkey AS custid, c_nationkey AS nk FROM customer
              UNION ALL SELECT 1000000000 + s_suppkey, s_nationkey FROM supplier)
        JOIN nation ON nk = n_nationkey JOIN (VALUES (0), (1)) AS twice(copy) ON copy = 0 OR custid = 11""",
    "main_c": "SELECT * FROM c",
    "p0": """
        SELECT p_partkey AS product_id, CASE WHEN p_partkey % 50 = 0 THEN '#N/A' ELSE p_type END AS category FROM part""",
    "s0": """
        SELECT s_suppkey AS storeid, 'CITY_' || (s_suppkey % 40 + copy) AS seller_city, n_name AS seller_state,
               r_name AS region
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        JOIN (VALUES (0), (1)) AS twice(copy) ON copy = 0 OR s_suppkey = 0""",
    "pay": """
        SELECT l_orderkey AS order_id,
               CASE l_orderkey % 13 WHEN 0 THEN lower(kind) WHEN 1 THEN upper(kind) ELSE kind END AS payment_type,
               CAST(CAST(l_extendedprice AS DECIMAL(18,2)) + CASE WHEN l_orderkey % 50 = 0 THEN 5 ELSE 0 END
                    AS DECIMAL(18,2)) AS payment_value
        FROM (SELECT *, ['Voucher', 'UPI/Cash', 'Credit_card', 'Debit_card'][l_partkey % 4 + 1] AS kind FROM lineitem)""",
    "rev": """
        SELECT o_orderkey AS order_id,
               CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderkey % 5 + 1 AS INTEGER) END AS customer_satisfaction_score
        FROM orders
        UNION ALL
        SELECT o_orderkey, CAST(o_orderkey % 3 + 1 AS INTEGER) FROM orders WHERE o_orderkey % 7 = 0
        UNION ALL
        SELECT o_orderkey, CAST(o_orderkey % 4 + 2 AS INTEGER) FROM orders WHERE o_orderkey % 77 = 0""",
    "l1": """
        SELECT *, CASE WHEN NOT regexp_matches(bill_date_timestamp, '^[0-9]{5}') THEN
               try_strptime(trim(bill_date_timestamp), ['%m/%d/%Y %H:%M', '%m/%d/%Y %I:%M %p', '%d/%m/%Y %H:%M',
                                                        '%Y-%m-%d %H:%M:%S', '%Y-%m-%dT%H:%M:%S']) END AS correct_date
        FROM l0""",
    "l2": f"""
        SELECT * FROM l1 WHERE correct_date IS NULL OR correct_date BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'""",
    "l7": """
        SELECT *, CAST(quantity * (mrp - discount) AS DECIMAL(18,4)) AS new_total_amount FROM l2""",
    "l9n": """
        SELECT *, row_number() OVER (PARTITION BY order_id, product_id ORDER BY quantity DESC NULLS LAST,
                  line_no NULLS FIRST, customer_id NULLS FIRST, delivered_storeid NULLS FIRST, channel NULLS FIRST,
                  bill_date_timestamp NULLS FIRST, mrp NULLS FIRST, discount NULLS FIRST, cost_per_unit NULLS FIRST,
                  total_amount NULLS FIRST) AS rn
        FROM l7""",
    "l9": "SELECT * EXCLUDE (rn) FROM l9n WHERE rn = 1",
    "l10n": f"""
        SELECT *, first_value(delivered_storeid) OVER (
                      PARTITION BY customer_id, order_id, {INSTORE}
                      ORDER BY total_amount DESC NULLS LAST, quantity DESC NULLS LAST, delivered_storeid NULLS FIRST
                  ) AS PreferredStore,
               ({INSTORE}) AND customer_id IS NOT NULL AND order_id IS NOT NULL AS fixable
        FROM l9""",
    "l10": """
        SELECT * EXCLUDE (PreferredStore, fixable) REPLACE (
               CASE WHEN fixable AND delivered_storeid <> PreferredStore THEN PreferredStore ELSE delivered_storeid END
               AS delivered_storeid)
        FROM l10n""",
    "l11n": f"""
        SELECT *, min(correct_date) OVER (PARTITION BY customer_id, order_id, {INSTORE}) AS FirstBillTS,
               ({INSTORE}) AND customer_id IS NOT NULL AND order_id IS NOT NULL AS fixable
        FROM l10""",
    "l11": """
        SELECT * EXCLUDE (FirstBillTS, fixable) REPLACE (
               CASE WHEN fixable AND correct_date <> FirstBillTS THEN FirstBillTS ELSE correct_date END AS correct_date)
        FROM l11n""",
    "l13n": """
        SELECT *, min(customer_id) OVER w <> max(customer_id) OVER w AND order_id IS NOT NULL AS conflict,
               first_value(customer_id) OVER (w ORDER BY quantity DESC NULLS LAST, customer_id NULLS FIRST) AS winner
        FROM l11 WINDOW w AS (PARTITION BY order_id)""",
    "o": """
        SELECT * EXCLUDE (conflict, winner) REPLACE (CASE WHEN conflict THEN winner ELSE customer_id END AS customer_id)
        FROM l13n""",
    "p": "SELECT product_id, CASE WHEN lower(category) = '#n/a' THEN 'Others' ELSE category END AS category FROM p0",
    "s": """
        SELECT * FROM s0
        QUALIFY row_number() OVER (PARTITION BY storeid ORDER BY seller_city, seller_state, region) = 1""",
    "ops0": """
        PIVOT (SELECT order_id, lower(payment_type) AS kind, payment_value FROM pay)
        ON kind IN ('voucher', 'upi/cash', 'credit_card', 'debit_card') USING sum(payment_value) GROUP BY order_id""",
    "ops1": """
        SELECT order_id, coalesce(Voucher, 0) AS Voucher, coalesce("UPI/Cash", 0) AS "UPI/Cash",
               coalesce(Credit_card, 0) AS "Credit card", coalesce(Debit_card, 0) AS "Debit card", total AS Total_Amount
        FROM ops0 JOIN (SELECT order_id, sum(payment_value) AS total FROM pay GROUP BY ALL) USING (order_id)""",
    "ops": "SELECT * FROM ops1 WHERE order_id IN (SELECT order_id FROM l11 WHERE order_id IS NOT NULL)",
    "ras": "SELECT order_id, avg(customer_satisfaction_score) AS average_score FROM rev GROUP BY order_id",
}

# What each CTE reads among the others.
_NEEDS = {
    "l1": "l0", "l2": "l1", "l7": "l2", "l9n": "l7", "l9": "l9n", "l10n": "l9", "l10": "l10n", "l11n": "l10",
    "l11": "l11n", "l13n": "l11", "o": "l13n", "p": "p0", "s": "s0", "ops0": "pay", "ops1": "ops0 pay",
    "ops": "ops1 l11", "ras": "rev", "main_c": "c",
}


def with_tables(names: str, query: str) -> str:
    """``query`` behind the CTEs it needs; ``names`` lists those it reads itself, separated by blanks."""
    wanted: set[str] = set()

    def add(name: str) -> None:
        if name not in wanted:
            for other in _NEEDS.get(name, "").split():
                add(other)
            wanted.add(name)

    for name in names.split():
        add(name)
    parts = [f"{name} AS MATERIALIZED ({body.strip()})" for name, body in CTES.items() if name in wanted]
    query = query.strip()
    if query.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + query[5:]
    return "WITH " + ",\n".join(parts) + "\n" + query


def _spelled(name: str, key: str) -> str:
    return f"CASE {key} % 3 WHEN 0 THEN upper({name}) WHEN 1 THEN lower({name}) ELSE {name} END"


def folded(query: str) -> str:
    """A query of ``with_tables`` over names spelled in capitals, small letters or as they are, by id: one spelling per name."""
    names = {
        "p": ("product_id", ["category"], "product_id"),
        "s": ("storeid", ["seller_city", "seller_state", "region"], "storeid"),
        "c": ("custid", ["customer_city", "customer_state", "gender"], "custid"),
    }
    for table, (key, columns, ids) in names.items():
        body = f"{table} AS MATERIALIZED ({CTES[table].strip()})"
        if body not in query:
            continue
        spelled = ", ".join(f"{_spelled(c, key)} AS {c}" for c in columns)
        one = ", ".join(f"min({c}) OVER (PARTITION BY lower({c})) AS {c}" for c in columns)
        new = f"SELECT {ids}, {one} FROM (SELECT {ids}, {spelled} FROM ({CTES[table].strip()}))"
        query = query.replace(body, f"{table} AS MATERIALIZED ({new})")
    return query


RAW_LINE = f"""order_id, line_no, customer_id, product_id, delivered_storeid, channel, bill_date_timestamp, quantity,
    {dbl('mrp')} AS mrp, {dbl('discount')} AS discount, {dbl('cost_per_unit')} AS cost_per_unit,
    {dbl('total_amount')} AS total_amount"""
DATED_LINE = f"{RAW_LINE}, correct_date"
LINE = f"{DATED_LINE}, {dbl('new_total_amount')} AS new_total_amount"
PAYMENT_SUMMARY = f"""order_id, {dbl('Voucher')} AS "Voucher", {dbl('"UPI/Cash"')} AS "UPI/Cash",
    {dbl('"Credit card"')} AS "Credit card", {dbl('"Debit card"')} AS "Debit card", {dbl('Total_Amount')} AS "Total_Amount\""""
