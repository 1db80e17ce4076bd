from dataclasses import replace
from decimal import Decimal

from conftest import day, rows
from pyspark.sql import functions as F

from shelfwise.plans import clean
from shelfwise.plans.catalog import END, START
from shelfwise.sources.star import star_tables
from shelfwise.sources.storage import save_as_tables, scope, write_once
from shelfwise.tables import SQL_NAMES, RetailTables

SMALL = "/root/testdata/sf0.001"


def test_bill_dates(make):
    texts = {
        "05/06/2022": "2022-05-06",
        "5/6/2022 1:02": "2022-05-06 01:02:00",
        "13/02/2022 10:15": "2022-02-13 10:15:00",
        "2022-02-13 10:15:00": "2022-02-13 10:15:00",
        "2022-02-13T10:15:00": "2022-02-13 10:15:00",
        "9/5/2021 1:30 PM": "2021-09-05 13:30:00",
        "13/9/2021 12:05 am": "2021-09-13 00:05:00",
        " 2022-02-13 10:15:00 ": "2022-02-13 10:15:00",
        "2021-09-05T10:00:00+02:00": None,
        "2021-09-05T10:00:00Z": None,
        "12021-09-05": None,
        "2021-9-5": None,
        "9/5/2021 13:30 PM": None,
        "2021-09-05 10:00:00 x": None,
        "02/30/2022": None,
        "31/31/2022": None,
        "1/2/20225": None,
        "2022-02": None,
        "n/a": None,
        "": None,
    }
    df = clean.parse_bill_dates(make.lines(*[{"text": t} for t in [*texts, None]]).drop("correct_date"))
    found = {r.bill_date_timestamp: r.correct_date for r in df.collect()}
    assert found == {**{t: day(d) for t, d in texts.items()}, None: None}


def test_date_range_keeps_bounds_and_missing_dates(make):
    stamps = ["2022-01-01", "2022-01-31", "2022-01-31 00:00:01", "2021-12-31 23:59:59", None]
    df = make.lines(*[{"ts": s} for s in stamps])
    kept = clean.filter_date_range(df, "2022-01-01", "2022-01-31")
    assert {r.correct_date for r in kept.collect()} == {day(stamps[0]), day(stamps[1]), None}
    dropped = clean.filter_date_range_preview(df, "2022-01-01", "2022-01-31")
    assert {r.correct_date for r in dropped.collect()} == {day(stamps[2]), day(stamps[3])}


def test_stores_and_categories(make):
    stores = make.table("stores", [(1, "B", "s", "r"), (1, "A", "s", "r"), (2, "C", "s", "r"), (None, "D", "s", "r")])
    assert rows(clean.dedupe_stores(stores), "storeid", "seller_city") == [(None, "D"), (1, "A"), (2, "C")]
    assert rows(clean.dedupe_stores_preview(stores), "storeid", "seller_city", "rn") == [(1, "B", 2)]
    products = make.table("products", [(1, "#N/A"), (2, "x #N/A"), (3, None), (4, "#n/a")])
    assert rows(clean.fix_category(products)) == [(1, "Others"), (2, "x #N/A"), (3, None), (4, "Others")]


def test_category_preview_and_count(make):
    products = make.table("products", [(1, "#N/A"), (2, "x #N/A"), (3, None), (4, "#n/a")])
    preview = clean.fix_category_preview(products)
    assert rows(preview) == [(1, "#N/A", "Others"), (4, "#n/a", "Others")]
    assert clean.changed_rows(preview).first()[0] == 2


def test_payment_pivot(make):
    pay = make.table(
        "payments",
        [(1, "voucher", Decimal(5)), (1, "Crypto", Decimal(7)), (2, "Debit_card", None), (3, "UPI/Cash", Decimal(2))],
    )
    got = {r.order_id: tuple(r)[1:] for r in clean.pivot_payments(pay).collect()}
    assert got[1] == (5, 0, 0, 0, 12)
    assert got[2] == (0, 0, 0, None, None)
    assert got[3] == (0, 2, 0, 0, 2)


def test_audit_of_a_huge_order(make):
    lines = make.lines({"order": 1, "amount": 10**9})
    pay = make.table("payments", [(1, "Voucher", Decimal(1))])
    assert rows(clean.audit_amounts(lines, clean.pivot_payments(pay)), "diff") == [(Decimal("999999999.00"),)]


def test_repair_follows_its_tables(spark, tmp_path):
    """A part of the tables, or files rewritten in place, are repaired anew; the same tables are not."""
    raw = star_tables(spark, SMALL)
    half = replace(raw, orders=raw.orders.filter("order_id % 2 = 0"))
    whole = clean.repaired_once(raw, START, END).orders
    assert clean.repaired_once(raw, START, END).orders is whole
    assert clean.repaired_once(half, START, END).orders.count() < whole.count()
    path = str(tmp_path / "orders")
    raw.orders.limit(100).write.parquet(path)
    first = clean.repaired_once(replace(raw, orders=spark.read.parquet(path)), START, END).orders.count()
    raw.orders.limit(1).write.mode("overwrite").parquet(path)
    assert clean.repaired_once(replace(raw, orders=spark.read.parquet(path)), START, END).orders.count() <= 1 < first


def test_scope_deletes_what_is_written_in_it(spark):
    with scope(spark) as folder:
        written = write_once(spark.range(10).toDF("order_id"), "scoped")
        assert written.count() == 10 and written.inputFiles()[0].startswith(folder.replace("file:///", "file:///"))
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        assert system.exists(path)
    assert not system.exists(path)


def test_tables_in_the_catalog(spark, make):
    tables = RetailTables(
        orders=make.lines({"order": 1}), customers=make.table("customers", []), products=make.table("products", [(1, "A")]),
        stores=make.table("stores", []), payments=make.table("payments", []), reviews=make.table("reviews", []),
    )
    save_as_tables(tables, mode="overwrite")
    assert spark.table(f"default.{SQL_NAMES['products']}").count() == 1
    for name in tables.present():
        spark.sql(f"drop table default.{SQL_NAMES[name]}")


def test_audit_is_strict(make, spark):
    lines = make.lines({"order": 1, "amount": 10}, {"order": 2, "amount": 10}, {"order": 3, "amount": 10})
    pay = make.table("payments", [(1, "Voucher", Decimal(11)), (2, "Voucher", Decimal("11.01")), (4, "Voucher", Decimal(1))])
    got = clean.audit_amounts(lines, clean.pivot_payments(pay))
    assert rows(got) == [(2, Decimal("10.00"), Decimal("11.01"), Decimal("1.01"))]


def test_collapse_keeps_largest_quantity_and_groups_missing_keys(make):
    lines = make.lines(
        {"order": 1, "prod": 1, "qty": 1}, {"order": 1, "prod": 1, "qty": 3}, {"order": 1, "prod": 2, "qty": 1},
        {"order": None, "prod": None, "qty": 2}, {"order": None, "prod": None, "qty": None},
    )
    kept = clean.collapse_lines(lines)
    assert rows(kept, "order_id", "product_id", "quantity") == [(None, None, 2), (1, 1, 3), (1, 2, 1)]
    dropped = clean.collapse_lines_preview(lines)
    assert rows(dropped, "order_id", "quantity", "rn") == [(None, None, 2), (1, 1, 2)]
    assert clean.collapse_lines(kept).exceptAll(kept).count() == 0


def test_store_of_largest_instore_line_wins(make):
    lines = make.lines(
        {"store": 7, "channel": "Instore", "amount": 5, "qty": 9},
        {"store": 8, "channel": "instore", "amount": 9, "qty": 1},
        {"store": 6, "channel": "instore", "amount": 9, "qty": 2},
        {"store": None, "channel": "instore", "amount": 1},
        {"store": 5, "channel": "Online", "amount": 99},
        {"store": 4, "channel": "Instore", "cust": None},
        {"store": 3, "channel": "Instore", "cust": None},
    )
    fixed = clean.unify_store(lines)
    assert rows(fixed, "line_no", "delivered_storeid") == [
        (1, 6), (2, 6), (3, 6), (4, None), (5, 5), (6, 4), (7, 3),
    ]
    assert rows(clean.unify_store_preview(lines), "line_no", "PreferredStore") == [(1, 6), (2, 6)]


def test_first_instore_timestamp_wins(make):
    lines = make.lines(
        {"channel": "Instore", "ts": "2022-01-02"}, {"channel": "instore", "ts": "2022-01-01"},
        {"channel": "instore", "ts": None}, {"channel": "Online", "ts": "2021-01-01"},
    )
    fixed = clean.unify_timestamp(lines)
    first = day("2022-01-01")
    assert rows(fixed, "line_no", "correct_date") == [(1, first), (2, first), (3, None), (4, day("2021-01-01"))]
    assert rows(clean.unify_timestamp_preview(lines), "line_no", "FirstBillTS") == [(1, first)]


def test_customer_conflicts(make):
    lines = make.lines(
        {"order": 1, "cust": 5, "qty": 1}, {"order": 1, "cust": 6, "qty": 4},  # 6 wins
        {"order": 2, "cust": 9, "qty": 1}, {"order": 2, "cust": None, "qty": 4},  # no conflict
        {"order": 3, "cust": 1, "qty": 1}, {"order": 3, "cust": 2, "qty": 2}, {"order": 3, "cust": None, "qty": 3},
        {"order": None, "cust": 1}, {"order": None, "cust": 2},
    )
    got = rows(clean.unify_customer(lines), "line_no", "customer_id")
    assert got == [(1, 6), (2, 6), (3, 9), (4, None), (5, None), (6, None), (7, None), (8, 1), (9, 2)]
    assert len(rows(clean.unify_customer_preview(lines))) == 5


def test_orphan_payments(make):
    pay = clean.pivot_payments(make.table("payments", [(1, "Voucher", Decimal(1)), (2, "Voucher", Decimal(1)), (None, "x", None)]))
    lines = make.lines({"order": 1}, {"order": 1, "prod": 2}, {"order": None})
    assert rows(clean.drop_orphan_payments(pay, lines), "order_id") == [(1,)]
    assert rows(clean.drop_orphan_payments_preview(pay, lines), "order_id") == [(None,), (2,)]


def test_all_repairs_equal_the_single_steps(spark):
    from shelfwise.oracle.base import END, START
    from shelfwise.sources.star import star_tables

    raw = star_tables(spark, "/root/testdata/sf0.001")
    together = clean.clean_all(raw, START, END).orders
    lines = clean.collapse_lines(clean.prepare_lines(raw.orders, START, END)).cache()
    stamped = clean.unify_timestamp(clean.unify_store(lines)).cache()
    single = clean.unify_customer(stamped)
    assert together.exceptAll(single).count() == 0
    assert single.exceptAll(together).count() == 0
    # Each step leaves its own result alone. (The whole chain does not: merged customers give new (customer, order) pairs,
    # whose stores and times the source, too, would only unify in a second run.)
    for step, done in ((clean.unify_timestamp, stamped), (clean.unify_store, stamped), (clean.unify_customer, single)):
        assert step(done).exceptAll(done).count() == 0


def test_one_order_holding_a_third_of_all_lines(make):
    """The hot order's lines spread over many stores, timestamps and customers; every repair still sees all of them."""
    hot = [
        {"order": 1, "prod": i, "cust": i % 3, "store": i % 7, "channel": "Instore", "qty": 1 + i % 5, "amount": i,
         "ts": f"2022-01-{1 + i % 28:02d}"} for i in range(1, 1001)
    ]
    cold = [{"order": 10 + i, "prod": i, "cust": i, "channel": "Instore"} for i in range(2000)]
    lines = make.lines(*hot, *cold)
    chain = clean.unify_customer(clean.unify_timestamp(clean.unify_store(lines)))
    fused = clean.unify_orders(lines)
    assert chain.exceptAll(fused).count() == 0 and fused.count() == 3000
    one = fused.filter("order_id = 1").agg(
        F.countDistinct("customer_id"), F.count("*"), F.countDistinct("delivered_storeid"), F.countDistinct("correct_date")
    )
    assert one.first()[0:2] == (1, 1000)
    assert one.first()[2] <= 3 and one.first()[3] <= 3  # one per original customer


def test_tables_roundtrip(make, tmp_path):
    from shelfwise.sources.storage import read_tables, write_tables

    tables = RetailTables(
        orders=make.lines({"text": "01/02/2022"}).drop("correct_date", "new_total_amount"),
        customers=make.table("customers", [(1, "c", "s", "F")]),
        products=make.table("products", [(1, "A")]),
        stores=make.table("stores", [(1, "c", "s", "r")]),
        payments=make.table("payments", [(1, "Voucher", Decimal(3))]),
        reviews=make.table("reviews", [(1, 5)]),
    )
    write_tables(tables, str(tmp_path))
    back = read_tables(make.spark, str(tmp_path))
    for name, df in tables.present().items():
        assert rows(getattr(back, name)) == rows(df)
    for name, df in tables.present().items():
        df.write.option("header", "true").csv(f"{tmp_path}/csv/{name}")
    from_csv = read_tables(make.spark, f"{tmp_path}/csv", "csv", header="true")
    assert rows(from_csv.orders) == rows(tables.orders)
    back.register_views()
    assert make.spark.sql("select count(*) from Orders join Product_info using (product_id)").first()[0] == 1
