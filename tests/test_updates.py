"""Stored tables that change month by month, bucketed tables, and the state of first-purchase analyses."""

import datetime as dt
import pathlib
import random
import re
import uuid
from decimal import Decimal

import pytest
from conftest import rows
from pyspark.sql import functions as F

from shelfwise.plans import basket, catalog, category, clean, customers, growth, late, views360
from shelfwise.plans.state import CustomerState
from shelfwise.sources import buckets, storage
from shelfwise.sources.storage import scope
from shelfwise.sources.updates import MONTH, MonthlyTable

SMALL = "/root/testdata/sf0.001"
PERIOD = (catalog.START, catalog.END)


@pytest.fixture(scope="module")
def raw(spark):
    return catalog.bound(spark, SMALL).raw


@pytest.fixture(scope="module")
def repaired(spark):
    return catalog.bound(spark, SMALL).clean


def files(folder):
    """Data files by month, with the time they were written."""
    found = {}
    for path in pathlib.Path(folder).rglob("part-*.parquet"):
        month = next(p for p in path.parts if p.startswith(f"{MONTH}=")).split("=")[1]
        found.setdefault(month, set()).add((path.name, path.stat().st_mtime_ns))
    return found


def small_table(spark, tmp_path, rows_):
    df = spark.createDataFrame(rows_, "k bigint, v string, at timestamp_ntz")
    return MonthlyTable.create(df, str(tmp_path / "t"), "at")


def day(month, d=1):
    return dt.datetime(2024, month, d)


START_ROWS = [(1, "a", day(1)), (2, "b", day(1)), (3, "c", day(2)), (4, "d", day(3)), (5, "e", None), (None, "n", day(2, 9))]


def test_replace_rewrites_only_its_months(spark, tmp_path):
    table = small_table(spark, tmp_path, START_ROWS)
    before = files(table.folder)
    assert set(before) == {"2024-01", "2024-02", "2024-03", "none"}
    new = spark.createDataFrame([(3, "c2", day(4)), (3, "c3", day(2, 5))], table.schema)
    assert table.replace(spark.createDataFrame([(3,), (None,), (99,)], "k bigint"), new) == ["2024-02", "2024-04"]
    after = files(table.folder)
    assert {m for m in after if after[m] == before.get(m)} == {"2024-01", "2024-03", "none"}
    want = [r for r in START_ROWS if r[0] != 3] + [(3, "c2", day(4)), (3, "c3", day(2, 5))]
    assert rows(table.read()) == rows(spark.createDataFrame(want, table.schema))
    assert rows(table.read(["2024-04"])) == [(3, "c2", day(4))]


def test_a_month_that_loses_all_rows_goes(spark, tmp_path):
    table = small_table(spark, tmp_path, START_ROWS)
    assert table.replace(spark.createDataFrame([(4,)], "k bigint")) == ["2024-03"]
    assert table.months() == ["2024-01", "2024-02", "none"]
    assert table.delete(F.col("v") == "zzz") == []
    assert table.delete(F.col("k") <= 2) == ["2024-01"]
    assert sorted(r["v"] for r in table.read().collect()) == ["c", "e", "n"]


def test_update_moves_rows_and_add_column_touches_nothing(spark, tmp_path):
    table = small_table(spark, tmp_path, START_ROWS)
    before = files(table.folder)
    wider = table.add_column("amount", "decimal(10,2)")
    assert files(table.folder) == before and [r["amount"] for r in wider.read().collect()] == [None] * 6
    assert wider.update(F.col("k") == 1, amount=F.lit(Decimal("2.50")), at=F.lit(day(3, 7))) == ["2024-01", "2024-03"]
    after = files(table.folder)
    assert {m for m in after if after[m] == before[m]} == {"2024-02", "none"}
    assert {(r["k"], r["amount"], r["at"]) for r in wider.read(["2024-03"]).collect()} == {
        (1, Decimal("2.50"), day(3, 7)), (4, None, day(3))
    }
    assert wider.update(F.col("k") > 100, v=F.lit("x")) == [] and files(table.folder) == after


@pytest.mark.parametrize("portions", [1, 3])
def test_late_lines_equal_one_run_over_all(spark, raw, tmp_path, portions):
    """Late lines of a few orders: the same rows as a repair of everything, and months of other orders keep their files."""
    lines = raw.orders
    chosen = sorted(r[0] for r in lines.select("order_id").distinct().collect())[5::400]
    is_late = F.col("order_id").isin(chosen) & (F.col("line_no") >= 2)
    stored = late.store_lines(lines.filter(~is_late), str(tmp_path / "lines"), *PERIOD)
    before = files(stored.repaired.folder)
    rewritten = set()
    for n in range(portions):
        rewritten |= set(late.add_late_lines(stored, lines.filter(is_late & (F.col("line_no") % portions == n))))
    with scope(spark):
        whole = clean.unify_orders(clean.collapse_lines(clean.prepare_lines(lines, *PERIOD)))
        assert rows(stored.repaired.read()) == rows(whole)
    assert stored.raw.read().count() == lines.count()
    after = files(stored.repaired.folder)
    untouched = {m for m in before if before[m] == after.get(m)}
    assert set(before) - rewritten == untouched and len(untouched) > len(before) / 2
    gone = spark.createDataFrame([(k,) for k in chosen], "order_id bigint")
    late.drop_orders(stored, gone)
    assert rows(stored.repaired.read()) == rows(whole.join(gone, "order_id", "left_anti").select(whole.columns))


def test_late_lines_without_an_order(spark, raw, tmp_path):
    some = raw.orders.filter("order_id < 200")
    lines = some.withColumn("order_id", F.when(F.col("line_no") != 2, F.col("order_id")))
    is_late = F.col("line_no") == 2
    stored = late.store_lines(lines.filter(~is_late), str(tmp_path / "lines"), *PERIOD)
    late.add_late_lines(stored, lines.filter(is_late & (F.col("product_id") % 2 == 0)))
    late.add_late_lines(stored, lines.filter(is_late & (F.col("product_id") % 2 == 1)))
    with scope(spark):
        whole = clean.unify_orders(clean.collapse_lines(clean.prepare_lines(lines, *PERIOD)))
        assert rows(stored.repaired.read()) == rows(whole)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df, key):
    return re.findall(rf"Exchange hashpartitioning\({key}#", plan(df))


def name():
    return f"t_{uuid.uuid4().hex}"


def test_bucketed_lines_need_no_exchange(spark, repaired):
    lines, done = buckets.save_bucketed(repaired.orders, name(), "order_id", 4)
    assert done and rows(lines) == rows(repaired.orders)
    sums = views360._order_sums(lines, repaired.products)
    per_order = basket._per_order(lines, repaired.products)
    for bucketed, plain in (
        (sums, views360._order_sums(repaired.orders, repaired.products)),
        (lines.groupBy("order_id").count(), repaired.orders.groupBy("order_id").count()),
    ):
        assert not exchanges(bucketed, "order_id") and exchanges(plain, "order_id")
        assert rows(bucketed) == rows(plain)
    assert not exchanges(per_order, "order_id")
    assert rows(basket.category_pairs(lines, repaired.products)) == rows(basket.category_pairs(repaired.orders, repaired.products))
    by_customer, done = buckets.save_bucketed(repaired.orders, name(), "customer_id", 4)
    choices = customers._usual_choices(by_customer, repaired.products)
    assert done and not exchanges(choices, "customer_id")
    assert rows(choices) == rows(customers._usual_choices(repaired.orders, repaired.products))


def test_bucketed_tables_join_without_exchange(spark, repaired):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    lines, _ = buckets.save_bucketed(repaired.orders, name(), "order_id", 4)
    paid, _ = buckets.save_bucketed(repaired.payment_summary, name(), "order_id", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = clean.audit_amounts(lines, paid)
        assert "SortMergeJoin" in plan(joined) and not exchanges(joined, "order_id")
        assert rows(joined) == rows(clean.audit_amounts(repaired.orders, repaired.payment_summary))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_a_hot_key_is_not_bucketed(spark, repaired):
    """A third of all lines in one order: no bucket holds them, the table is plain and adaptive execution can split it."""
    hot = repaired.orders.withColumn("order_id", F.when(F.col("product_id") % 3 == 0, F.lit(1)).otherwise(F.col("order_id")))
    lines, done = buckets.save_bucketed(hot, name(), "order_id", 16)
    assert not done and exchanges(lines.groupBy("order_id").count(), "order_id")
    assert rows(views360._order_sums(lines, repaired.products)) == rows(views360._order_sums(hot, repaired.products))
    assert buckets.save_bucketed(hot.filter("false"), name(), "order_id", 16)[1]


def test_state_over_increments_equals_all_lines(spark, repaired, tmp_path):
    """In any order, with late and repeated increments, before and after merging."""
    lines, products = repaired.orders, repaired.products
    state = CustomerState(spark, str(tmp_path / "state"))
    portion = F.pmod(F.xxhash64("order_id", "line_no"), F.lit(4))
    increments = [(f"day{i}", lines.filter(portion == i)) for i in range(4)]
    random.Random(1).shuffle(increments)

    def check(known):
        for analysis, reduced in (
            (growth.new_customers_by_month, state.firsts()),
            (growth.new_customers_by_month, state.sums()),
            (growth.new_vs_existing_revenue, state.sums()),
            (growth.monthly_retention, state.sums()),
            (growth.cohorts, state.sums()),
            (lambda o: category.first_purchase_categories(o, products), state.firsts()),
        ):
            assert rows(analysis(reduced)) == rows(analysis(known))
        dates = F.min("correct_date").alias("first_date"), F.max("correct_date").alias("last_date")
        assert rows(state.spans()) == rows(known.filter("customer_id is not null").groupBy("customer_id").agg(*dates))

    assert state.sums().collect() == [] and state.increments() == []
    for n, (day_, part) in enumerate(increments[:3]):
        assert state.add(day_, part)
        if n == 1:
            assert state.add(*increments[0])  # comes again
    check(lines.filter(portion.isin([int(d[3:]) for d, _ in increments[:3]])))
    assert state.compact("until-now") == sorted(d for d, _ in increments[:3])
    assert not state.add(*increments[0])  # comes again after it was merged
    assert state.add(*increments[3])  # late
    check(lines)
    state.compact("all")
    check(lines)
    assert {"day0", "day1", "day2", "day3", "until-now"} <= set(state.increments())


def test_rows_that_are_added_leave_all_files(spark, tmp_path):
    table = small_table(spark, tmp_path, START_ROWS)
    before = files(table.folder)
    new = [(7, "g", day(1, 9)), (8, "h", None), (9, "i", day(6))]
    table.add(spark.createDataFrame(new, table.schema))
    after = files(table.folder)
    assert all(before[m] <= after[m] for m in before) and "2024-06" in after
    assert rows(table.read()) == rows(spark.createDataFrame(START_ROWS + new, table.schema))


@pytest.mark.parametrize("bucket", [5, 250_000])
def test_late_lines_are_written_once_on_the_way(spark, raw, tmp_path, monkeypatch, bucket):
    """In buckets or not, what months will hold is not written aside again, and raw lines keep their files."""
    monkeypatch.setattr(buckets, "ROWS_IN_A_BUCKET", bucket)
    monkeypatch.setattr(buckets, "MOST_IN_A_KEY", 1000.0)
    lines, written = raw.orders, []
    stored = late.store_lines(lines.filter("line_no < 5"), str(tmp_path / "lines"), *PERIOD)
    before = files(stored.raw.folder)
    monkeypatch.setattr(storage, "OBSERVERS", [lambda label, df: written.append(label)])
    late.add_late_lines(stored, lines.filter("line_no >= 5"))
    assert written.count("added") == 1 and not {"months", "again"} & set(written)
    after = files(stored.raw.folder)
    assert all(before[m] <= after[m] for m in before)
    with scope(spark):
        whole = clean.unify_orders(clean.collapse_lines(clean.prepare_lines(lines, *PERIOD)))
        assert rows(stored.repaired.read()) == rows(whole)
