"""What grows with the tables: lines are dealt out once, buckets follow the rows, a hot order is not bucketed."""

import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from shelfwise.plans import catalog, clean
from shelfwise.sources import buckets, star, storage

SMALL = "/root/testdata/sf0.001"
PERIOD = (catalog.START, catalog.END)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


@pytest.fixture
def written(spark):
    """Label and plan of every frame that is written."""
    seen = []
    storage.OBSERVERS.append(lambda label, df: seen.append((label, plan(df))))
    yield seen
    storage.OBSERVERS.pop()


def moved_lines(text):
    """Exchanges of whole lines, which hold their bill date's text."""
    return re.findall(r"Exchange [^\n]*\n[^\n]*bill_date_timestamp|Exchange hashpartitioning\((?:order_id|l_orderkey|customer_id)[^\n]*", text)


def test_lines_are_dealt_out_once_for_import_and_repairs(spark, no_broadcast, written):
    held = catalog.Bound(spark, SMALL)
    assert held.buckets
    held.clean  # noqa: B018
    by_label = dict(written)
    assert len(moved_lines(by_label["raw-orders"])) == 1
    for label in ("lines", "orders"):
        assert "FileScan" in by_label[label] and not moved_lines(by_label[label]), label


def test_steps_of_the_repair_move_no_line(spark, no_broadcast, written):
    held = catalog.Bound(spark, SMALL)
    held.stamped()
    by_label = dict(written)
    for label in ("step-collapsed", "step-placed", "step-stamped"):
        assert "FileScan" in by_label[label] and not moved_lines(by_label[label]), label


def test_a_hot_order_is_repaired_without_buckets(spark, monkeypatch):
    raw = star.star_tables(spark, SMALL).orders
    hot = raw.withColumn("order_id", F.when(F.col("order_id") % 3 == 0, F.lit(3)).otherwise(F.col("order_id")))
    tables = lambda orders: star.star_tables(spark, SMALL).__class__(
        **{**star.star_tables(spark, SMALL).present(), "orders": orders}
    )
    with storage.scope(spark):
        written = storage.write_once(hot, "hot")
        assert buckets.bucket_count(written, "order_id")
        bucketed = clean.write_repaired(tables(written), *PERIOD)
        found = {name: rows(getattr(bucketed, name)) for name in ("orders", "payment_summary")}
        monkeypatch.setattr(buckets, "ROWS_IN_A_BUCKET", 500)
        assert buckets.bucket_count(written, "order_id") is None
        plainly = clean.write_repaired(tables(written), *PERIOD)
        assert {name: rows(getattr(plainly, name)) for name in found} == found


def test_buckets_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(buckets, "ROWS_IN_A_BUCKET", 100)
    lines = spark.range(5_000).toDF("order_id")
    assert buckets.bucket_count(lines, "order_id") == 50
    assert buckets.bucket_count(lines.limit(10), "order_id") == spark.sparkContext.defaultParallelism
    assert buckets.bucket_count(lines.select(F.lit(1).alias("order_id")), "order_id") is None
    missing = lines.select(F.when(F.col("order_id") % 2 == 0, F.col("order_id")).alias("order_id"))
    assert buckets.bucket_count(missing, "order_id") is None


def test_bucketed_tables_of_a_scope_go_with_it(spark):
    with storage.scope(spark):
        table = storage.write_bucketed(spark.range(20).toDF("order_id"), "scoped", "order_id", 4)
        assert table.count() == 20
        name = next(t.name for t in spark.catalog.listTables() if t.name.startswith("scoped_"))
    assert not spark.catalog.tableExists(name)
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_counting_repairs_reads_the_date_texts_once(spark, no_broadcast, written):
    held = catalog.Bound(spark, SMALL)
    before = len(written)
    counts = catalog._repair_counts(held)
    parsed = [label for label, text in written[before:] if "RLIKE" in text]
    assert parsed == ["step-dated"] and "RLIKE" not in plan(counts)
    surplus = dict(written)["surplus"]
    assert not re.search(r"Exchange hashpartitioning\((?:order_id|_order_id)", surplus)
    assert counts.count() == len(catalog.PREVIEWS)


def test_usual_dates_meet_one_pattern(spark):
    """The half-day pattern was tried on every text, several times."""
    from shelfwise.functions.columns import parse_bill_date

    texts = ["1/2/2024", "13/2/2024 10:11", "2024-01-02T03:04:05", " 1/2/2024 3:04 PM", "2024-01-02 12:00am", "31/31/2024", "n/a", None]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select(parse_bill_date(F.col("t")).cast("string")).collect()
    assert [r[0] for r in found] == [
        "2024-01-02 00:00:00", "2024-02-13 10:11:00", "2024-01-02 03:04:05", "2024-01-02 15:04:00", "2024-01-02 00:00:00",
        None, None, None,
    ]
    text = plan(spark.range(1).select(parse_bill_date(F.col("id").cast("string")).alias("d")))
    assert text.index("{4}|") < text.index("[AaPp]")


def test_groups_of_an_order_move_no_line_once_repaired(spark, no_broadcast, monkeypatch):
    """Repaired lines and payment summaries lay in plain files, so every query dealt them out by order again."""
    monkeypatch.setattr(buckets, "ROWS_IN_A_BUCKET", 1_000)
    clean_tables = catalog.Bound(spark, SMALL).clean
    sums = clean_tables.orders.groupBy("order_id", "customer_id").agg(F.sum("quantity").alias("n"))
    joined = sums.join(clean_tables.payment_summary, "order_id", "left")
    assert "Exchange hashpartitioning(order_id" not in plan(joined)
    assert joined.count() == sums.count()


def test_shuffles_start_with_more_partitions_for_more_rows(spark, monkeypatch):
    """With the session's number alone what one task holds grew with the tables."""
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    monkeypatch.setattr(buckets, "ROWS_IN_A_BUCKET", 1_000)
    held = catalog.bound(spark, SMALL)
    lines = held.raw.payments.count()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    catalog.bound(spark, SMALL)
    assert int(spark.conf.get(name)) == max(-(-lines // 1_000), least)
    buckets.partition_by_rows(spark, 10)
    assert int(spark.conf.get(name)) == least
