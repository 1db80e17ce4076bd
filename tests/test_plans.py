"""The plans must stay distributed: no global window over rows, no cartesian product, no Python worker."""

import re
import time

import pytest
from pyspark.sql import functions as F

from shelfwise.plans import basket, catalog, clean, growth, views360
from shelfwise.sources import storage
from shelfwise.sources.star import TABLES
from shelfwise.sources.storage import shared_dir, write_once

SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark):
    return catalog.bound(spark, SMALL).clean


@pytest.fixture(scope="module")
def plans(spark):
    """The plan of every query and of every frame written for it, nothing being reused from earlier queries."""
    found = {}
    catalog._BOUND.clear()
    for name, query in catalog.all_queries().items():
        seen = []
        storage.OBSERVERS.append(lambda label, df: seen.append((label, plan(df))))
        try:
            seen.append(("result", plan(query(spark, SMALL))))
        finally:
            storage.OBSERVERS.pop()
        found |= {f"{name}/{i}-{label}": text for i, (label, text) in enumerate(seen)}
    return found


def test_every_query_stays_in_the_engine_and_distributed(plans):
    assert len(plans) > len(catalog.all_queries()) + 10
    for name, text in plans.items():
        assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|Python|ArrowEval|MapInPandas", text), name
        # A single partition may only hold what a global aggregate or a top-k has already reduced.
        for match in re.finditer(r"Exchange SinglePartition.*\n(.*)", text):
            below = match.group(1)
            assert re.search(r"HashAggregate|SortAggregate|ObjectHashAggregate|Limit", below), (name, below)


#: Scans of the repaired lines that a query may make.
MOST_FACT_SCANS = {
    "b4_buyer_types": 1, "b5_discount_seekers": 1, "b6_customer_preferences": 3, "h1_cohorts": 1, "l1_sales_trend": 1,
    "x1_category_pairs": 2, "l7_store_category_performance": 2,
}


def test_lines_are_not_read_too_often(plans):
    for name, most in MOST_FACT_SCANS.items():
        texts = [t for n, t in plans.items() if n.startswith(f"{name}/") and re.search("-(result|customer360|rfm|popular)$", n)]
        scans = sum(len(re.findall(r"FileScan parquet \[[^\]]*\b(?:new_total_amount|total_amount|customer_id|order_id)#[^\n]*/orders-", t)) for t in texts)
        assert 1 <= scans <= most, (name, scans)


def test_repairs_reduce_before_they_shuffle(spark, tables):
    collapse = plan(clean.collapse_lines(tables.orders))
    assert re.search(r"WindowGroupLimit.*Partial", collapse)
    assert "LeftSemi" in plan(clean.drop_orphan_payments(tables.payment_summary, tables.orders))
    assert "LeftAnti" in plan(clean.drop_orphan_payments_preview(tables.payment_summary, tables.orders))


def test_scans_read_only_their_columns(tables):
    text = plan(growth.new_customers_by_month(tables.orders))
    assert re.search(r"ReadSchema: struct<customer_id:bigint,correct_date:timestamp_ntz>", text)
    assert "IsNotNull(correct_date)" in text
    assert "bill_date_timestamp" not in plan(views360._order_sums(tables.orders, tables.products))


def test_basket_never_joins_lines_to_lines(tables):
    text = plan(basket.category_pairs(tables.orders, tables.products))
    assert text.count("ReadSchema: struct<order_id:bigint,product_id:bigint>") == 1


def test_trend_repeats_lines_only_where_they_are_summed(tables):
    """A line becomes a row per payment type after its last move, so what moves does not grow with the payments of an order."""
    for name in ("l1_sales_trend", "l1_sales_trend_share_weighted"):
        text = plan(catalog.ANALYSES[name](tables))
        assert "Generate explode" in text, name
        assert "Exchange" not in text.split("Generate explode")[0], name


def test_large_dimensions_are_not_broadcast(spark, tables):
    """Without a size below the limit every dimension join is a sort-merge join that adaptive execution can split."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("l1_sales_trend", "a3_category_penetration", "b6_customer_preferences", "x1_category_pairs"):
            text = plan(catalog.ANALYSES[name](tables))
            assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text, name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_skewed_join_partitions_are_split(spark, tables, tmp_path):
    """A third of all lines on one product: the sort-merge join with the products is split at run time."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    hot = F.when(F.rand(1) < 0.34, F.lit(7)).otherwise(F.col("id") % 900)
    orders = spark.range(60_000).select((F.col("id") / 4).cast("bigint").alias("order_id"), hot.alias("product_id"))
    path = str(tmp_path / "orders")
    orders.repartition(8).write.parquet(path)
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        ends = basket._ends(spark.read.parquet(path), tables.products)
        ends.collect()
        assert "skew=true" in ends._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_intermediates_go_to_the_folder_the_session_names(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark).startswith(base.rstrip("/"))
    assert write_once(spark.range(1), "where").inputFiles()[0].startswith(base)


def test_queries_after_the_first_only_list_the_folder(spark, tables, monkeypatch):
    """What a query costs the driver before its first job does not grow with files, tables or queries."""
    def never(*_, **__):
        raise AssertionError("bound or fingerprinted again")

    monkeypatch.setattr(catalog, "star_tables", never)
    monkeypatch.setattr(storage, "fingerprint", never)
    monkeypatch.setattr(catalog, "write_once", never)
    t0 = time.monotonic()
    catalog.all_queries()["t2_monthly_sales"](spark, SMALL)
    assert time.monotonic() - t0 < 1


def test_rewritten_files_are_noticed(spark, tmp_path):
    for name in TABLES:
        spark.read.parquet(f"{SMALL}/{name}.parquet").coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    folder = str(tmp_path)
    total = lambda: catalog.all_queries()["kpi_total_orders"](spark, folder).first()[0]
    first, held = total(), catalog.bound(spark, folder)
    assert total() == first and catalog.bound(spark, folder) is held
    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    lines.filter("l_orderkey > 3000").write.mode("overwrite").parquet(f"{folder}/lineitem.parquet")
    assert catalog.bound(spark, folder) is not held and total() < first
    lines.limit(5).write.mode("append").parquet(f"{folder}/lineitem.parquet")
    assert catalog.bound(spark, folder) is catalog.bound(spark, folder)
