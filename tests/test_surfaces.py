"""Import with rejects, analyses as SQL functions, names in any spelling, distinct counts from sketches, whole-number means."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from shelfwise.plans import catalog, clean, functions, growth, quality, sketches
from shelfwise.sources.imports import import_tables
from shelfwise.sources.star import mixed_case
from shelfwise.sources.storage import write_tables
from shelfwise.tables import SCHEMAS

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def bound(spark):
    return catalog.bound(spark, SMALL)


def test_broken_rows_become_rejects(spark, bound, tmp_path):
    raw = bound.raw
    lines = {
        "orders": ["1,1,7,5,3,Online,2022-01-01 10:00:00,2,10.5,0,5,21", "2,x,7,5,3,Online,,2,10,0,5,20",
                   "3,1,7", "4,1,7,5,3,Online,2022-01-01 10:00:00,2,10,0,5,20,extra", "5,1,7,5,3,,,,,,,"],
        "customers": ["1,Town,State,F"], "products": ['1,"Toys, small"', '2,"never closed'], "stores": [],
        "payments": ["1,Voucher,abc", "1,Voucher,5.25"], "reviews": ["1,5", "1,five", "1,"],
    }
    for name, kept in lines.items():
        header = ",".join(c.split()[0] for c in SCHEMAS[name].replace("(18,4)", "").replace("(18,2)", "").split(", "))
        (tmp_path / name).mkdir()
        (tmp_path / name / "part.csv").write_text("\n".join([header, *kept]) + "\n")
    found = import_tables(spark, str(tmp_path), "csv", header="true")
    got = {(r["table"], r["record"]) for r in found.all_rejects().collect()}
    assert got == {
        ("orders", lines["orders"][1]), ("orders", "3,1,7"), ("orders", lines["orders"][3]),
        ("payments", "1,Voucher,abc"), ("reviews", "1,five"),
    }
    kept = {name: df.count() for name, df in found.tables.present().items()}
    assert all(kept[n] + sum(t == n for t, _ in got) == len(lines[n]) for n in kept)
    assert [r["order_id"] for r in found.tables.orders.orderBy("order_id").collect()] == [1, 5]
    counts = {r["table"]: r["rows"] for r in found.reject_counts().collect()}
    assert counts == {"orders": 3, "customers": 0, "products": 0, "stores": 0, "payments": 1, "reviews": 1}
    profile = quality.quality_profile(found.tables, found.reject_counts())
    assert profile.filter("rule = 'rejected'").agg(F.sum("rows")).first()[0] == 5
    assert raw.orders.columns == found.tables.orders.columns


def test_whole_files_come_through(spark, bound, tmp_path):
    for name, df in bound.raw.present().items():
        df.write.csv(f"{tmp_path}/{name}", header=True, quoteAll=False)
    found = import_tables(spark, str(tmp_path), "csv", header="true", ignoreLeadingWhiteSpace="false")
    assert found.all_rejects().isEmpty()
    for name, df in bound.raw.present().items():
        assert getattr(found.tables, name).count() == df.count()


def test_analyses_are_table_functions(spark, bound):
    names = functions.register_functions(bound.clean)
    assert len(names) > 20
    for name in ("cohorts", "monthly_retention", "category_pairs", "revenue_bands", "monthly_sales", "customer_preferences",
                 "gender_patterns", "first_purchase_categories"):
        got = spark.sql(f"SELECT * FROM {name}()")
        want = functions.FUNCTIONS[name](bound.clean)
        assert got.columns == want.columns and rows(got) == rows(want), name
    best = spark.sql("SELECT Cohort_Month, Cohort_Customers FROM cohorts() WHERE Cohort_Customers > 5 ORDER BY 2 DESC, 1 LIMIT 3")
    want = growth.cohorts(bound.clean.orders).filter("Cohort_Customers > 5").orderBy(F.desc("Cohort_Customers"), "Cohort_Month")
    assert [tuple(r) for r in best.collect()] == [tuple(r) for r in want.select("Cohort_Month", "Cohort_Customers").limit(3).collect()]
    both = spark.sql("SELECT count(*) FROM cohorts() c JOIN new_customers_by_month() n ON c.Cohort_Month = n.YearMonth")
    assert both.first()[0] == growth.cohorts(bound.clean.orders).filter("Cohort_Month is not null").count()


def test_one_spelling(spark):
    df = spark.createDataFrame([(1, "Toys"), (2, "TOYS"), (3, "toys"), (4, None), (5, "Été"), (6, "ÉTÉ"), (7, "ete"), (8, "")], "k int, name string")
    got = {r["k"]: r["name"] for r in clean.one_spelling(df, "name").collect()}
    assert got == {1: "TOYS", 2: "TOYS", 3: "TOYS", 4: None, 5: "ÉTÉ", 6: "ÉTÉ", 7: "ete", 8: ""}


def test_folding_leaves_one_spelling_per_name(bound):
    mixed, folded = mixed_case(bound.clean), clean.fold_names(mixed_case(bound.clean))
    assert mixed.products.select("category").distinct().count() > folded.products.select("category").distinct().count()
    for table, columns in clean.NAMES.items():
        for c in columns:
            many, one = getattr(mixed, table), getattr(folded, table)
            spellings = many.select(F.lower(c)).distinct().count()
            assert one.select(c).distinct().count() == spellings <= many.select(c).distinct().count()
        assert getattr(folded, table).count() == getattr(mixed, table).count()


def test_sketches_roll_up(spark, bound):
    orders = bound.clean.orders
    daily = sketches.daily_sketches(orders)
    months = sketches.distinct_counts_by_month(orders, daily).collect()
    assert len(months) > 60 and all(r["customers_close"] and r["orders_close"] and r["products_close"] for r in months)
    total = sketches.rolled_up(daily, F.lit(1)).first()
    for name, column in sketches.COUNTED.items():
        exact = orders.select(column).distinct().count()
        assert abs(total[name] - exact) <= sketches.ERROR_BOUND * exact
    # In two steps as in one: sketches of sketches say the same.
    assert sketches.rolled_up(daily.filter("false"), F.col("storeid")).collect() == []


def test_whole_number_means(make):
    reviews = make.table("reviews", [(1, 5), (1, 4), (2, None), (3, 1), (3, 1), (3, 3), (4, 2), (4, None)])
    got = dict(rows(clean.average_review(reviews, integer_averages=True)))
    assert got == {1: 4.0, 2: None, 3: 1.0, 4: 2.0}


def test_written_tables_can_be_imported_again(spark, bound, tmp_path):
    written = write_tables(bound.raw, str(tmp_path / "t"))
    assert written.reviews.count() == bound.raw.reviews.count()
