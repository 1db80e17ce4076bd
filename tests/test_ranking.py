import random
import re
from decimal import Decimal
from fractions import Fraction

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfwise.operators.grouping import first_per_key, mode_per_key
from shelfwise.operators import ranking, selection
from shelfwise.operators.ranking import (
    OrderedRows,
    add_ntiles,
    exact_percentile,
    exact_percentiles,
    numbered_surplus,
    running_totals,
)
from shelfwise.operators.selection import comes_after, key_columns, select_ranks, whole_units


@pytest.fixture(scope="module")
def sample(spark):
    """A third of the values equal, some missing, unique keys in random order."""
    rng = random.Random(7)
    rows = [(k, None if k % 11 == 0 else (5 if k % 3 == 0 else rng.randint(-50, 50)), k % 4) for k in range(500)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k bigint, v int, g int").repartition(5).cache()


def test_ntiles_equal_the_window(sample):
    got = add_ntiles(sample, "k", 4, up=("v", False), down=("v", True))
    up = F.ntile(4).over(Window.orderBy(F.col("v").asc_nulls_first(), "k"))
    down = F.ntile(4).over(Window.orderBy(F.col("v").desc_nulls_last(), "k"))
    both = got.withColumn("up2", up).withColumn("down2", down)
    assert both.filter("up != up2 or down != down2").count() == 0
    sizes = [r["count"] for r in got.groupBy("up").count().collect()]
    assert max(sizes) - min(sizes) <= 1


@pytest.mark.parametrize("rows", [0, 1, 2, 3, 5])
def test_ntiles_of_few_rows(spark, rows):
    df = spark.createDataFrame([(f"id{i}", i) for i in range(rows)], "k string, v int")
    got = add_ntiles(df, "k", 4, t=("v", False))
    want = df.withColumn("t2", F.ntile(4).over(Window.orderBy("v", "k")))
    assert sorted((r.k, r.t) for r in got.collect()) == sorted((r.k, r.t2) for r in want.collect())


@pytest.mark.parametrize("size", [0, 1, 2, 3, 4, 97, 500])
def test_percentile_equals_the_builtin(sample, size):
    part = sample.filter(F.col("k") < size).withColumn("d", F.col("v").cast("decimal(28,4)") / 4)
    fractions = [Fraction(3, 4), Fraction(0), Fraction(1), Fraction(1, 3), Fraction(1, 2)]
    got = exact_percentiles(part, "d", fractions)
    for fraction, value in zip(fractions, got):
        sql = f"percentile_cont({float(fraction)}) within group (order by cast(d as double))"
        want = part.agg(F.expr(sql)).first()[0]
        assert (value is None) == (want is None)
        assert value is None or float(value) == pytest.approx(want, abs=1e-9)


def test_percentile_of_a_constant(spark):
    df = spark.range(1000).select(F.lit(Decimal("2.5")).cast("decimal(28,4)").alias("d"), F.col("id").alias("k"))
    assert exact_percentile(df, "d", Fraction(3, 4)) == Decimal("2.5")


@pytest.mark.parametrize("buckets", [2, 7, 4096])
def test_selection_by_many_digits(spark, buckets, monkeypatch):
    """Values of very different size, huge ones among them, ties and many passes."""
    monkeypatch.setattr(selection, "BUCKETS", buckets)
    rng = random.Random(3)
    values = [rng.choice([0, 1, -1, 10**k, -(10**k), rng.randrange(-(10**25), 10**25)]) for k in range(1, 26) for _ in range(4)]
    keys = [rng.choice(["", "a", "ab", "ab\0", "ä", "zz" * 9]) + str(i) for i in range(len(values))]
    rows = [(Decimal(v).scaleb(-4), k) for v, k in zip(values, keys)]
    df = spark.createDataFrame(rows, "v decimal(38,4), k string").repartition(3)
    orders = [[whole_units(F.col("v")), *key_columns(df, "k")], key_columns(df, "k")]
    ranks = [0, 1, 17, 50, 98, 99]
    found = select_ranks(df, orders, {0: ranks, 1: ranks})
    places = [sorted(range(100), key=lambda i: (values[i], keys[i].encode())), sorted(range(100), key=lambda i: keys[i].encode())]
    for (order, rank), limit in found.items():
        later = df.filter(comes_after(orders[order], limit)).select("k").collect()
        assert sorted(r["k"] for r in later) == sorted(keys[i] for i in places[order][rank + 1 :])


def test_ranks_beyond_the_rows(spark):
    with pytest.raises(IndexError):
        select_ranks(spark.range(3), [[F.col("id")]], {0: [3]})


def test_ntiles_with_missing_and_text_keys(spark):
    rows = [(None if i == 4 else f"k{i % 7}{'x' * (i % 5)}{i}", None if i % 6 == 0 else i % 4) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(4)
    got = add_ntiles(df, "k", 7, up=("v", False), down=("v", True))
    up = F.ntile(7).over(Window.orderBy(F.col("v").asc_nulls_first(), "k"))
    down = F.ntile(7).over(Window.orderBy(F.col("v").desc_nulls_last(), "k"))
    assert got.withColumn("up2", up).withColumn("down2", down).filter("up <> up2 or down <> down2").isEmpty()


def test_no_row_is_put_in_order(spark, sample, monkeypatch):
    """Neither percentiles nor tiles sort or deal out rows: what is shuffled are the buckets' counts."""
    plans = []
    kind = type(sample)
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda df: (plans.append(df), collect(df))[1])
    big = sample.crossJoin(spark.range(40)).select((F.col("k") * 40 + F.col("id")).alias("k"), "v")
    add_ntiles(big, "k", 4, up=("v", False), down=("v", True))
    exact_percentile(big, "v", Fraction(3, 4))
    assert plans
    for df in plans:
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "rangepartitioning" not in text and "Sort " not in text and "Window" not in text
        assert all(key.startswith("_groupingexpression") for key in re.findall(r"hashpartitioning\((\w+)", text)), text
    assert not hasattr(ranking, "_bracket")


def test_running_totals_equal_the_window(sample):
    df = sample.filter("v is not null").select("k", F.col("v").cast("decimal(18,4)").alias("v"))
    order = Window.orderBy(F.col("v").desc(), "k")
    want = df.withColumn("s", F.sum("v").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "n", F.row_number().over(order)
    )
    got = running_totals(df, "v", "k").join(want.select("k", "s", "n"), "k")
    assert got.count() == df.count()
    assert got.filter("running_value != s or position != n").count() == 0


def test_positions_are_global(sample):
    ordered = OrderedRows(sample, ["v", "k"], "test")
    want = sample.withColumn("n", F.row_number().over(Window.orderBy("v", "k")))
    got = ordered.with_position().join(want.select("k", "n"), "k")
    assert got.filter("position != n").count() == 0
    assert got.count() == 500


def test_surplus_rows_equal_the_window(sample):
    order = [F.col("v").desc(), F.col("k")]
    want = sample.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy(*order)).cast("bigint"))
    got = numbered_surplus(sample, ["g"], order)
    assert got.exceptAll(want.filter("rn > 1")).count() == 0
    assert got.count() == 496


def test_mode_and_first_per_key(spark):
    counts = spark.createDataFrame(
        [(1, "b", 1), (1, "b", 1), (1, "a", 2), (2, "z", 1), (3, None, 1), (3, "a", 1)], "k int, v string, n int"
    )
    assert sorted((r.k, r.m) for r in mode_per_key(counts, "k", "v", "n", "m").collect()) == [(1, "a"), (2, "z"), (3, None)]
    first = first_per_key(counts, ["k"], [F.col("n").desc(), F.col("v").desc()])
    assert sorted((r.k, r.v) for r in first.collect()) == [(1, "a"), (2, "z"), (3, "a")]
