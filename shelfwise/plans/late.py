"""Repair of lines that arrive after the others, rewriting only the months they change.

Every repair of lines looks at one order at a time, so a late line changes nothing but the rows of its order. Raw and repaired
lines are stored by month (``sources.updates``): the raw lines of the late lines' orders are repaired again, and only the
months that hold rows of these orders, before or after, are rewritten.
"""

from __future__ import annotations

import contextlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.plans import clean
from shelfwise.sources.buckets import bucket_count, fills_buckets
from shelfwise.sources.storage import dealt_by_one_key, scope, write_bucketed, write_once
from shelfwise.sources.updates import MonthlyTable


@dataclass(frozen=True)
class StoredLines:
    """Raw lines as they came (with the date that was read from them) and the repaired ones, both by month."""

    raw: MonthlyTable
    repaired: MonthlyTable
    start: str
    end: str


def _repair(lines: DataFrame, start: str, end: str, buckets: int | None = None) -> DataFrame:
    """All repairs of lines that have their ``correct_date`` already. With ``buckets`` they are dealt out by order once."""
    inside = clean.add_line_amount(clean.filter_date_range(lines, start, end))
    if buckets:
        return clean.unify_orders(clean.written_lines(inside, buckets))
    return clean.unify_orders(write_once(clean.collapse_lines(inside), "lines", "order_id"))


def _stay_dealt(spark: SparkSession, buckets: int | None) -> contextlib.AbstractContextManager[None]:
    return dealt_by_one_key(spark) if buckets else contextlib.nullcontext()


def store_lines(orders: DataFrame, folder: str, start: str = clean.PERIOD[0], end: str = clean.PERIOD[1]) -> StoredLines:
    """Store raw lines and their repair below ``folder``."""
    raw = MonthlyTable.create(clean.parse_bill_dates(orders), f"{folder}/raw", "correct_date")
    with scope(orders.sparkSession):
        buckets = bucket_count(raw.read(), "order_id") if fills_buckets(raw.read()) else None
        repairs = _repair(raw.read(), start, end, buckets)
        with _stay_dealt(orders.sparkSession, buckets):
            repaired = MonthlyTable.create(repairs, f"{folder}/repaired", "correct_date")
    return StoredLines(raw, repaired, start, end)


def add_late_lines(stored: StoredLines, late: DataFrame) -> list[str]:
    """Add raw lines to the store and repair the orders they belong to; the months of repaired lines that were rewritten.

    Lines without an order belong to no order that others share; they are repaired among themselves, as in one run over all
    lines. The result equals that of ``store_lines`` on all lines at once, in whatever portions they came.
    """
    with scope(late.sparkSession):
        dated = write_once(clean.parse_bill_dates(late), "late")
        touched = write_once(dated.select("order_id").distinct(), "orders")
        months = stored.raw.months_of(touched.dropna())
        nobodys = stored.raw.read().filter("order_id is null") if not touched.filter("order_id is null").isEmpty() else None
        earlier, buckets = stored.raw.read(months).select(*dated.columns), None
        if nobodys is None and fills_buckets(touched):
            buckets = bucket_count(earlier.select("order_id").unionByName(dated.select("order_id")), "order_id")
        if buckets:  # lines of many orders are dealt out once: the orders lie in the same buckets
            orders = write_bucketed(touched, "orders", "order_id", buckets)
            dealt = earlier.unionByName(dated).repartition(buckets, "order_id")
            lines = dealt.join(orders, "order_id", "left_semi").select(*dated.columns)
        else:
            lines = earlier.join(touched.dropna(), "order_id", "left_semi").select(*dated.columns).unionByName(dated)
            lines = lines if nobodys is None else lines.unionByName(nobodys.select(*dated.columns))
        again = _repair(lines, stored.start, stored.end, buckets)
        # The raw lines come last: a run that died before them can be run again with the same result.
        rewritten = set() if nobodys is None else set(stored.repaired.delete(F.col("order_id").isNull()))
        with _stay_dealt(late.sparkSession, buckets):
            rewritten |= set(stored.repaired.replace(touched.dropna(), again))
        stored.raw.add(dated)
        return sorted(rewritten)


def drop_orders(stored: StoredLines, orders: DataFrame) -> list[str]:
    """Delete the lines of some orders (``order_id``) from the store; the months of repaired lines that were rewritten."""
    stored.raw.replace(orders.select("order_id"))
    return stored.repaired.replace(orders.select("order_id"))
