from __future__ import annotations

import datetime as dt
import pathlib
import sys
from decimal import Decimal

import pytest
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from shelfwise.sources.session import tune  # noqa: E402
from shelfwise.tables import SCHEMAS  # noqa: E402

CLEAN_LINE = SCHEMAS["orders"] + ", correct_date timestamp_ntz, new_total_amount decimal(18,4)"


@pytest.fixture(scope="session")
def spark(tmp_path_factory) -> SparkSession:
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.maxMetadataStringLength", "4000")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.sql.warehouse.dir", f"file://{tmp_path_factory.mktemp('warehouse')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield tune(session)
    session.stop()


def day(text: str | None) -> dt.datetime | None:
    return dt.datetime.fromisoformat(text) if text else None


class Maker:
    """Builds small tables from dicts; missing columns get harmless values."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def table(self, name: str, rows: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame(rows, SCHEMAS[name])

    def lines(self, *rows: dict) -> DataFrame:
        built = []
        for number, row in enumerate(rows, start=1):
            money = {k: Decimal(str(row.get(k, d))) if row.get(k, d) is not None else None for k, d in
                     {"mrp": 10, "discount": 0, "cost": 5}.items()}
            quantity = row.get("qty", 1)
            amount = row.get("amount", quantity * money["mrp"] if quantity is not None else None)
            nta = row.get("nta", quantity * (money["mrp"] - money["discount"]) if quantity is not None else None)
            built.append(
                (
                    row.get("order", 1), row.get("line", number), row.get("cust", 1), row.get("prod", number),
                    row.get("store", 1), row.get("channel", "Online"), row.get("text"), quantity, money["mrp"],
                    money["discount"], money["cost"], None if amount is None else Decimal(str(amount)),
                    day(row.get("ts", "2022-01-03 10:00:00")), None if nta is None else Decimal(str(nta)),
                )
            )
        return self.spark.createDataFrame(built, CLEAN_LINE)


@pytest.fixture(scope="session")
def make(spark) -> Maker:
    return Maker(spark)


def rows(df: DataFrame, *columns: str) -> list[tuple]:
    """Rows as sorted tuples."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda r: tuple((v is not None, str(v)) for v in r))
