"""State of first-purchase analyses, to which a day's lines are added without reading the lines before them.

The state is reduced lines: what is left of an increment's lines gives the analyses the same results as the lines, and
the reductions of several increments together do so too. Two tables, each with one folder per increment:

* ``sums``: per customer, order and month the first and last date and the sums of the amounts;
* ``firsts``: per customer the lines of the earliest date in the increment. The lines of the earliest date of all are among them.

An increment that comes again replaces what it left the first time, so it counts once. A late increment is one more folder: the
reductions may come in any order. ``compact`` merges folders; their names are kept, and an increment merged before is not
taken again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions.columns import month_of
from shelfwise.sources.storage import drop_folder, scope, write_once

SUMS = (
    "customer_id bigint, order_id bigint, correct_date timestamp_ntz, last_date timestamp_ntz, total_amount decimal(38,2), "
    "new_total_amount decimal(38,4)"
)
FIRSTS = "customer_id bigint, order_id bigint, product_id bigint, correct_date timestamp_ntz"
_INCREMENT = "increment"


def _reduced_sums(lines: DataFrame) -> DataFrame:
    """Of lines, or of sums of lines: one row per customer, order and month."""
    last = "last_date" if "last_date" in lines.columns else "correct_date"
    return (
        lines.groupBy("customer_id", "order_id", month_of("correct_date").alias("_month"))
        .agg(
            F.min("correct_date").alias("correct_date"),
            F.max(last).alias("last_date"),
            F.sum("total_amount").cast("decimal(38,2)").alias("total_amount"),
            F.sum("new_total_amount").cast("decimal(38,4)").alias("new_total_amount"),
        )
        .drop("_month")
    )


def _reduced_firsts(lines: DataFrame) -> DataFrame:
    """The distinct (order, product) of each customer's earliest date."""
    firsts = lines.groupBy(F.col("customer_id").alias("_buyer")).agg(F.min("correct_date").alias("_first"))
    earliest = (F.col("customer_id") == F.col("_buyer")) & (F.col("correct_date") == F.col("_first"))
    return lines.join(firsts, earliest).select("customer_id", "order_id", "product_id", "correct_date").distinct()


@dataclass(frozen=True)
class CustomerState:
    """The state below ``folder``. ``sums()`` and ``firsts()`` can be given to analyses in place of the lines."""

    spark: SparkSession
    folder: str

    def _read(self, table: str, schema: str) -> DataFrame:
        path = f"{self.folder}/{table}"
        if not self._exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(f"{schema}, {_INCREMENT} string").parquet(path)

    def _exists(self, path: str) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def _merged_names(self) -> list[str]:
        path = f"{self.folder}/merged"
        return [r[0] for r in self.spark.read.schema("name string").parquet(path).collect()] if self._exists(path) else []

    def increments(self) -> list[str]:
        """Names of the increments in the state, merged ones included."""
        held = self._read("sums", SUMS)
        apart = [r[0] for r in held.select(_INCREMENT).distinct().collect()] if _INCREMENT in held.columns else []
        return sorted({*apart, *self._merged_names()})

    def add(self, name: str, lines: DataFrame) -> bool:
        """Add the repaired lines of an increment, in place of those of an earlier one of that name.

        Returns whether they were added: an increment that ``compact`` has merged is in the state for good and is left out.
        """
        if name in self._merged_names():
            return False
        for table, reduced in (("sums", _reduced_sums(lines)), ("firsts", _reduced_firsts(lines))):
            reduced.write.mode("overwrite").parquet(f"{self.folder}/{table}/{_INCREMENT}={name}")
        return True

    def sums(self) -> DataFrame:
        """One row per customer, order and month, over all increments."""
        return _reduced_sums(self._read("sums", SUMS).select("customer_id", "order_id", "correct_date", "last_date", "total_amount", "new_total_amount"))

    def firsts(self) -> DataFrame:
        """The distinct (order, product) of each customer's earliest date, over all increments."""
        return _reduced_firsts(self._read("firsts", FIRSTS).select("customer_id", "order_id", "product_id", "correct_date"))

    def spans(self) -> DataFrame:
        """First and last date per customer."""
        dates = F.min("correct_date").alias("first_date"), F.max("last_date").alias("last_date")
        return self.sums().filter("customer_id is not null").groupBy("customer_id").agg(*dates)

    def compact(self, into: str) -> list[str]:
        """Merge all increments there are into one folder named ``into`` and return their names.

        The merged tables are written aside first. The names are recorded before the old folders go.
        """
        names = self.increments()
        with scope(self.spark):
            merged = {"sums": write_once(self.sums(), "sums"), "firsts": write_once(self.firsts(), "firsts")}
            self.spark.createDataFrame([(n,) for n in names], "name string").coalesce(1).write.mode("append").parquet(
                f"{self.folder}/merged"
            )
            apart = [n for n in names if n != into]
            for table, df in merged.items():
                df.write.mode("overwrite").parquet(f"{self.folder}/{table}/{_INCREMENT}={into}")
                for name in apart:
                    drop_folder(self.spark, f"{self.folder}/{table}/{_INCREMENT}={name}")
        return names
