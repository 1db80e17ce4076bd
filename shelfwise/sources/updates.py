"""Stored tables that are changed in place: rows replaced, deleted and added, columns added, month by month.

A table lies in one folder per month. A change finds the months it touches, rewrites those and leaves the files of all others
as they are. What a month will hold is moved in by a dynamic partition overwrite, which writes it aside and replaces months when
all of it is there, so a job that dies half-way leaves whole months, old or new, and can be run again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from shelfwise.sources.storage import drop_folder, scope, write_once

#: Name of the partition column, and the folder of rows without a month.
MONTH, NO_MONTH = "stored_month", "none"


@dataclass(frozen=True)
class MonthlyTable:
    """A table stored under ``folder`` by month. ``schema`` is that of its rows, ``stamp`` the column that tells the month."""

    spark: SparkSession
    folder: str
    schema: StructType
    stamp: str

    @classmethod
    def create(cls, df: DataFrame, folder: str, stamp: str) -> MonthlyTable:
        """Store ``df``. Rows of a month lie together; adaptive execution splits a month too large for one file."""
        table = cls(df.sparkSession, folder, df.schema, stamp)
        table._write(table._with_month(df), "errorifexists")
        return table

    def _write(self, rows: DataFrame, mode: str) -> None:
        writer = rows.hint("rebalance", MONTH).write.partitionBy(MONTH).option("compression", "zstd")
        writer.option("partitionOverwriteMode", "dynamic").mode(mode).parquet(self.folder)

    def _with_month(self, df: DataFrame) -> DataFrame:
        month = F.coalesce(F.date_format(self.stamp, "yyyy-MM"), F.lit(NO_MONTH))
        return df.select(*self.schema.names, month.alias(MONTH))

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(StructType(list(self.schema.fields)).add(MONTH, "string")).parquet(self.folder)

    def read(self, months: list[str] | None = None) -> DataFrame:
        """The rows, of some months only if asked for: other folders are not listed. Columns added later are NULL in older files."""
        stored = self._stored()
        if months is not None:
            stored = stored.filter(F.col(MONTH).isin(months))
        return stored.select(*self.schema.names)

    def months(self) -> list[str]:
        """The months that have rows; read from the folders' names."""
        return sorted(r[0] for r in self._stored().select(MONTH).distinct().collect())

    def months_of(self, keys: DataFrame) -> list[str]:
        """Months that hold rows with any of the ``keys`` (rows with the table's key columns): a scan of these columns."""
        held = self._stored().join(keys.distinct(), keys.columns, "left_semi")
        return sorted(r[0] for r in held.select(MONTH).distinct().collect())

    def replace(self, keys: DataFrame, rows: DataFrame | None = None) -> list[str]:
        """Delete all rows that have one of the ``keys``, add ``rows``, and return the months that were rewritten.

        ``keys`` has one or more of the table's columns; a NULL key deletes nothing. Months that neither lose nor get a row
        keep their files. Runs jobs: the new months are written aside, then moved in.
        """
        with scope(self.spark):
            wanted = write_once(keys.distinct(), "keys")
            losing = self.months_of(wanted)
            added = None if rows is None else write_once(self._with_month(rows), "added", compression="zstd")
            gaining = [] if added is None else sorted(r[0] for r in added.select(MONTH).distinct().collect())
            months = sorted({*losing, *gaining})
            if not months:
                return []
            stored = self._stored().filter(F.col(MONTH).isin(months))
            future = stored.join(wanted, wanted.columns, "left_anti").select(*self.schema.names, MONTH)
            if added is not None:
                future = future.unionByName(added)
            self._move_in(future, months)
        return months

    def add(self, rows: DataFrame) -> None:
        """Add ``rows`` in new files of their months; all files there are stay as they are."""
        self._write(self._with_month(rows), "append")

    def update(self, condition: Column, **values: Column) -> list[str]:
        """Set columns of the rows that meet the condition, and return the months that were rewritten.

        A row whose month changes moves there. Months without such a row keep their files.
        """
        with scope(self.spark):
            touched = self._stored().filter(condition)
            changed = write_once(self._with_month(touched.withColumns(values)), "changed")
            months = {r[0] for r in touched.select(MONTH).distinct().collect()}
            months |= {r[0] for r in changed.select(MONTH).distinct().collect()}
            if months:
                stay = self._stored().filter(F.col(MONTH).isin(sorted(months)) & ~F.coalesce(condition, F.lit(False)))
                self._move_in(stay.select(*self.schema.names, MONTH).unionByName(changed), sorted(months))
        return sorted(months)

    def delete(self, condition: Column) -> list[str]:
        """Delete the rows that meet the condition, and return the months that were rewritten."""
        with scope(self.spark):
            months = sorted(r[0] for r in self._stored().filter(condition).select(MONTH).distinct().collect())
            if months:
                stay = self._stored().filter(F.col(MONTH).isin(months) & ~F.coalesce(condition, F.lit(False)))
                self._move_in(stay.select(*self.schema.names, MONTH), months)
        return months

    def add_column(self, name: str, kind: DataType | str) -> MonthlyTable:
        """The table with one more column, NULL in all rows. No file is touched; ``update`` fills it."""
        return MonthlyTable(self.spark, self.folder, StructType(list(self.schema.fields)).add(name, kind), self.stamp)

    def _move_in(self, future: DataFrame, months: list[str]) -> None:
        """Make these months hold the rows of ``future``; a month without rows goes."""
        before = set(self._stored().inputFiles())
        self._write(future, "overwrite")
        kept = {name for name in self._stored().inputFiles() if name in before}
        for month in months:
            if any(f"/{MONTH}={month}/" in name for name in kept):  # nothing came in place of its rows
                drop_folder(self.spark, f"{self.folder}/{MONTH}={month}")
