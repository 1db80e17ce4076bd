"""Import of text files with a place for the rows that do not fit.

A malformed row is neither dropped nor let in half read: it is kept as it came in a reject table of its input. Rows are read and
told apart once; the import is a written table, of which good rows and rejects are two scans.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfwise.sources.storage import write_once
from shelfwise.tables import SCHEMAS, RetailTables

_RECORD = "_record"


@dataclass(frozen=True)
class Import:
    """The good rows of all inputs, and per input the text of every row that does not fit its schema."""

    tables: RetailTables
    rejects: dict[str, DataFrame]

    def all_rejects(self) -> DataFrame:
        """``table, record`` of every rejected row."""
        parts = [df.select(F.lit(table).alias("table"), "record") for table, df in self.rejects.items()]
        return reduce(DataFrame.unionByName, parts)

    def reject_counts(self) -> DataFrame:
        """``table, column, rule, rows`` like the quality profile: rejected rows per input, 0 included."""
        counts = [
            df.agg(F.count("*").alias("rows")).select(
                F.lit(table).alias("table"), F.lit(_RECORD).alias("column"), F.lit("rejected").alias("rule"), "rows"
            )
            for table, df in self.rejects.items()
        ]
        return reduce(DataFrame.unionByName, counts)


def import_tables(spark: SparkSession, folder: str, fmt: str = "csv", **options: str) -> Import:
    """Read the six inputs from ``folder/<table>``; rows with too few or too many fields, or with a value that is not of its
    column's type, become rejects. For CSV pass ``header="true"``. Empty fields are NULL, not malformed. Runs one job per input.
    """
    good, rejects = {}, {}
    for name, schema in SCHEMAS.items():
        typed = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        with_record = StructType(list(typed.fields)).add(_RECORD, "string")
        reader = spark.read.format(fmt).schema(with_record).options(**options)
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _RECORD)
        read = write_once(reader.load(f"{folder.rstrip('/')}/{name}"), f"import-{name}")
        good[name] = read.filter(F.col(_RECORD).isNull()).drop(_RECORD)
        rejects[name] = read.filter(F.col(_RECORD).isNotNull()).select(F.col(_RECORD).alias("record"))
    return Import(RetailTables(**good), rejects)
