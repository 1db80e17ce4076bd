"""Rows of given ranks found by counting, without putting rows in order.

A total order is a list of integer columns, compared one after the other. Where a wanted rank lies is narrowed down by
histograms: all rows count into equally wide buckets between two bounds, the bucket that holds the rank is cut into buckets in
the next pass, until it is a single value; the rows of that value go on with the next column. A pass is one aggregate over a
few columns whose groups are buckets, so it shuffles buckets, never rows, and brings back ``BUCKETS`` counts per wanted rank at
most. Their number falls by that factor with each pass: three or four for amounts of money, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

#: Buckets of one histogram.
BUCKETS = 4096
#: Bytes of a text that one integer column holds.
_TEXT_BYTES = 6
_UNIT = "decimal(38,0)"
#: Integers up to which differences fit a bigint.
_SMALL = 1 << 62


@dataclass(frozen=True)
class _Range:
    """Rows of one order whose first columns have the values ``fixed`` and whose next one lies from ``low`` to ``high``."""

    order: int
    fixed: tuple[int, ...]
    low: int
    high: int

    @property
    def width(self) -> int:
        return -((self.low - self.high - 1) // BUCKETS)


def whole_units(column: Column, scale: int = 4) -> Column:
    """A number as an integer of its smallest units, exact for decimals of up to ``scale`` places."""
    return (column.cast(f"decimal(38,{scale})") * F.lit(10**scale).cast("decimal(6,0)")).cast(_UNIT)


def key_columns(df: DataFrame, key: str) -> list[Column]:
    """Integer columns that order rows as the column ``key`` does, null first: itself, or the bytes of a text, so many at a time.

    Texts are taken as far as the longest one goes, which costs a pass over the column.
    """
    kind, present = df.schema[key].dataType, F.col(key).isNotNull().cast("int")
    if isinstance(kind, IntegralType):
        return [present, F.coalesce(F.col(key).cast("bigint"), F.lit(0))]
    if not isinstance(kind, StringType):
        raise TypeError(f"{key}: {kind.simpleString()} is neither an integer nor a text")
    raw = F.coalesce(F.col(key).cast("binary"), F.lit("").cast("binary"))
    longest = df.agg(F.max(F.length(raw))).first()[0] or 0
    parts = [
        F.conv(F.rpad(F.hex(F.substring(raw, at + 1, _TEXT_BYTES)), 2 * _TEXT_BYTES, "0"), 16, 10).cast("bigint")
        for at in range(0, longest, _TEXT_BYTES)
    ]
    return [present, *parts, F.length(raw).cast("bigint")]  # a text comes before one that goes on behind its end


def _literal(value: int, kind: str) -> Column:
    return F.lit(Decimal(value)).cast(kind)


class _Counter:
    """The integer columns of some orders over the rows of a table, their bounds, and histograms of them."""

    def __init__(self, df: DataFrame, orders: Sequence[Sequence[Column]]):
        named = {(i, k): c.cast(_UNIT).alias(f"c{i}_{k}") for i, columns in enumerate(orders) for k, c in enumerate(columns)}
        units = df.select(*named.values())
        ends = [f(f"c{i}_{k}").alias(f"{name}{i}_{k}") for i, k in named for name, f in (("low", F.min), ("high", F.max))]
        found = units.agg(F.count("*").alias("rows"), *ends).first()
        self.rows = found["rows"]
        self.bounds = {(i, k): (int(found[f"low{i}_{k}"] or 0), int(found[f"high{i}_{k}"] or 0)) for i, k in named}
        # Most integers are small enough for plain arithmetic.
        self._kinds = {at: "bigint" if -_SMALL < low and high < _SMALL else _UNIT for at, (low, high) in self.bounds.items()}
        self._units = units.select(*[F.col(f"c{i}_{k}").cast(self._kinds[i, k]) for i, k in named])
        self.columns = [len(columns) for columns in orders]

    def whole(self, order: int, fixed: tuple[int, ...]) -> _Range:
        return _Range(order, fixed, *self.bounds[order, len(fixed)])

    def _bucket(self, part: _Range) -> Column:
        """The bucket of a row in the range, null outside."""
        at = part.order, len(part.fixed)
        column, kind = F.col(f"c{at[0]}_{at[1]}"), self._kinds[at]
        low, high, width = (_literal(v, kind) for v in (part.low, part.high, part.width))
        inside = (column >= low) & (column <= high)
        for k, value in enumerate(part.fixed):
            inside = (F.col(f"c{part.order}_{k}") == _literal(value, self._kinds[part.order, k])) & inside
        return F.when(inside, F.call_function("div", column - low, width).cast("int"))

    def histograms(self, parts: Sequence[_Range]) -> dict[_Range, dict[int, int]]:
        """Rows per bucket of each range: one aggregate, whose groups are the buckets."""
        entries = F.array(*[F.struct(F.lit(n).alias("part"), self._bucket(part).alias("bucket")) for n, part in enumerate(parts)])
        inside = F.filter(entries, lambda e: e["bucket"].isNotNull())
        counted = self._units.select(F.explode(inside).alias("e")).groupBy("e.part", "e.bucket").count().collect()
        found: dict[_Range, dict[int, int]] = {part: {} for part in parts}
        for row in counted:
            found[parts[row["part"]]][row["bucket"]] = row["count"]
        return found


def select_ranks(
    df: DataFrame, orders: Sequence[Sequence[Column]], wanted: dict[int, Sequence[int]]
) -> dict[tuple[int, int], tuple[int, ...]]:
    """For each order and each wanted rank (from 0) the values of the order's first columns at that rank.

    ``orders`` are lists of integer columns without nulls. A result holds the first column, and as many more as it takes to tell which rows
    come up to the rank: the rank is that of the last row with these values, or the columns are all there are. ``df`` is
    read once for the bounds and once a pass.
    """
    counter = _Counter(df, orders)
    found: dict[tuple[int, int], tuple[int, ...]] = {}
    places: dict[tuple[int, int], tuple[_Range, int]] = {}

    def go_on(at: tuple[int, int], fixed: tuple[int, ...], rank: int, rows: int) -> None:
        """Look for the rank among the rows that have the values ``fixed``."""
        if not fixed and rank == rows - 1:
            fixed = (counter.bounds[at[0], 0][1],)
        while rank < rows - 1 and len(fixed) < counter.columns[at[0]]:
            part = counter.whole(at[0], fixed)
            if part.low < part.high:
                places[at] = (part, rank)
                return
            fixed = (*fixed, part.low)
        found[at] = fixed

    for order, ranks in wanted.items():
        for rank in ranks:
            if not 0 <= rank < counter.rows:
                raise IndexError(f"rank {rank} of {counter.rows} rows")
            go_on((order, rank), (), rank, counter.rows)
    while places:
        current, places = places, {}
        counts = counter.histograms(list(dict.fromkeys(part for part, _ in current.values())))
        for at, (part, rank) in current.items():
            for bucket, rows in sorted(counts[part].items()):
                if rank < rows:
                    break
                rank -= rows
            low = part.low + bucket * part.width
            if part.width > 1:
                places[at] = (_Range(part.order, part.fixed, low, min(low + part.width - 1, part.high)), rank)
            else:
                go_on(at, (*part.fixed, low), rank, rows)
    return found


def comes_after(columns: Sequence[Column], values: Sequence[int]) -> Column:
    """Whether a row comes after all rows that have these values in the first columns of an order."""
    after = F.lit(False)
    for column, value in reversed(list(zip(columns, values))):
        units, limit = column.cast(_UNIT), _literal(value, _UNIT)
        after = (units > limit) | ((units == limit) & after)
    return after
