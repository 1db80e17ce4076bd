"""Column expressions: case folding, calendar arithmetic, exact rounding, line measures.

Money is decimal until the last projection and leaves as double, so a sum does not depend on the order of its inputs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INSTORE = "instore"
WEEKEND_DAYS = (1, 7)  # Sunday, Saturday with Sunday = 1


def same_text(column: Column, literal: str) -> Column:
    """Equality that ignores upper and lower case, as the source system's collation does."""
    return F.lower(column) == literal.lower()


def is_instore() -> Column:
    return same_text(F.col("channel"), INSTORE)


def line_amount() -> Column:
    return F.col("quantity") * (F.col("mrp") - F.col("discount"))


def line_cost() -> Column:
    return F.col("quantity") * F.col("cost_per_unit")


def line_profit() -> Column:
    return F.col("new_total_amount") - line_cost()


def number(column: Column) -> Column:
    """Money on its way out."""
    return column.cast("double")


def month_of(ts: str | Column) -> Column:
    """'yyyy-MM'; a missing timestamp stays NULL."""
    return F.date_format(ts, "yyyy-MM")


def month_index(ts: str | Column) -> Column:
    """Months since year 0, so that a difference counts calendar boundaries (not full 30-day months)."""
    return F.year(ts) * 12 + F.month(ts)


def is_weekend(ts: str | Column) -> Column:
    """True on Saturday and Sunday; a missing timestamp counts as a weekday."""
    return F.coalesce(F.dayofweek(ts).isin(*WEEKEND_DAYS), F.lit(False))


def safe_divide(numerator: Column, denominator: Column) -> Column:
    """Double division, NULL instead of an error on a zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def ratio2(numerator: Column, denominator: Column, truncate: bool = False) -> Column:
    """numerator / denominator rounded to 2 places, half away from zero, without going through floating point.

    ``truncate`` gives the whole-number quotient a system with integer averages would give.
    """
    wide = "decimal(34,4)"
    num, den = numerator.cast(wide), denominator.cast(wide)
    size, base = F.abs(num), F.abs(den)
    sign = F.when((num < 0) != (den < 0), -1).otherwise(1)
    if truncate:
        units = F.call_function("div", size, base).cast("double")
    else:
        units = F.call_function("div", size * 200 + base, base * 2) / F.lit(100.0)
    return F.when(den != 0, sign * units)


def whole_average(total: Column, count: Column) -> Column:
    """A mean cut to a whole number, as double; NULL without values."""
    return F.when(count > 0, F.call_function("div", total, count)).cast("double")


def percent2(part: Column, whole: Column) -> Column:
    return ratio2(part.cast("decimal(31,4)") * 100, whole)


# The four notations: month/day/year, day/month/year, and ISO with a blank or a T; the time may be left out.
_TIME = r"(?:[ T]\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?)?"
_DATED = rf"^(?:\d{{1,2}}/\d{{1,2}}/\d{{4}}|\d{{4}}-\d{{2}}-\d{{2}}){_TIME}$"
_HALF_DAY = r"^(\S+) (0?[1-9]|1[0-2])(:\d{2}(?::\d{2})?) ?([AaPp])[Mm]$"


def _full_day(text: Column) -> Column:
    """A time with AM or PM on the 24-hour clock."""
    part = lambda k: F.regexp_extract(text, _HALF_DAY, k)
    hour = part(2).try_cast("int") % 12 + F.when(F.lower(part(4)) == "p", 12).otherwise(0)
    return F.concat(part(1), F.lit(" "), F.lpad(hour.cast("string"), 2, "0"), part(3))


def _to_timestamp(dated: Column) -> Column:
    """A text of the four notations; one with slashes is rearranged to ISO, month first if that is a date."""
    slashed = r"^(\d{1,2})/(\d{1,2})/(\d{4})"
    as_iso = lambda parts: F.regexp_replace(dated, slashed, parts).try_cast("timestamp_ntz")
    return F.when(dated.contains("/"), F.coalesce(as_iso("$3-$1-$2"), as_iso("$3-$2-$1"))).otherwise(
        dated.try_cast("timestamp_ntz")
    )


def parse_bill_date(text: Column) -> Column:
    """Mixed date texts to a timestamp without zone: month/day/year first, then day/month/year, then ISO.

    Blanks around the text do not count; a time may be on the 24-hour clock or carry AM or PM. Slashed dates are
    rearranged to ISO, which ``try_cast`` reads without raising per bad row. Anything else is NULL, also a text with a
    zone offset (its wall-clock time elsewhere is unknown) or a year of more than four digits. The usual text meets one
    pattern; the half-day one, which ends in a letter, is tried only on others.
    """
    trimmed = F.trim(text)
    full = _full_day(trimmed)
    return F.when(trimmed.rlike(_DATED), _to_timestamp(trimmed)).when(
        trimmed.rlike(_HALF_DAY), F.when(full.rlike(_DATED), _to_timestamp(full))
    )
