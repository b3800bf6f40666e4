"""Text, number and date cleaning as column expressions."""

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Characters that may mean more than themselves in a pattern.
SPECIAL = "\\|()[]{}.^$?*+"


def blank_to_null(column: Column) -> Column:
    """Trimmed text, or null when nothing is left."""
    text = F.trim(column.cast("string"))
    return F.when(text != "", text)


def squeeze(column: Column) -> Column:
    """Lower-cased text with every run of blanks reduced to one."""
    return F.regexp_replace(F.lower(F.trim(column)), r"\s+", " ")


def first_text(*columns: Column) -> Column:
    """First alternative that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def first_number(*columns: Column) -> Column:
    """First alternative that is present and not zero, as a double; 0 when there is none."""
    return F.coalesce(*[F.nullif(number(c), F.lit(0.0)) for c in columns], F.lit(0.0))


def number(column: Column) -> Column:
    """Double, or null for unparsable text and NaN (NaN would poison sums)."""
    return F.nanvl(column.try_cast("double"), F.lit(None).cast("double"))


def quantity(column: Column) -> Column:
    """Quantity from loosely formatted text: keep digits, dot and minus; anything unparsable is 0."""
    stripped = F.regexp_replace(column.cast("string"), r"[^0-9.\-]", "")
    return F.coalesce(number(stripped), F.lit(0.0))


def day(column: Column) -> Column:
    """Date from text that starts with yyyy-mm-dd; a bare year is not a date."""
    text = F.trim(column.cast("string"))
    return F.when((F.length(text) >= 8) & (F.substring(text, 5, 1) == "-"), text.try_cast("date"))


def month(column: Column) -> Column:
    return F.trunc(column, "MM")


def day_of(df: DataFrame, name: str, parsed: str | None = None) -> Column:
    """The parsed companion column when the table carries one, else `name` parsed on the fly."""
    if parsed and parsed in df.columns:
        return F.col(parsed)
    if isinstance(df.schema[name].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.col(name).cast("date")
    return day(F.col(name))


def delivery_day(acks: DataFrame) -> Column:
    return day_of(acks, "delivery_date", "delivery_dt")


def contains_text(column: Column, pattern: str) -> Column:
    """Case-insensitive pattern search; null never matches.

    A plain ASCII pattern is first looked for as text, which is quicker; with letters the pattern decides
    among what that finds, since lower() also turns a few other signs into ASCII letters.
    """
    text = column.cast("string")
    found = text.rlike("(?i)" + pattern)
    if pattern.isascii() and not set(pattern) & set(SPECIAL):
        found = F.contains(F.lower(text), F.lit(pattern.lower())) & found if re.search("[A-Za-z]", pattern) else F.contains(text, F.lit(pattern))
    return F.coalesce(found, F.lit(False))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def ratio(top: Column, bottom: Column) -> Column:
    """Null instead of an error when the divisor is 0."""
    return F.try_divide(top, bottom)


def fill_ratio(confirmed: Column, ordered: Column) -> Column:
    """Confirmed over ordered, 0 when nothing was ordered."""
    return F.when(ordered > 0, confirmed / ordered).otherwise(F.lit(0.0))


def lookback_start(as_of: Column, months: int) -> Column:
    """First day of the month `months` before `as_of`."""
    return F.trunc(F.add_months(as_of, -months), "MM")


def as_day(value) -> Column:
    """A date parameter as a column; None means today."""
    return F.current_date() if value is None else F.lit(value).cast("date")
