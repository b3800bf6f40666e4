"""Table shaping: tidy columns and chronological order."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.clean import blank_to_null, day, number
from ..functions.months import month_label

# Names of description columns, and words that mark a calendar column.
DESCRIPTIONS = {"product description", "description", "ulta item description"}
DATE_WORDS, YEAR_WORD = ("date", "month", "period"), "year"
CALENDAR_SHARE = 0.8


def tidy_columns(df: DataFrame) -> DataFrame:
    """Drop unnamed columns and show one description, the first non-blank one, right after the SKU."""
    plain = lambda c: c.strip().lower().replace("_", " ")
    kept = [c for c in df.columns if not c.strip().lower().startswith("unnamed")]
    found = [c for c in kept if plain(c) in DESCRIPTIONS]
    if not found:
        return df.select([F.col(f"`{c}`") for c in kept])
    text = F.coalesce(*[F.when(blank_to_null(F.col(f"`{c}`")).isNotNull(), F.col(f"`{c}`").cast("string")) for c in found])
    columns = [F.col(f"`{c}`") for c in kept if c not in found]
    names = [c for c in kept if c not in found]
    place = names.index("vendor_sku") + 1 if "vendor_sku" in names else len(names)
    return df.select(*columns[:place], text.alias("Product Description"), *columns[place:])


def _kind(name: str) -> str | None:
    """`date` or `year` if the name of a column calls for it."""
    words = name.lower().replace("_", " ")
    if any(w in words for w in DATE_WORDS):
        return "date"
    return "year" if YEAR_WORD in words else None


def _date_of(text: Column) -> Column:
    return F.coalesce(day(text), month_label(text))


def _is_typed(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))


def _calendar_value(df: DataFrame, name: str) -> Column:
    """The column as date or year number."""
    column = F.col(f"`{name}`")
    if _kind(name) == "year":
        return number(column)
    return column if _is_typed(df, name) else _date_of(column.cast("string"))


def calendar_columns(df: DataFrame) -> DataFrame:
    """How much of each calendar-like column parses: (column_name, filled, parsed, is_calendar).

    Calendar columns repeat their values, so the distinct values are counted first and each is parsed once.
    """
    names = [c for c in df.columns if _kind(c)]
    if not names:
        return df.sparkSession.createDataFrame([], "column_name string, filled long, parsed long, is_calendar boolean")
    values = reduce(lambda a, b: a.unionByName(b), [
        df.select(F.lit(c).alias("column_name"), F.lit(_kind(c)).alias("kind"), F.col(f"`{c}`").cast("string").alias("value"))
        for c in names]).groupBy("column_name", "kind", "value").agg(F.count("value").alias("n"))
    parses = F.when(F.col("kind") == "year", number(F.col("value")).isNotNull()).otherwise(_date_of(F.col("value")).isNotNull())
    counts = values.groupBy("column_name").agg(
        F.sum("n").alias("filled"), F.sum(F.when(parses, F.col("n")).otherwise(0)).alias("parsed"))
    return counts.withColumn("is_calendar", (F.col("filled") > 0) & (F.col("parsed") >= F.col("filled") * CALENDAR_SHARE))


def prepare_calendar(df: DataFrame, x: str | None = None) -> DataFrame:
    """Type the calendar columns (only `x` if given, then ordered by it) when at least 80% parse.

    The decision needs the counts, one row per column name, before the plan can be written.
    """
    scope = df.select(f"`{x}`") if x in df.columns else df
    chosen = [r["column_name"] for r in calendar_columns(scope).filter("is_calendar").collect()]
    typed = df.withColumns({c: _calendar_value(df, c) for c in chosen}) if chosen else df
    return typed.orderBy(f"`{x}`") if x in chosen else typed
