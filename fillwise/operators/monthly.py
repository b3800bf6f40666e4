"""Totals per month, and forecast against actual."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.clean import blank_to_null, delivery_day, month, ratio


def forecast_by_month(forecasts: DataFrame) -> DataFrame:
    """Forecast quantity per month; rows without a month are left out."""
    return (
        forecasts.filter(F.col("forecast_month").isNotNull())
        .groupBy(month(F.col("forecast_month")).alias("month"))
        .agg(F.sum("forecast_qty").alias("forecast_qty"))
    )


def ack_by_month(acks: DataFrame, quantity: str, alias: str) -> DataFrame:
    """An acknowledged quantity per delivery month; unparsable dates are left out."""
    return (
        acks.select(month(delivery_day(acks)).alias("month"), quantity)
        .filter(F.col("month").isNotNull())
        .groupBy("month").agg(F.sum(quantity).alias(alias))
    )


def forecast_summary(forecasts: DataFrame) -> DataFrame:
    return forecast_by_month(forecasts).withColumnRenamed("month", "forecast_month").orderBy("forecast_month")


def demand_by_month(acks: DataFrame) -> DataFrame:
    return ack_by_month(acks, "ordered_qty", "ordered_qty").orderBy("month")


def monthly_pairs(forecasts: DataFrame, acks: DataFrame, how: str = "left", quantity: str = "confirmed_qty") -> DataFrame:
    """Forecast and actual side by side.

    Both sides have one row per calendar month, which bounds the broadcast side; a full join keeps the
    months of either side.
    """
    f = forecast_by_month(forecasts)
    a = ack_by_month(acks, quantity, "actual_qty")
    return f.join(a if how == "full" else F.broadcast(a), "month", how)


def forecast_vs_actual(forecasts: DataFrame, acks: DataFrame) -> DataFrame:
    """Every forecast month with its confirmed quantity (null when there is none) and their ratio."""
    return (
        monthly_pairs(forecasts, acks)
        .select("month", "forecast_qty", "actual_qty",
                ratio(F.col("actual_qty"), F.col("forecast_qty")).alias("fill_rate"))
        .orderBy("month")
    )


def forecast_actual_full(forecasts: DataFrame, acks: DataFrame) -> DataFrame:
    """Months of either side, gaps as 0."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return (
        monthly_pairs(forecasts, acks, "full").select("month", zero("forecast_qty"), zero("actual_qty"))
        .orderBy("month")
    )


def keyed_months(forecasts: DataFrame, acks: DataFrame, *keys: Column) -> DataFrame:
    """One row per key and month with both quantities, gaps as 0.

    A union under one aggregate does the work of a full outer join: rows are combined before the only
    shuffle, and a filter on the key reaches both tables.
    """
    f = forecasts.select(*keys, month(F.col("forecast_month")).alias("month"),
                         F.col("forecast_qty"), F.lit(0.0).alias("confirmed_qty"))
    a = acks.select(*keys, month(delivery_day(acks)).alias("month"),
                    F.lit(0.0).alias("forecast_qty"), F.col("confirmed_qty"))
    both = f.unionByName(a).filter(F.col("month").isNotNull())
    names = [c for c in both.columns if c not in ("forecast_qty", "confirmed_qty")]
    return both.groupBy(*names).agg(
        F.coalesce(F.sum("forecast_qty"), F.lit(0.0)).alias("forecast_qty"),
        F.coalesce(F.sum("confirmed_qty"), F.lit(0.0)).alias("confirmed_qty"))


def product_timeline(forecasts: DataFrame, acks: DataFrame) -> DataFrame:
    """Month by month history of records already selected, for example by a search."""
    return keyed_months(forecasts, acks).orderBy("month")


def brand_forecast(forecasts: DataFrame) -> DataFrame:
    return (
        forecasts.filter(F.col("brand").isNotNull()).groupBy("brand")
        .agg(F.sum("forecast_qty").alias("forecast_qty"))
        .orderBy(F.desc("forecast_qty"), "brand")
    )


def product_months(acks: DataFrame, quantity: str = "ordered_qty", key: str = "vendor_sku") -> DataFrame:
    """An acknowledged quantity per product and delivery month."""
    return (
        acks.select(blank_to_null(F.col(key)).alias(key), month(delivery_day(acks)).alias("month"), quantity)
        .filter(F.col(key).isNotNull() & F.col("month").isNotNull())
        .groupBy(key, "month").agg(F.sum(quantity).alias(quantity))
    )
