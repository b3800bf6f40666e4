"""Top lists. Every order ends in a key, so equal values have one order and one result."""

from pyspark.sql import DataFrame, functions as F

from ..functions.clean import blank_to_null, fill_ratio
from .supply import confirmed, ordered, totals_by, vendor_performance


def _described(df: DataFrame) -> list:
    """Alphabetically first description, when the table has one."""
    return [F.min("description").alias("product_description")] if "description" in df.columns else []


def top_risk_products(acks: DataFrame, top_n: int = 10) -> DataFrame:
    """Products with the lowest fill; the backorder is the net one and may be negative."""
    fill = fill_ratio(confirmed(), ordered())
    return (
        totals_by(acks, "vendor_sku", *_described(acks))
        .withColumns({"backorder_qty": ordered() - confirmed(), "fill_rate": fill,
                      "risk_score": F.greatest(1 - fill, F.lit(0.0))})
        .orderBy(F.desc("risk_score"), F.desc("backorder_qty"), "vendor_sku").limit(top_n)
    )


def top_forecast_products(forecasts: DataFrame, top_n: int = 12) -> DataFrame:
    return (
        forecasts.withColumn("vendor_sku", blank_to_null(F.col("vendor_sku")))
        .filter(F.col("vendor_sku").isNotNull()).groupBy("vendor_sku")
        .agg(F.sum("forecast_qty").alias("forecast_qty"), *_described(forecasts))
        .orderBy(F.desc("forecast_qty"), "vendor_sku").limit(top_n)
    )


def top_vendors(acks: DataFrame, top_n: int = 15) -> DataFrame:
    return (
        vendor_performance(acks).select("vendor", "ordered_qty", "confirmed_qty", "fill_rate")
        .orderBy(F.desc("fill_rate"), "vendor").limit(top_n)
    )


def recent_acks(acks: DataFrame, top_n: int = 30) -> DataFrame:
    """The latest lines by delivery date; the remaining columns only break ties."""
    rest = [c for c in acks.columns if c != "delivery_date"]
    return acks.orderBy(F.desc_nulls_last("delivery_date"), *rest).limit(top_n)
