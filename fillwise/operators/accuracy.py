"""Forecast error measures."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.clean import ratio
from .monthly import ack_by_month, forecast_by_month, monthly_pairs


def _f() -> Column:
    return F.col("forecast_qty")


def _a() -> Column:
    return F.col("actual_qty")


def error_by_month(forecasts: DataFrame, acks: DataFrame) -> DataFrame:
    """Absolute and percentage error per forecast month; no percentage without a forecast."""
    return (
        monthly_pairs(forecasts, acks)
        .select("month", _f(), _a(), F.abs(_f() - _a()).alias("abs_error"),
                F.when(_f() > 0, F.abs(_f() - _a()) / _f() * 100).alias("pct_error"))
        .orderBy("month")
    )


def mape(forecasts: DataFrame, acks: DataFrame) -> DataFrame:
    """Mean absolute percentage error over the months with a forecast and a known actual."""
    error = F.when(_f() > 0, F.abs(_f() - _a()) / _f())
    return monthly_pairs(forecasts, acks).agg(F.coalesce(F.avg(error), F.lit(0.0)).alias("mape"))


def wmape(forecasts: DataFrame, acks: DataFrame) -> DataFrame:
    """Absolute error over forecast volume.

    `wmape` divides by the forecast of all months, also those without an actual yet; `wmape_matched`
    by the forecast of the months that have one.
    """
    error = F.sum(F.abs(_f() - _a()))
    return monthly_pairs(forecasts, acks).agg(
        F.coalesce(ratio(error, F.sum(_f())), F.lit(0.0)).alias("wmape"),
        F.coalesce(ratio(error, F.sum(F.when(_a().isNotNull(), _f()))), F.lit(0.0)).alias("wmape_matched"))


def accuracy_gauge(forecasts: DataFrame, acks: DataFrame) -> DataFrame:
    """Mean of actual over forecast, at most 100 per month, over the months both sides have; 50 if none."""
    share = F.when(_f() > 0, F.least(F.lit(100.0), _a() / _f() * 100))
    return monthly_pairs(forecasts, acks, "inner").agg(F.coalesce(F.avg(share), F.lit(50.0)).alias("accuracy_pct"))


def forecast_bias(forecasts: DataFrame, acks: DataFrame) -> DataFrame:
    """Share by which forecasts exceed actuals over the months that have an actual."""
    known = F.when(_a().isNotNull(), _f())
    return monthly_pairs(forecasts, acks).agg(ratio(F.sum(known - _a()), F.sum(known)).alias("forecast_bias"))


def forecast_consumption(forecasts: DataFrame, acks: DataFrame) -> DataFrame:
    """Share of each month's forecast that was ordered."""
    ordered = ack_by_month(acks, "ordered_qty", "ordered_qty")
    return (
        forecast_by_month(forecasts).join(F.broadcast(ordered), "month", "left")  # one row per calendar month
        .select("month", "forecast_qty", "ordered_qty",
                ratio(F.col("ordered_qty"), F.col("forecast_qty")).alias("consumption"))
        .orderBy("month")
    )
