"""Demand variability, delivery reliability, and product classes."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.clean import as_day, blank_to_null, day_of, delivery_day, fill_ratio, lookback_start, month, ratio
from .coverage import shortage_coverage
from .monthly import product_months
from .signals import month_index
from .supply import confirmed, ordered, totals_by

# Class limits and weights.
ABC_LIMITS = (0.80, 0.95)
XYZ_LIMITS = (0.5, 1.0)
RELIABILITY_WEIGHTS = {"fill": 0.7, "on_time": 0.2, "complete": 0.1}
SAFETY_FACTOR = 1.65
# Value classes of the ABC running sum for each doubling of the value.
ABC_STEPS = 64


def demand_trend(acks: DataFrame) -> DataFrame:
    """Slope of the monthly ordered quantity per SKU with at least two months."""
    return (
        product_months(acks).groupBy("vendor_sku")
        .agg(F.regr_slope(F.col("ordered_qty"), month_index(F.col("month")).cast("double")).alias("slope"),
             F.count("*").alias("months"))
        .filter(F.col("months") >= 2)
    )


def demand_volatility(acks: DataFrame) -> DataFrame:
    """Spread of the monthly ordered quantity per SKU, absolute and relative to its mean."""
    mean, spread = F.avg("ordered_qty"), F.stddev_pop("ordered_qty")
    return product_months(acks).groupBy("vendor_sku").agg(
        mean.alias("mean_qty"), spread.alias("std_qty"), ratio(spread, mean).alias("cv"))


def seasonality_index(acks: DataFrame) -> DataFrame:
    """Mean ordered quantity of each month of the year relative to the mean of all months."""
    months = (
        acks.select(month(delivery_day(acks)).alias("month"), "ordered_qty").filter(F.col("month").isNotNull())
        .groupBy("month").agg(F.sum("ordered_qty").alias("ordered_qty"))
    )
    overall = months.agg(F.avg("ordered_qty").alias("mean"))
    return (
        months.groupBy(F.month("month").alias("month_of_year")).agg(F.avg("ordered_qty").alias("mean_qty"))
        .select("month_of_year", "mean_qty", ratio(F.col("mean_qty"), overall.scalar()).alias("seasonality"))
        .orderBy("month_of_year")
    )


def _late(acks: DataFrame) -> Column:
    """Promised after the requested date; null unless both are known."""
    wanted = F.col("requested_dt") if "requested_dt" in acks.columns else day_of(acks, "requested_date")
    return delivery_day(acks) > wanted


def late_confirmations(acks: DataFrame) -> DataFrame:
    """Share of lines promised later than requested per vendor."""
    late = _late(acks)
    return (
        acks.filter(F.col("vendor").isNotNull()).groupBy("vendor")
        .agg(F.count(late).alias("dated_lines"), F.count_if(late).alias("late_lines"),
             F.avg(late.cast("double")).alias("late_share"))
    )


def _partial() -> Column:
    return (confirmed() > 0) & (confirmed() < ordered())


def repeated_partials(acks: DataFrame, at_least: int = 3) -> DataFrame:
    """Vendor and SKU pairs that were confirmed only in part again and again."""
    return (
        acks.select("vendor", blank_to_null(F.col("vendor_sku")).alias("vendor_sku"), "ordered_qty", "confirmed_qty")
        .filter(F.col("vendor").isNotNull() & F.col("vendor_sku").isNotNull() & _partial())
        .groupBy("vendor", "vendor_sku").agg(F.count("*").alias("partial_lines"))
        .filter(F.col("partial_lines") >= at_least)
    )


def vendor_reliability(acks: DataFrame) -> DataFrame:
    """Score 0 to 100 from fill (capped at 1), lines in time, and lines confirmed completely."""
    w, late = RELIABILITY_WEIGHTS, _late(acks)
    score = 100 * (w["fill"] * F.least(F.col("fill_rate"), F.lit(1.0)) + w["on_time"] * (1 - F.col("late_share"))
                   + w["complete"] * (1 - F.col("partial_share")))
    return (
        totals_by(acks, "vendor", F.coalesce(F.avg(late.cast("double")), F.lit(0.0)).alias("late_share"),
                  F.avg(F.coalesce(_partial(), F.lit(False)).cast("double")).alias("partial_share"))
        .withColumn("fill_rate", fill_ratio(confirmed(), ordered()))
        .select("vendor", "fill_rate", "late_share", "partial_share", score.alias("reliability"))
    )


def shortage_counts(acks: DataFrame, as_of=None, lookback_months: int = 12) -> DataFrame:
    """Short and over-supplied lines per SKU since the start of the lookback."""
    return (
        acks.select(blank_to_null(F.col("vendor_sku")).alias("vendor_sku"), "ordered_qty", "confirmed_qty",
                    delivery_day(acks).alias("day"))
        .filter(F.col("vendor_sku").isNotNull() & (F.col("day") >= lookback_start(as_day(as_of), lookback_months)))
        .groupBy("vendor_sku")
        .agg(F.count_if(confirmed() < ordered()).alias("shortages"), F.count_if(confirmed() > ordered()).alias("oversupplies"))
    )


def repeated_shortage(acks: DataFrame, at_least: int = 3) -> DataFrame:
    """SKUs that were short in several months."""
    months = (
        acks.select(blank_to_null(F.col("vendor_sku")).alias("vendor_sku"), month(delivery_day(acks)).alias("month"),
                    "ordered_qty", "confirmed_qty")
        .filter(F.col("vendor_sku").isNotNull() & F.col("month").isNotNull())
        .groupBy("vendor_sku", "month").agg(F.sum("ordered_qty").alias("ordered_qty"), F.sum("confirmed_qty").alias("confirmed_qty"))
    )
    return (
        months.filter(ordered() > confirmed()).groupBy("vendor_sku").agg(F.count("*").alias("short_months"))
        .filter(F.col("short_months") >= at_least)
    )


def _value_class(value: Column) -> Column:
    """Number of a value's class, growing with the value: ABC_STEPS classes for each doubling."""
    size = lambda v: F.floor(F.log2(v.cast("double")) * ABC_STEPS)
    far = 1_000_000
    return F.when(value > 0, size(value)).when(value == 0, F.lit(-far)).otherwise(-2 * far - size(-value))


def abc_class(acks: DataFrame) -> DataFrame:
    """Pareto class per SKU by ordered value (cases times case price).

    A SKU's cumulative share covers all SKUs of at least its value. A window over all SKUs would run in
    one task; instead distinct values fall into classes of nearly equal values, a running sum is taken
    inside each class, and the totals of the higher classes are added. Classes grow with the range of
    the values only, their bounds are fixed, and nothing runs before the result is used.
    """
    value = F.coalesce(F.col("ordered_cases") * F.col("price"), F.lit(0.0)).cast("decimal(38,4)")
    skus = (
        acks.select(blank_to_null(F.col("vendor_sku")).alias("vendor_sku"), value.alias("value"))
        .filter(F.col("vendor_sku").isNotNull()).groupBy("vendor_sku").agg(F.sum("value").alias("value"))
    )
    classed = skus.groupBy("value").agg(F.sum("value").alias("total")).withColumn("class", _value_class(F.col("value")))
    above = Window.orderBy(F.desc("class")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.desc("class")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = (  # one row a class
        classed.groupBy("class").agg(F.sum("total").alias("class_total"))
        .select("class", F.coalesce(F.sum("class_total").over(above), F.lit(0)).alias("higher"), F.sum("class_total").over(whole).alias("whole"))
    )
    inside = F.sum("total").over(Window.partitionBy("class").orderBy(F.desc("value")))
    running = classed.withColumn("inside", inside).join(totals, "class").select(
        "value", (F.col("inside") + F.col("higher")).alias("running"), "whole")
    share = ratio(F.col("running").cast("double"), F.col("whole").cast("double"))
    return skus.join(running, "value").withColumn("cumulative_share", share).select(
        "vendor_sku", F.col("value").cast("double").alias("value"), "cumulative_share",
        F.when(F.col("cumulative_share") <= ABC_LIMITS[0], "A").when(F.col("cumulative_share") <= ABC_LIMITS[1], "B")
        .otherwise("C").alias("abc_class"))


def xyz_class(acks: DataFrame) -> DataFrame:
    """Class by relative spread of monthly demand: steady X, varying Y, erratic Z."""
    cv = F.col("cv")
    return demand_volatility(acks).select(
        "vendor_sku", "cv",
        F.when(cv <= XYZ_LIMITS[0], "X").when(cv <= XYZ_LIMITS[1], "Y").otherwise("Z").alias("xyz_class"))


def supply_risk(acks: DataFrame) -> DataFrame:
    """Half vendor risk, half demand risk per SKU, 0 to 1.

    Vendor risk is one minus the fill of the SKU's vendors, weighted by what was ordered from each.
    """
    vendor_fill = totals_by(acks, "vendor").select("vendor", F.least(fill_ratio(confirmed(), ordered()), F.lit(1.0)).alias("fill"))
    per_vendor = (
        acks.select(blank_to_null(F.col("vendor_sku")).alias("vendor_sku"), blank_to_null(F.col("vendor")).alias("vendor"), "ordered_qty")
        .filter(F.col("vendor_sku").isNotNull() & F.col("vendor").isNotNull())
        .groupBy("vendor_sku", "vendor").agg(F.sum("ordered_qty").alias("ordered_qty"))
    )
    sku_fill = per_vendor.join(vendor_fill, "vendor").groupBy("vendor_sku").agg(
        ratio(F.sum(F.col("ordered_qty") * F.col("fill")), F.sum("ordered_qty")).alias("vendor_fill"))
    cv = F.least(F.coalesce(F.col("cv"), F.lit(0.0)), F.lit(1.0))
    return sku_fill.join(demand_volatility(acks), "vendor_sku", "left").select(
        "vendor_sku", "vendor_fill", "cv",
        (0.5 * (1 - F.coalesce(F.col("vendor_fill"), F.lit(0.0))) + 0.5 * cv).alias("supply_risk"))


def reorder_suggestion(acks: DataFrame, inventory: DataFrame) -> DataFrame:
    """Quantity to reorder: the open shortage plus a safety stock, less the supply left after the shortage."""
    spread = demand_volatility(acks).select("vendor_sku", "std_qty")
    safety = SAFETY_FACTOR * F.coalesce(F.col("std_qty"), F.lit(0.0))
    left_over = F.greatest(F.col("supply_available") - F.col("short_qty"), F.lit(0.0))
    return shortage_coverage(acks, inventory).join(spread, "vendor_sku", "left").select(
        "vendor_sku", "uncovered_short_qty", "supply_available", safety.alias("safety_stock"),
        F.greatest(F.col("uncovered_short_qty") + safety - left_over, F.lit(0.0)).alias("reorder_qty"))
