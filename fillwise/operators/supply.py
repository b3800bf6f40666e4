"""Fill rates and counts over acknowledgement lines."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.clean import blank_to_null, delivery_day, fill_ratio, month


# Columns whose distinct values a summary counts, and what it calls them.
PARTIES = {"vendor": "vendors", "customer": "customers", "vendor_sku": "products"}
SKETCH_BITS = 16  # 2^16 registers: counts are off by about 0.4 %


def ordered() -> Column:
    return F.col("ordered_qty")


def confirmed() -> Column:
    return F.col("confirmed_qty")


def line_short() -> Column:
    """What a line is short of, never negative."""
    return F.greatest(F.coalesce(ordered(), F.lit(0.0)) - F.coalesce(confirmed(), F.lit(0.0)), F.lit(0.0))


def totals_by(acks: DataFrame, key: str, *more: Column) -> DataFrame:
    """Ordered and confirmed quantity per non-blank key."""
    return (
        acks.withColumn(key, blank_to_null(F.col(key))).filter(F.col(key).isNotNull()).groupBy(key)
        .agg(F.sum("ordered_qty").alias("ordered_qty"), F.sum("confirmed_qty").alias("confirmed_qty"), *more)
    )


def vendor_fill_pct(acks: DataFrame) -> DataFrame:
    """Fill percentage and number of lines per vendor, best first."""
    return (
        totals_by(acks, "vendor", F.count("*").alias("orders"))
        .select("vendor", (fill_ratio(confirmed(), ordered()) * 100).alias("fill_rate"), "orders")
        .orderBy(F.desc("fill_rate"), "vendor")
    )


def vendor_performance(acks: DataFrame) -> DataFrame:
    """Fill per vendor, best first; the score is the fill rate (see `risk.vendor_reliability` for a composite)."""
    fill = fill_ratio(confirmed(), ordered())
    return (
        totals_by(acks, "vendor")
        .select("vendor", "ordered_qty", "confirmed_qty", fill.alias("fill_rate"),
                F.lit(0).alias("late_confirmations"), fill.alias("partial_acceptance"), fill.alias("reliability_score"))
        .orderBy(F.desc("reliability_score"), "vendor")
    )


def fill_rate_histogram(acks: DataFrame, width: int = 5) -> DataFrame:
    """Number of products per fill-rate class; fills of 100 and more share the last class."""
    pct = fill_ratio(confirmed(), ordered()) * 100
    low = F.least(F.floor(pct / width) * width, F.lit(100)).cast("int")
    return (
        totals_by(acks, "vendor_sku").groupBy(low.alias("bin_start")).agg(F.count("*").alias("products"))
        .orderBy("bin_start")
    )


def customer_behavior(acks: DataFrame) -> DataFrame:
    """Average order size and number of lines per customer."""
    return (
        acks.filter(F.col("customer").isNotNull()).groupBy("customer")
        .agg(F.avg("ordered_qty").alias("avg_order"), F.count("*").alias("order_count"))
        .orderBy("customer")
    )


def short_sku_count(acks: DataFrame) -> DataFrame:
    """Number of SKUs whose total confirmed quantity stays below the ordered one."""
    return totals_by(acks, "vendor_sku").agg(F.count_if(ordered() > confirmed()).alias("short_skus"))


def po_summary(acks: DataFrame) -> DataFrame:
    return acks.agg(
        F.count_distinct("po_number").alias("total_pos"),
        F.coalesce(F.sum("ordered_qty"), F.lit(0.0)).alias("ordered_qty"),
        F.coalesce(F.sum("confirmed_qty"), F.lit(0.0)).alias("confirmed_qty"),
        F.coalesce(F.sum(line_short()), F.lit(0.0)).alias("backordered_qty"))


def one_row(*parts: DataFrame) -> DataFrame:
    """Independent one-row aggregates as one row."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def dataset_status(forecasts: DataFrame, acks: DataFrame) -> DataFrame:
    return one_row(forecasts.agg(F.count("*").alias("forecasts")), acks.agg(F.count("*").alias("acks")))


def report_summary(forecasts: DataFrame, acks: DataFrame) -> DataFrame:
    """Record counts and distinct parties, in one pass over the lines."""
    return one_row(
        forecasts.agg(F.count("*").alias("forecast_records")),
        acks.agg(F.count("*").alias("ack_records"), *[F.count_distinct(c).alias(n) for c, n in PARTIES.items()]))


def party_sketches(acks: DataFrame) -> DataFrame:
    """Per delivery month the number of lines and mergeable sketches of distinct parties, to be stored with the lines."""
    return acks.groupBy(month(delivery_day(acks)).alias("month")).agg(
        F.count("*").alias("ack_records"), *[F.hll_sketch_agg(c, SKETCH_BITS).alias(n) for c, n in PARTIES.items() if c in acks.columns])


def approximate_summary(forecasts: DataFrame, sketches: DataFrame) -> DataFrame:
    """`report_summary` from stored `party_sketches` of any months: counts of parties are approximate, no line is read."""
    names = [n for n in PARTIES.values() if n in sketches.columns]
    merged = sketches.agg(F.coalesce(F.sum("ack_records"), F.lit(0)).alias("ack_records"), *[
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(n)), F.lit(0)).alias(n) for n in names])
    return one_row(forecasts.agg(F.count("*").alias("forecast_records")), merged)


def grouped_totals(forecasts: DataFrame, acks: DataFrame) -> DataFrame:
    """Totals of the lines per product, per vendor, per month and of all, and forecasts per month and of all.

    `level` tells which a row is. Lines are read once and reduced to one row per product, vendor and month before they are
    grouped in the four ways; forecasts join them as months.
    """
    lines = acks.select(
        blank_to_null(F.col("vendor_sku")).alias("vendor_sku"), blank_to_null(F.col("vendor")).alias("vendor"), month(delivery_day(acks)).alias("month"),
        ordered().alias("ordered_qty"), confirmed().alias("confirmed_qty"), (confirmed() > ordered()).alias("over"))
    lines = lines.groupBy("vendor_sku", "vendor", "month").agg(
        F.sum("ordered_qty").alias("ordered_qty"), F.sum("confirmed_qty").alias("confirmed_qty"), F.count_if("over").alias("over"))
    plans = forecasts.groupBy(month(F.col("forecast_month")).alias("month")).agg(F.sum("forecast_qty").alias("forecast_qty"))
    both = lines.unionByName(plans, allowMissingColumns=True)
    sums = [F.sum(c).alias(c) for c in ("ordered_qty", "confirmed_qty", "over", "forecast_qty")]
    levels = {3: "vendor_sku", 5: "vendor", 6: "month", 7: "all"}  # bits of what is summed up over
    totals = both.groupingSets([("vendor_sku",), ("vendor",), ("month",), ()], "vendor_sku", "vendor", "month").agg(F.grouping_id().alias("id"), *sums)
    name = reduce(lambda c, kv: c.when(F.col("id") == kv[0], kv[1]), list(levels.items())[1:], F.when(F.col("id") == 3, levels[3]))
    key = F.coalesce("vendor_sku", "vendor", F.col("month").cast("string"))
    return totals.withColumn("level", name).drop("id").filter((F.col("level") == "all") | key.isNotNull())


def dashboard_kpis(forecasts: DataFrame, acks: DataFrame, low_fill: float = 0.8) -> DataFrame:
    """The headline numbers as one row. `mape` and `wmape` are errors: lower is better."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    of = lambda level, c: F.when(F.col("level") == level, c)
    total = lambda c: F.sum(of("all", F.col(c)))
    plan, fill = F.col("forecast_qty"), fill_ratio(confirmed(), ordered())
    error = F.abs(plan - confirmed())
    return grouped_totals(forecasts, acks).agg(
        zero(total("forecast_qty")).alias("forecast_value"), zero(total("ordered_qty")).alias("ordered_quantity"),
        zero(total("confirmed_qty")).alias("confirmed_quantity"), zero(fill_ratio(total("confirmed_qty"), total("ordered_qty"))).alias("fill_rate"),
        F.coalesce(total("over"), F.lit(0)).alias("products_over_supplied"), F.lit(0).alias("high_risk_products"),
        F.count_if(of("vendor_sku", ordered() > confirmed())).alias("products_short"),
        zero(F.avg(of("vendor", fill))).alias("vendor_reliability"), F.count_if(of("vendor", fill < low_fill)).alias("high_risk_vendors"),
        zero(F.avg(of("month", F.when(plan > 0, error / plan)))).alias("mape"),
        zero(F.try_divide(F.sum(of("month", error)), F.sum(of("month", plan)))).alias("wmape"))


def panel_data(forecasts: DataFrame, acks: DataFrame, top_vendors: int = 10, width: int = 5) -> DataFrame:
    """panel, key and value of the four-panel report and its fill-rate histogram, from one pass over the lines.

    Panels `forecast`, `actual` and `demand` have a value per month, `vendor_fill` the fill percentage of the best vendors,
    `fill_rate_histogram` the number of products per class (see fill_rate_histogram).
    """
    percent = fill_ratio(confirmed(), ordered()) * 100
    low = F.least(F.floor(percent / width) * width, F.lit(100)).cast("int").cast("string")
    day = F.col("month").cast("string")
    entry = lambda panel, level, key, value: F.when((F.col("level") == level) & value.isNotNull(), F.struct(
        F.lit(panel).alias("panel"), key.alias("key"), value.cast("double").alias("value")))
    entries = F.array_compact(F.array(
        entry("forecast", "month", day, F.col("forecast_qty")), entry("actual", "month", day, confirmed()), entry("demand", "month", day, ordered()),
        entry("vendor_fill", "vendor", F.col("vendor"), percent), entry("fill_rate_histogram", "vendor_sku", low, F.lit(1.0))))
    rows = grouped_totals(forecasts, acks).select(F.inline(entries)).groupBy("panel", "key").agg(F.sum("value").alias("value"))
    place = F.row_number().over(Window.partitionBy("panel").orderBy(F.desc("value"), "key"))  # months, classes, and one row a vendor
    return rows.withColumn("place", place).filter((F.col("panel") != "vendor_fill") | (F.col("place") <= top_vendors)).drop("place")
