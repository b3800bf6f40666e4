"""Signals in the monthly series of many products at once: spikes, cuts, and fill-rate trends.

Input everywhere: one row per key and month with `forecast_qty` and `confirmed_qty`
(`monthly.keyed_months`), so a key has at most as many rows as there are months, however many
acknowledgement lines it has.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.clean import blank_to_null, ratio
from ..functions.stats import line_fit, slope_p_value
from .monthly import keyed_months


def monthly_by_product(forecasts: DataFrame, acks: DataFrame, key: str = "vendor_sku") -> DataFrame:
    """Monthly forecast and confirmed quantity per product, with their ratio (null without a forecast)."""
    months = keyed_months(forecasts, acks, blank_to_null(F.col(key)).alias(key)).filter(F.col(key).isNotNull())
    return with_fill(months)


def with_fill(months: DataFrame) -> DataFrame:
    fill = F.when(F.col("forecast_qty") > 0, F.col("confirmed_qty") / F.col("forecast_qty"))
    return months.withColumns({"fill_rate": fill, "forecast_vs_actual_ratio": fill})


def ranked_series(months: DataFrame, key: str, window: int = 3, live: Column | None = None, dealt: bool = False) -> DataFrame:
    """The months of each key with their place in three series: confirmed, forecast, and fill rate.

    A series skips its gaps (quantity 0, fill unknown) and months that are not `live`. The rows are
    partitioned by key once, unless they are `dealt` so already; the flag of each series is a second window key on top of that, so no
    window shuffles again. Adds `z_score` against the mean and population deviation of the `window`
    preceding kept months (0 when they are all equal).
    """
    live = F.lit(True) if live is None else live
    df = (months if dealt else months.repartition(key)).withColumns({
        "live": live,
        "in_a": live & (F.col("confirmed_qty") != 0),
        "in_f": live & (F.col("forecast_qty") != 0),
        "in_r": live & F.col("fill_rate").isNotNull(),
    })
    for flag in ("a", "f", "r"):
        part = Window.partitionBy(key, f"in_{flag}")
        series = part.orderBy("month")
        df = df.withColumn(f"rank_{flag}", F.row_number().over(series))
        if flag == "a":
            df = df.withColumn("before", F.array(*[F.lag("confirmed_qty", i).over(series) for i in range(1, window + 1)]))
        df = df.withColumn(f"end_{flag}", F.count("*").over(part) - F.col(f"rank_{flag}") + 1)
    before = F.col("before")
    mean = F.aggregate(before, F.lit(0.0), lambda acc, x: acc + x) / window
    df = df.withColumn("window_mean", mean)
    spread = F.aggregate(before, F.lit(0.0), lambda acc, x: acc + (x - F.col("window_mean")) * (x - F.col("window_mean")))
    flat = F.array_max(before) == F.array_min(before)
    z = F.when(flat, F.lit(0.0)).otherwise((F.col("confirmed_qty") - F.col("window_mean")) / F.sqrt(spread / window))
    return df.withColumn("z_score", F.when(F.col("in_a") & (F.col("rank_a") > window), z)).drop("before")


def spike_pick(z_threshold: float = 3.0, recent_months: int = 6) -> Column:
    """Aggregate over `ranked_series`: the strongest recent spike (the earliest of equals), or null."""
    is_spike = (F.col("z_score") >= z_threshold) & (F.col("end_a") <= recent_months)
    pick = F.struct("z_score", F.col("month").alias("spike_month"), F.col("confirmed_qty").alias("recent"), "window_mean")
    return F.max_by(F.when(is_spike, pick), F.when(is_spike, F.struct("z_score", -F.unix_date("month"))))


def cut_picks() -> list[Column]:
    """Aggregates over `ranked_series`: last and previous kept quantity of both series."""
    at = lambda series, column, n: F.max(F.when(F.col(f"in_{series}") & (F.col(f"end_{series}") == n), F.col(column)))
    return [at("f", "forecast_qty", 1).alias("last_f"), at("f", "forecast_qty", 2).alias("prev_f"),
            at("a", "confirmed_qty", 1).alias("last_a"), at("a", "confirmed_qty", 2).alias("prev_a")]


def cut_type(drop: float = 0.8) -> Column:
    """Forecasts are tested first; the share is computed in doubles, so exactly 80% is no cut."""
    keep = F.lit(1 - drop)
    return (F.when(F.col("last_f") <= F.col("prev_f") * keep, "forecast_drop")
            .when(F.col("last_a") <= F.col("prev_a") * keep, "orders_drop"))


def cut_share() -> Column:
    return (F.when(F.col("cut_type") == "forecast_drop", 1 - F.col("last_f") / F.col("prev_f"))
            .when(F.col("cut_type") == "orders_drop", 1 - F.col("last_a") / F.col("prev_a")))


def trend_sums(months: int = 6) -> list[Column]:
    """Aggregates over `ranked_series`: sums of the last `months` fill rates against 0, 1, 2, ..."""
    recent = F.col("in_r") & (F.col("end_r") <= months)
    n = F.least(F.col("rank_r") + F.col("end_r") - 1, F.lit(months))
    x, y = (n - F.col("end_r")).cast("double"), F.col("fill_rate")
    total = lambda c, name: F.sum(F.when(recent, c)).alias(name)
    return [F.count_if(recent).alias("t_n"), total(x, "t_x"), total(y, "t_y"), total(x * x, "t_xx"),
            total(x * y, "t_xy"), total(y * y, "t_yy"),
            F.avg(F.when(recent, y)).alias("recent_avg"),
            F.avg(F.when(F.col("in_r") & ~recent, y)).alias("older_avg")]


def trend_columns() -> dict[str, Column]:
    """Trend of the fill rate from `trend_sums`; null with fewer than three months."""
    enough = F.col("t_n") >= 3
    fit = line_fit(*[F.col(c) for c in ("t_n", "t_x", "t_y", "t_xx", "t_xy", "t_yy")])
    earlier = F.coalesce(F.col("older_avg"), F.col("recent_avg"))
    slide = (earlier > 0) & (ratio(earlier - F.col("recent_avg"), F.greatest(earlier, F.lit(1e-9))) > 0.05)
    return {
        "slope": F.when(enough, fit["slope"]), "r_value": F.when(enough, fit["r_value"]),
        "p_value": F.when(enough, slope_p_value(fit["r_value"], F.col("t_n"))),
        "earlier_avg": F.when(enough, earlier),
        "recent_avg": F.when(enough, F.col("recent_avg")),
        "deteriorating": F.coalesce(enough & ((fit["slope"] < -0.01) | slide), F.lit(False)),
    }


def demand_zscores(months: DataFrame, key: str = "vendor_sku", window: int = 3) -> DataFrame:
    """Score of every month that has `window` earlier months with demand."""
    return (
        ranked_series(months, key, window).filter(F.col("z_score").isNotNull())
        .select(key, "month", "confirmed_qty", "window_mean", "z_score")
    )


def demand_spikes(months: DataFrame, key: str = "vendor_sku", window: int = 3, z_threshold: float = 3.0,
                  recent_months: int = 6) -> DataFrame:
    return (
        ranked_series(months, key, window).groupBy(key)
        .agg(spike_pick(z_threshold, recent_months).alias("spike"))
        .filter(F.col("spike").isNotNull()).select(key, "spike.*")
    )


def product_cuts(months: DataFrame, key: str = "vendor_sku", drop: float = 0.8) -> DataFrame:
    return (
        ranked_series(months, key).groupBy(key).agg(*cut_picks())
        .withColumn("cut_type", cut_type(drop)).filter(F.col("cut_type").isNotNull())
        .select(key, "cut_type", cut_share().alias("drop_pct"))
    )


def fill_trend(months: DataFrame, key: str = "vendor_sku", recent_months: int = 6) -> DataFrame:
    trend = trend_columns()
    return (
        ranked_series(months, key).groupBy(key).agg(*trend_sums(recent_months))
        .filter(F.col("t_n") >= 3)
        .select(key, *[trend[c].alias(c) for c in
                       ("slope", "r_value", "p_value", "recent_avg", "earlier_avg", "deteriorating")])
    )


def latest_lines(acks: DataFrame, key: str = "vendor_sku", n: int = 10) -> DataFrame:
    """The `n` latest lines of every product by delivery date (as text).

    The row limit is applied within each task before the shuffle, so a product with very many lines
    sends at most `n` of them per task.
    """
    rest = [c for c in acks.columns if c not in (key, "delivery_date")]
    order = Window.partitionBy(key).orderBy(F.desc_nulls_last("delivery_date"), *rest)
    return (
        acks.withColumn(key, blank_to_null(F.col(key))).filter(F.col(key).isNotNull())
        .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    )


def month_index(column: Column) -> Column:
    return F.year(column) * 12 + F.month(column)


