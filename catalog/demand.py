"""Monthly totals, forecast error, demand."""

from fillwise.operators import accuracy, monthly, ranking, risk, search

from .views import acks, described_forecasts, forecasts, rounded, sql

TIMELINE_QUERY = "bolt"

_MONTHLY = dict(
    mf="select forecast_month as month, sum(forecast_qty) as f from v_forecasts where forecast_month is not null group by 1",
    ma="""select cast(date_trunc('month', delivery_dt) as date) as month, sum(confirmed_qty) as a, sum(ordered_qty) as o
        from v_acks where delivery_dt is not null group by 1""",
    fa="select mf.month, f, a, o from mf left join ma on mf.month = ma.month")
_SKU_MONTHS = dict(sm="""select trim(vendor_sku) as vendor_sku, cast(date_trunc('month', delivery_dt) as date) as month,
    sum(ordered_qty) as q from v_acks where trim(vendor_sku) <> '' and delivery_dt is not null group by 1, 2""")


def _pair(function):
    return lambda spark, d: function(forecasts(spark, d), acks(spark, d))


def _timeline(spark, d):
    f, a = search.search_records(described_forecasts(spark, d), acks(spark, d, with_order=True), TIMELINE_QUERY)
    return rounded(monthly.product_timeline(f, a), forecast_qty=4)


QUERIES = {
    "forecast_summary": lambda s, d: rounded(monthly.forecast_summary(forecasts(s, d)), forecast_qty=4),
    "forecast_vs_actual": lambda s, d: rounded(_pair(monthly.forecast_vs_actual)(s, d), forecast_qty=4, fill_rate=8),
    "monthly_forecast_actual_full": lambda s, d: rounded(_pair(monthly.forecast_actual_full)(s, d), forecast_qty=4),
    "product_timeline": _timeline,
    "demand_by_month": lambda s, d: monthly.demand_by_month(acks(s, d)),
    "brand_forecast": lambda s, d: rounded(monthly.brand_forecast(described_forecasts(s, d)), forecast_qty=4),
    "top_forecast_products": lambda s, d: rounded(
        ranking.top_forecast_products(described_forecasts(s, d)), forecast_qty=4),
    "mape": lambda s, d: rounded(_pair(accuracy.mape)(s, d), mape=8),
    "wmape": lambda s, d: rounded(_pair(accuracy.wmape)(s, d), wmape=8, wmape_matched=8),
    "forecast_accuracy_gauge": lambda s, d: rounded(_pair(accuracy.accuracy_gauge)(s, d), accuracy_pct=8),
    "forecast_error_monthly": lambda s, d: rounded(
        _pair(accuracy.error_by_month)(s, d), forecast_qty=4, abs_error=4, pct_error=8),
    "forecast_bias": lambda s, d: rounded(_pair(accuracy.forecast_bias)(s, d), forecast_bias=8),
    "forecast_consumption": lambda s, d: rounded(
        _pair(accuracy.forecast_consumption)(s, d), forecast_qty=4, consumption=8),
    "demand_trend": lambda s, d: rounded(risk.demand_trend(acks(s, d)), slope=6),
    "demand_volatility": lambda s, d: rounded(risk.demand_volatility(acks(s, d)), mean_qty=6, std_qty=6, cv=6),
    "seasonality_index": lambda s, d: rounded(risk.seasonality_index(acks(s, d)), mean_qty=6, seasonality=8),
}

ORACLE = {
    "forecast_summary": sql("select month as forecast_month, round(f, 4) as forecast_qty from mf order by 1", **_MONTHLY),
    "forecast_vs_actual": sql("""select month, round(f, 4) as forecast_qty, a as actual_qty, round(a / f, 8) as fill_rate
        from fa order by month""", **_MONTHLY),
    "monthly_forecast_actual_full": sql("""select coalesce(mf.month, ma.month) as month,
        round(coalesce(f, 0), 4) as forecast_qty, coalesce(a, 0) as actual_qty
        from mf full join ma on mf.month = ma.month order by 1""", **_MONTHLY),
    "product_timeline": sql("""
        select month, round(sum(f), 4) as forecast_qty, sum(c) as confirmed_qty from (
          select forecast_month as month, forecast_qty as f, cast(0 as double) as c from hits
          union all
          select cast(date_trunc('month', delivery_dt) as date), 0, confirmed_qty from ack_hits where delivery_dt is not null) x
        group by month""",
        ack_hits=f"""select * from v_acks where vendor_sku ilike '%{TIMELINE_QUERY}%' or buyer_part_number ilike '%{TIMELINE_QUERY}%'
            or upc ilike '%{TIMELINE_QUERY}%' or po_number ilike '%{TIMELINE_QUERY}%' or vendor ilike '%{TIMELINE_QUERY}%'
            or customer ilike '%{TIMELINE_QUERY}%'""",
        hits=f"""select distinct * from v_described where description ilike '%{TIMELINE_QUERY}%'
            or vendor_sku ilike '%{TIMELINE_QUERY}%' or brand ilike '%{TIMELINE_QUERY}%' or department ilike '%{TIMELINE_QUERY}%'
            or vendor_sku in (select trim(vendor_sku) from ack_hits)"""),
    "demand_by_month": sql("select month, o as ordered_qty from ma order by 1", **_MONTHLY),
    "brand_forecast": sql("select brand, round(sum(forecast_qty), 4) as forecast_qty from v_described where brand is not null group by brand"),
    "top_forecast_products": sql("""select vendor_sku, round(sum(forecast_qty), 4) as forecast_qty,
        min(description) as product_description from v_described where trim(vendor_sku) <> ''
        group by vendor_sku order by 2 desc, vendor_sku limit 12"""),
    "mape": sql("select round(coalesce(avg(abs(f - a) / f) filter (f > 0), 0), 8) as mape from fa", **_MONTHLY),
    "wmape": sql("""select round(sum(abs(f - a)) / sum(f), 8) as wmape,
        round(sum(abs(f - a)) / sum(f) filter (a is not null), 8) as wmape_matched from fa""", **_MONTHLY),
    "forecast_accuracy_gauge": sql("""select round(coalesce(avg(least(100, a / f * 100)) filter (f > 0), 50), 8) as accuracy_pct
        from mf join ma on mf.month = ma.month""", **_MONTHLY),
    "forecast_error_monthly": sql("""select month, round(f, 4) as forecast_qty, a as actual_qty, round(abs(f - a), 4) as abs_error,
        case when f > 0 then round(abs(f - a) / f * 100, 8) end as pct_error from fa order by month""", **_MONTHLY),
    "forecast_bias": sql("select round(sum(f - a) / sum(f), 8) as forecast_bias from fa where a is not null", **_MONTHLY),
    "forecast_consumption": sql("""select month, round(f, 4) as forecast_qty, o as ordered_qty, round(o / f, 8) as consumption
        from fa order by month""", **_MONTHLY),
    "demand_trend": sql("""select vendor_sku, round(regr_slope(q, year(month) * 12 + month(month)), 6) as slope, count(*) as months
        from sm group by vendor_sku having count(*) >= 2""", **_SKU_MONTHS),
    "demand_volatility": sql("""select vendor_sku, round(avg(q), 6) as mean_qty, round(stddev_pop(q), 6) as std_qty,
        round(stddev_pop(q) / avg(q), 6) as cv from sm group by vendor_sku""", **_SKU_MONTHS),
    "seasonality_index": sql("""select month(month) as month_of_year, round(avg(o), 6) as mean_qty,
        round(avg(o) / (select avg(o) from ma), 8) as seasonality from ma group by 1""", **_MONTHLY),
}
